"""Program logs as a streaming source: blocks in files, read by ranges of blocks, resumed at (block, signature).

A log store is a folder of Parquet files ``<first block>-<last block>.parquet``, named once and never changed, as a node's
archive is. The source plans one partition a file of new blocks; an offset names the last block and signature read, so a
stream that stops goes on behind them, inside a block too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "block long, signature string, err string, logs array<string>"
LAST = "\U0010ffff"  # sorts behind every signature
START = {"block": -1, "signature": ""}
S3 = ("s3a://", "s3n://")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    for other in S3:
        path = "s3://" + path[len(other):] if path.startswith(other) else path
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Blocks(InputPartition):
    path: str
    after: tuple[int, str]
    upto: tuple[int, str]


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]

    def _files(self) -> list[tuple[int, int, str]]:
        fs, base = _open(self.folder)
        out = []
        for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            name = f.base_name.removesuffix(".parquet")
            if f.base_name.endswith(".parquet") and name.count("-") == 1 and name.replace("-", "").isdigit():
                out.append((*map(int, name.split("-")), f.path))
        return sorted(out)

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        """The end of the store: the last block of the newest file, all of its transactions. A batch takes all that is new, a task a file."""
        ends = self._files()
        return {"block": ends[-1][1], "signature": LAST} if ends else dict(START)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, z = (start["block"], start["signature"]), (end["block"], end["signature"])
        return [Blocks(path, a, z) for first, last, path in self._files() if last >= a[0] and first <= z[0]]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        fs, _ = _open(self.folder)
        with fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=4096, columns=["block", "signature", "err", "logs"]):
                for row in batch.to_pylist():
                    if partition.after < (row["block"], row["signature"]) <= partition.upto:
                        yield row["block"], row["signature"], row["err"], row["logs"]

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "program_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The log store as a stream of (block, signature, err, logs)."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("program_logs").option("path", folder).load()


def archive(transactions: DataFrame, folder: str, blocks_per_file: int) -> None:
    """Writes transactions (block, signature, err, logs) as files of a log store, a file for each ``blocks_per_file`` blocks.

    Spark writes one file a range of blocks; each is then given its name by a rename, so a reader never sees half a file."""
    spark = transactions.sparkSession
    part = F.floor(F.col("block") / blocks_per_file).cast("long")
    rows = transactions.select("block", "signature", "err", "logs", part.alias("part"))
    staged = f"{folder}/_staged"
    rows.repartition("part").sortWithinPartitions("block", "signature").write.mode("overwrite").partitionBy("part").parquet(staged)
    from .keyed import Files

    files = Files(spark, folder)
    for name in files.names(staged):
        if name.startswith("part="):
            k = int(name.split("=")[1])
            written = [f for f in files.names(f"{staged}/{name}") if f.endswith(".parquet")]
            if len(written) != 1:
                raise RuntimeError(f"blocks {k * blocks_per_file} and on were written as {len(written)} files")
            files.rename_new(f"{staged}/{name}/{written[0]}", f"{folder}/{k * blocks_per_file:012d}-{(k + 1) * blocks_per_file - 1:012d}.parquet")
    files.delete(staged)
