"""A table on disk that holds each key once: hash buckets, copy-on-write, versions committed by one rename.

``versions/<number>/manifest.json`` lists the cells of a version; a cell is a folder of one bucket and one period of time.
A writer puts new cells beside the old ones and commits by renaming a folder to the next number, which fails if another
writer took that number first. Readers see a whole version or the one before; a writer that dies leaves only files that no
version names. Files are reached through Spark's file systems alone, so any store with an atomic rename of folders will do.
"""

from __future__ import annotations

import json
import time as clock
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import unique_rows

NONE = "none"  # the period of rows without a time
BUCKET, PERIOD = "bucket_", "period_"


class Files:
    """The few file operations a table needs, in whatever store the path is."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.exists(folder) else []

    def age(self, name: str) -> float:
        return clock.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename_new(self, source: str, target: str) -> bool:
        """False if the target exists: nothing is ever replaced."""
        if self.exists(target):
            return False
        try:
            return self.fs.rename(self.path(source), self.path(target))
        except Py4JJavaError:
            return False


class KeyedTable:
    """Rows unique in ``keys``: of rows of one key that with the least ``order`` stays, in whatever sequence they come.

    ``time`` is the column whose days (or ``unit``) retention drops. The number of buckets is set when the table is made: an upsert
    rewrites the buckets it touches, so they are what a writer copies and what a task holds.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], time: str | None = None, unit: str = "day", buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.order, self.time, self.unit, self.buckets = spark, path, keys, order, time, unit, buckets
        self.files = Files(spark, path)

    # --- versions

    def version(self) -> int:
        """The newest number; 0 for an empty table."""
        return max((int(n) for n in self.files.names(f"{self.path}/versions") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if n == 0:
            return {"version": 0, "schema": None, "cells": {}, "writers": {}}
        return json.loads(self.files.read(f"{self.path}/versions/{n:012d}/manifest.json"))

    def _commit(self, manifest: dict) -> bool:
        """Publishes ``manifest`` as its version, if that number is free."""
        token = uuid.uuid4().hex
        text = json.dumps(manifest | {"token": token})
        held, target = f"{self.path}/pending/{token}", f"{self.path}/versions/{manifest['version']:012d}"
        self.files.write(f"{held}/manifest.json", text)
        self.files.fs.mkdirs(self.files.path(f"{self.path}/versions"))
        done = self.files.rename_new(held, target)
        # a store that copies in place of a rename says yes to both of two writers: the one whose token is there has won
        if done and json.loads(self.files.read(f"{target}/manifest.json"))["token"] == token:
            return True
        self.files.delete(held)
        return False

    # --- reading

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("the table is empty and has no schema yet")
        return self._cells(m, m["cells"])

    def _cells(self, m: dict, cells: Iterable[str]) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.path}/data/{m['cells'][c]}/{BUCKET}={c.split('|')[0]}/{PERIOD}={c.split('|')[1]}" for c in cells]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # --- writing

    def _placed(self, rows: DataFrame) -> DataFrame:
        period = F.coalesce(F.date_format(F.date_trunc(self.unit, F.col(self.time).cast("timestamp")), "yyyy-MM-dd'T'HH"), F.lit(NONE)) if self.time else F.lit(NONE)
        return rows.withColumns({BUCKET: F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"), PERIOD: period})

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows as new cells and returns them; no version names them yet."""
        folder = uuid.uuid4().hex
        out = f"{self.path}/data/{folder}"
        self._placed(rows).repartition(BUCKET).write.partitionBy(BUCKET, PERIOD).parquet(out)
        cells = {}
        for b in self.files.names(out):
            if b.startswith(BUCKET):
                cells |= {f"{b.split('=')[1]}|{p.split('=')[1]}": folder for p in self.files.names(f"{out}/{b}")}
        return cells

    def upsert(self, batch: DataFrame, writer: str | None = None, number: int | None = None, before_commit: Callable[[], None] | None = None) -> int:
        """Merges a batch and returns the version that holds it. A batch ``number`` that ``writer`` has committed is not merged again.

        The batch is stored once; the buckets it touches are read, merged and written anew. If another writer commits in between, the
        new cells still hold unless one of these buckets was changed, and only then are they merged again."""
        if writer is not None and self.manifest()["writers"].get(writer, -1) >= number:
            return self.version()
        staged = f"{self.path}/pending/{uuid.uuid4().hex}-rows"
        unique_rows(batch, self.keys, self.order).select(*batch.columns).write.parquet(staged)
        new = self.spark.read.schema(batch.schema).parquet(staged)
        touched = {str(r[0]) for r in self._placed(new).select(BUCKET).distinct().collect()}
        cells, base = None, None
        while True:
            m = self.manifest()
            if writer is not None and m["writers"].get(writer, -1) >= number:
                break
            own = {c: f for c, f in m["cells"].items() if c.split("|")[0] in touched}
            if cells is None or own != base:
                both = self._cells(m, own).select(*batch.columns).unionByName(new) if own else new
                cells, base = self._write(unique_rows(both, self.keys, self.order).select(*batch.columns)), own
            if before_commit:
                before_commit()
            kept = {c: f for c, f in m["cells"].items() if c not in own}
            writers = m["writers"] | ({writer: number} if writer is not None else {})
            if self._commit({"version": m["version"] + 1, "schema": json.loads(batch.schema.json()), "cells": kept | cells, "writers": writers}):
                break
        self.files.delete(staged)
        return self.version()

    def drop_before(self, cutoff: str) -> int:
        """Retention: rows with a time before ``cutoff`` (a timestamp as text) go. Older cells are dropped unread; only those that the
        cutoff parts are rewritten. Rows without a time stay."""
        at = self.spark.range(1).select(F.date_format(F.date_trunc(self.unit, F.lit(cutoff).cast("timestamp")), "yyyy-MM-dd'T'HH")).first()[0]
        while True:
            m = self.manifest()
            period = {c: c.split("|")[1] for c in m["cells"]}
            split = [c for c, p in period.items() if p == at]
            keep = {c: f for c, f in m["cells"].items() if period[c] == NONE or period[c] > at}
            if split:
                keep |= self._write(self._cells(m, split).filter(F.col(self.time) >= F.lit(cutoff).cast("timestamp")))
            if self._commit(m | {"version": m["version"] + 1, "cells": keep}):
                return self.version()

    def vacuum(self, keep: int = 1, grace_seconds: float = 86400.0) -> int:
        """Deletes versions but the newest ``keep``, the cells only they name, and what dead writers left longer than the grace ago.
        Returns how many cells were deleted."""
        numbers = sorted(int(n) for n in self.files.names(f"{self.path}/versions") if n.isdigit())
        old, live = numbers[:-keep], numbers[-keep:]
        cells = lambda ns: {(f, c) for n in ns for c, f in self.manifest(n)["cells"].items()}
        named, gone = cells(live), cells(old)
        for folder, c in gone - named:
            b, p = c.split("|")
            self.files.delete(f"{self.path}/data/{folder}/{BUCKET}={b}/{PERIOD}={p}")
        for n in old:
            self.files.delete(f"{self.path}/versions/{n:012d}")
        used = {f for f, _ in named}
        for top, spare in (("data", used), ("pending", set())):
            for name in self.files.names(f"{self.path}/{top}"):
                known = name in {f for f, _ in gone}
                if name not in spare and (known or self.files.age(f"{self.path}/{top}/{name}") > grace_seconds):
                    self.files.delete(f"{self.path}/{top}/{name}")
        return len(gone - named)
