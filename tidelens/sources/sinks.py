"""Writing and reading back: datasets with metadata, splits, exports, keyed appends, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_dataset(df: DataFrame, folder: str, dataset: str, fmt: str = "parquet", tags=()) -> str:
    """Writes ``folder/dataset`` and one metadata row beside it."""
    path = f"{folder}/{dataset}"
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
    writer.format(fmt).save(path)
    meta = read_back(df.sparkSession, path, fmt, df.schema).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset).alias("dataset"), F.lit(fmt).alias("format"), "rows", F.lit(",".join(df.columns)).alias("columns"),
        F.lit(",".join(tags)).alias("tags"), F.lit(df.schema.json()).alias("schema"))
    meta.write.mode("overwrite").json(f"{folder}/_meta/{dataset}")
    return path


def read_back(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
    return reader.format(fmt).load(path)


def dataset_info(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    return spark.read.schema("dataset string, format string, rows long, columns string, tags string, schema string").json(f"{folder}/_meta/{dataset}")


def load_dataset(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """The format and schema come from the metadata row."""
    import json

    info = dataset_info(spark, folder, dataset).first()
    return read_back(spark, f"{folder}/{dataset}", info["format"], T.StructType.fromJson(json.loads(info["schema"])))


def save_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split: the partition folder of the others is not listed."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs to ``a_b`` columns."""
    def leaves(schema: T.StructType, trail=()):
        for f in schema.fields:
            at = (*trail, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, at)
            else:
                yield F.col(".".join(f"`{p}`" for p in at)).alias("_".join(at))

    return df.select(*leaves(df.schema))


def unique_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key: a max-by aggregate, so duplicates collapse before the shuffle."""
    rest = [n for n in df.columns if n not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def append_new(batch: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch whose key is not stored yet, each key once."""
    return unique_rows(batch, keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")


def keep_recent(df: DataFrame, time: str, days: int, now: Column) -> DataFrame:
    """Retention: rows of the last ``days`` (a rewrite; date partitions are simply dropped)."""
    return df.filter(F.col(time) >= now - F.make_dt_interval(F.lit(days)))
