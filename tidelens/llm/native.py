"""Column expressions and storage helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tidelens.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\f\r"  # \x20 and \x09-\x0D
NO_ID = -(2**63)  # stands for a null id; smaller than every other


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts without other letters take the byte-wise path of ``lower``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_remainder(key: Column, mod: int) -> Column:
    return F.crc32(key.cast("string")) % F.lit(mod)


def store(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to a new folder of the shared checkpoint folder and read it again: later steps do not repeat it."""
    path = new_folder(df)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
