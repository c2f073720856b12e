"""Helpers the operators share: tables, clean columns, scratch tables and word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import fresh_path

# The ASCII blanks that separate words, and the letters that are lower-cased.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs neither repeat the work nor
    depend on the executors that did it."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_class(name: str, classes: int) -> Column:
    """The remainder of the CRC32 of a number written as text; null for null."""
    return F.crc32(F.encode(F.col(name).cast("string"), "utf-8")) % classes
