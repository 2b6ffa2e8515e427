"""Small helpers shared by the text operators."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def record(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All columns (or the named ones) as one struct ``rec``, so that working columns cannot clash with them."""
    return F.struct(*[col(c) for c in (df.columns if columns is None else columns)]).alias("rec")


def unpack(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """``rec`` as columns again, followed by ``results``. A result replaces an input column of its name."""
    kept = [col("rec").getField(c).alias(c) for c in columns if c not in results]
    return df.select(*kept, *[value.alias(name) for name, value in results.items()])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def unsigned_crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
