"""Helpers about columns that are not tied to one subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, *names: str) -> DataFrame:
    """Evaluate computed columns once, here.

    Spark merges neighbouring projections and copies an expression into every place that takes a field or
    an element of it. With nested structs that are read dozens of times, those copies multiply. A generator
    of one row keeps the projections apart at no cost in rows or shuffles.
    """
    rest = [c for c in df.columns if c not in names]
    out = df.select(*rest, F.explode(F.array(F.struct(*names))).alias("_pin"))
    return out.select(*rest, *[F.col(f"_pin.{n}").alias(n) for n in names])
