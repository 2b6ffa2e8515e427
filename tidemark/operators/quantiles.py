"""Exact quantiles of a column without gathering it in one place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BINS = 4096


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """Values at the given ranks (0 is the smallest) of a column without nulls and NaN; infinities are the end values.

    Each pass counts the rows in a fixed number of bins and looks closer only into bins that hold a wanted rank. A bin of
    one value ends the search. Bins are equal steps between the least and the greatest value of the pass; infinite
    ends get bins of their own and values too close for steps are told apart one by one, so every pass narrows the range.
    """
    found: dict[int, float] = {}
    value = F.col(column)

    def search(rows: DataFrame, lo: float, hi: float, before: int, wanted: list[int]) -> None:
        if lo == hi:
            found.update({k: lo for k in wanted})
            return
        step = (hi / BINS - lo / BINS) if math.isfinite(lo) and math.isfinite(hi) else math.inf
        if math.isinf(step):
            bin_of = F.when(value == -math.inf, 0).when(value == math.inf, 2).otherwise(1)
        elif step > 0 and lo + step > lo:
            bin_of = F.least(F.floor((value - lo) / step), F.lit(BINS - 1))
        else:
            bin_of = F.when(value == lo, 0).otherwise(1)
        table = rows.groupBy(bin_of.alias("b")).agg(
            F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")
        ).orderBy("b").collect()
        for t in table:
            here = [k for k in wanted if before <= k < before + t["n"]]
            if here:
                part = rows.filter((value >= t["lo"]) & (value <= t["hi"]))
                search(part, t["lo"], t["hi"], before, here)
            before += t["n"]

    ends = df.agg(F.min(column), F.max(column)).first()
    search(df, ends[0], ends[1], 0, sorted(set(ranks)))
    return found


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours; nulls and NaN do not count, infinities do.

    Between a finite and an infinite neighbour the quantile is the infinite one.
    """
    rows = df.select(F.col(column).cast("double").alias(column)).filter(F.col(column).isNotNull() & ~F.isnan(column))
    rows = cut_lineage(rows)  # several passes follow; what led to the column runs once
    n = rows.count()
    if n == 0:
        return [None] * len(shares)
    at = [(n - 1) * q for q in shares]
    ranks = [k for a in at for k in (int(a), min(int(a) + 1, n - 1))]
    v = order_statistics(rows, column, ranks)

    def between(a: float) -> float:
        low, high, part = v[int(a)], v[min(int(a) + 1, n - 1)], a - int(a)
        return low if low == high or part == 0 else low + (high - low) * part

    return [between(a) for a in at]
