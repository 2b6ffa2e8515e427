"""Centroid clustering of integer vectors with JVM expressions alone.

Components become integers, so every distance, sum and mean is exact and no result depends on the order of rows. The
centroids are literals in the plan: ``zip_with`` and ``aggregate`` give the squared distance to each, ``array_min`` of
(distance, number) chooses the cluster, and one sum for each component over a group-by on the cluster gives what the next
centroids need. Only those sums, ``clusters`` rows, come to the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, record, unpack
from tidemark.session import cut_lineage

#: Components within this bound keep a squared distance over 64 of them inside 63 bits.
LONG_BOUND = 1 << 27


def whole(vector: Column, scale: int, kind: str) -> Column:
    """floor(scale * x) of every component, as integers of SQL type ``kind``."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast(kind))


def usable(vector: Column, width: int) -> Column:
    """True for vectors of exactly ``width`` components, all finite; null vectors and components are not."""
    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    return vector.isNotNull() & (F.size(vector) == width) & F.forall(vector, finite)


def nearest(q: Column, centroids: list[list[int]], kind: str) -> Column:
    """struct(distance, cluster) of the nearest centroid; of equal distances the smaller number wins."""
    zero = F.lit(0).cast(kind)

    def distance(centroid: list[int]) -> Column:
        literal = F.expr(f"cast(array({', '.join(map(str, centroid))}) as array<{kind}>)")
        squares = F.zip_with(q, literal, lambda x, c: ((x - c) * (x - c)).cast(kind))
        return F.aggregate(squares, zero, lambda total, x: (total + x).cast(kind))

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def sums(assigned: DataFrame, width: int) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (rows, sum of every component); one row a cluster reaches the driver."""
    totals = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.expr(f"sum(q[{i}]) AS s{i}") for i in range(width)])
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(width)]) for r in totals.collect()}


def cluster(
    vectors: DataFrame,
    vector: str = "embedding",
    id_col: str = "vec_id",
    clusters: int = 8,
    rounds: int = 10,
    width: int = 64,
    scale: int = 1024,
    seed: str = "3:",
    carry: list[str] | None = None,
) -> DataFrame:
    """Every usable row with ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Centroids start as the ``clusters`` vectors whose sha256 of seed and id is smallest; each round assigns all vectors
    and replaces every centroid that has vectors by the floor of their mean. Rows of another width, or with a null or
    non-finite component, are left out. With fewer vectors than ``clusters`` there are fewer centroids; no vectors give no
    rows. A null id hashes as empty text; rows of equal ids start in the order of their components, equal vectors fall
    into one cluster. Components beyond 2**27 are computed as 38-digit decimals; more digits there, and distances or inertias
    beyond 63 bits, raise Spark's overflow error rather than wrap. ``carry`` names the input columns that are kept (all if not given); results replace columns of their
    names. Runs one job a round while it builds the result.
    """
    columns = vectors.columns if carry is None else carry
    kept = vectors.filter(usable(col(vector), width)).select(record(vectors, columns), col(id_col).alias("id"), col(vector).alias("v"))
    reach = kept.select(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("m")).first()["m"]
    kind = "decimal(38,0)" if reach is not None and reach * scale + 1 >= LONG_BOUND else "long"
    rows = cut_lineage(kept.withColumn("q", whole(col("v"), scale, kind)).drop("v"))
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("key"), "q").orderBy("key", "q").limit(clusters).collect()
    centroids = [[int(x) for x in r["q"]] for r in sorted(first, key=lambda r: (r["key"], r["q"]))]
    if not centroids:
        centroids = [[0] * width]
    for _ in range(rounds):
        assigned = rows.select("q", nearest(col("q"), centroids, kind).getField("cluster").alias("cluster"))
        for k, (n, total) in sums(assigned, width).items():
            centroids[k] = [t // n for t in total]
    final = cut_lineage(rows.select("rec", nearest(col("q"), centroids, kind).alias("best")))
    inertia = {r["cluster"]: int(r["s"]) for r in final.groupBy(F.col("best.cluster").alias("cluster")).agg(F.sum("best.distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    number = F.col("best.cluster")
    return unpack(
        final,
        columns,
        cluster=number.cast("int"),
        distance=F.col("best.distance").cast("long"),
        cluster_inertia=F.get(F.array(*[F.expr(f"bigint({inertia.get(k, 0)})") for k in range(len(centroids))]), number),
        inertia=F.expr(f"bigint({sum(inertia.values())})"),
        centroid_sha256=F.get(F.array(*[F.lit(d) for d in digests]), number),
    )
