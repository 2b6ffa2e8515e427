"""Steps whose size the optimiser cannot see: no side made of computed cells may be broadcast."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators import spatial as S


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line]


@pytest.fixture
def spots(spark, tmp_path):
    """Few points in a file: small enough that Spark would broadcast whatever is computed from them."""
    spark.range(500).selectExpr("id", "concat('i', id % 3) AS image_name", "id * 1.5D AS cx", "id % 40 * 1.0D AS cy").write.parquet(f"{tmp_path}/p")
    return spark.read.parquet(f"{tmp_path}/p")


def test_cells_are_never_broadcast(spots):
    pts = spots.select("id", "image_name", F.col("cx").alias("x"), F.col("cy").alias("y"))
    for out in (S.without_near(spots, pts, 3.0), S.with_near_flag(spots, pts, 3.0), S.nearest_within(spots, pts, 3.0)):
        found = joins(out)
        assert len(found) >= 2 and not [line for line in found if "Broadcast" in line]


def test_tiled_recall_counts_paths_before_the_listing(spark):
    labels = spark.createDataFrame(
        [(f"/data/scenes/s{i % 3}.jp2", float(i), 1.0, "vessel" if i % 2 else "water", None, i % 2 == 1) for i in range(30)],
        "tci_path string, cx_full double, cy_full double, review_category string, record_type string, is_vessel boolean")
    scenes = spark.createDataFrame([("s0.jp2",), ("s1.jp2",)], "scene string")
    dets = spark.createDataFrame([("s0.jp2", 3.0, 1.0)], "scene string, cx double, cy double")
    row = C.tiled_recall(labels, scenes, dets, 4.0).first()
    assert (row.labelled_rows, row.unique_scenes, row.n_vessel, row.n_matched) == (20, 2, 10, 1)
    none = C.tiled_recall(labels.limit(0), scenes, dets, 4.0).first()
    assert (none.labelled_rows, none.unique_scenes, none.n_vessel) == (0, 0, 0)
