"""Geodesic lines of a table are measured batch by batch, with nulls kept."""

from tidemark.functions import geo as G


def test_geodesics_go_by_batches(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (None, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    out = df.select(G.geodesic("a", "b", "c", "d").alias("g"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    first, unknown, same = out.select("g.*").collect()
    assert abs(first.dist_m - 111319.4908) < 1e-3 and abs(first.bearing_deg - 90) < 1e-9
    assert (unknown.dist_m, unknown.bearing_deg) == (None, None) and (same.dist_m, same.bearing_deg) == (0.0, 0.0)
