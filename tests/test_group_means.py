"""Group positions half-way between two whole numbers."""

from tidemark.operators import candidates as C


def test_two_positions_are_weighted_by_their_copies(spark):
    ys = [1025 / 7] * 5 + [1045 / 7] * 3  # added one by one they come to less
    rows = [(f"r{i}", "/data/scenes/a.jp2", 100.0, y, "vessel", None, True, "2024-01-01") for i, y in enumerate(ys)]
    labels = spark.createDataFrame(
        rows, "id string, tci_path string, cx_full double, cy_full double, review_category string, record_type string, is_vessel boolean, reviewed_at string")
    scenes = spark.createDataFrame([("a.jp2",)], "scene string")
    out = C.duplicate_groups(labels, scenes).select("group_rows", "group_y").distinct().collect()
    assert [tuple(r) for r in out] == [(8, (1025 / 7 * 5 + 1045 / 7 * 3) / 8)]


def test_more_positions_do_not_depend_on_the_order(spark):
    df = spark.range(3).selectExpr("CASE id WHEN 0 THEN 0.1D WHEN 1 THEN 0.2D ELSE 0.3D END AS y", "1L AS copies")
    assert df.select(C._weighted_mean("y")).first()[0] == 0.6 / 3
    far = df.selectExpr("y * 1e30 AS y", "copies")
    assert abs(far.select(C._weighted_mean("y")).first()[0] / 2e29 - 1) < 1e-12
