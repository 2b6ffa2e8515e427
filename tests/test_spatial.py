"""Distance joins, groups and suppression against brute force, with piled-up and boundary points."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import spatial as S


def points(n, seed, hot=0.34, size=300.0, images=4):
    """Points of which a third lie in one image and a tenth on one spot."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        image = "a" if rnd.random() < hot else rnd.choice("abcd"[:images])
        x, y = rnd.uniform(0, size), rnd.uniform(0, size)
        if rnd.random() < 0.1:
            image, x, y = "a", 50.0, 60.0
        rows.append((i, image, x, y, rnd.randrange(40) / 40.0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, image_name string, cx double, cy double, score double")


def near(p, q, r):
    return p[1] == q[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= r * r


@pytest.mark.parametrize("radius", [2.0, 9.0, 40.0])
def test_without_near_and_flag(spark, radius):
    left, right = points(400, 1), points(150, 2)
    right += [(900, "b", left[0][2] + radius, left[0][3], 0.0), (901, left[1][1], left[1][2], left[1][3] + radius, 0.0)]
    pts = frame(spark, right).select("image_name", F.col("cx").alias("x"), F.col("cy").alias("y"))
    want = {p[0] for p in left if not any(near(p, q, radius) for q in right)}
    assert {r.id for r in S.without_near(frame(spark, left), pts, radius).collect()} == want
    flags = S.with_near_flag(frame(spark, left), pts, radius).collect()
    assert len(flags) == len(left)
    assert {r.id for r in flags if not r.matched} == want


def test_boundary_is_inside(spark):
    left = frame(spark, [(1, "a", 0.0, 0.0, 0.0), (2, "a", 0.0, 0.0001, 0.0)])
    pts = spark.createDataFrame([("a", 3.0, -4.0)], "image_name string, x double, y double")
    assert [r.id for r in S.without_near(left, pts, 5.0).collect()] == [2]


def test_nearest(spark):
    left, right = points(200, 3), points(200, 4)
    pts = frame(spark, right).select("id", "image_name", F.col("cx").alias("x"), F.col("cy").alias("y"))
    got = {r.id: r.near.id if r.near else None for r in S.nearest_within(frame(spark, left), pts, 12.0).collect()}
    for p in left:
        inside = [((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2, q[0]) for q in right if near(p, q, 12.0)]
        assert got[p[0]] == (min(inside)[1] if inside else None)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_groups(spark, parts):
    rows = points(500, 5) + [(1000 + i, "c", 400.0 + 4.0 * i, 400.0, 0.0) for i in range(60)]
    df = frame(spark, rows).repartition(parts)
    got = S.near_groups(df, 5.0, image="image_name", x="cx", y="cy").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.image_name, r.group_key), set()).add(r.id)
    parent = {p[0]: p[0] for p in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, p in enumerate(rows):
        for q in rows[:i]:
            if near(p, q, 5.0):
                parent[find(p[0])] = find(q[0])
    want = {}
    for p in rows:
        want.setdefault(find(p[0]), set()).add(p[0])
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def iou(a, b):
    iw, ih = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if iw <= 0 or ih <= 0:
        return 0.0
    inter = iw * ih
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


@pytest.mark.parametrize("block_rows,parts", [(4000, 3), (25, 1), (7, 5)])
def test_box_suppression(spark, block_rows, parts):
    rnd = random.Random(6)
    rows = []
    for p in points(500, 7):
        w, h = rnd.uniform(5, 60), rnd.uniform(5, 60)
        if p[0] % 10 == 0:
            w, h = 30.0, 30.0
        if p[0] % 97 == 0:
            w = 0.0
        rows.append((p[0], p[1], p[2], p[3], p[2] + w, p[3] + h, p[4]))
    df = spark.createDataFrame(rows, "id long, image string, x1 double, y1 double, x2 double, y2 double, score double")
    got = S.greedy_keep(
        df.repartition(parts), image="image", order=[-F.col("score"), F.col("id")], boxes=("x1", "y1", "x2", "y2"),
        iou=0.3, block_rows=block_rows,
    )
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[0])):
        if all(k[1] != r[1] or iou(k[2:6], r[2:6]) < 0.3 for k in kept):
            kept.append(r)
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in kept)


def test_nested_boxes(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.0, 0.0, 10.0, 10.0, 0.9), (2, "a", 1.0, 1.0, 10.0, 10.0, 0.5), (3, "b", 1.0, 1.0, 10.0, 10.0, 0.5)],
        "id long, image string, x1 double, y1 double, x2 double, y2 double, score double")
    got = S.greedy_keep(df, image="image", order=[-F.col("score"), F.col("id")], boxes=("x1", "y1", "x2", "y2"), iou=0.3)
    assert sorted(r.id for r in got.collect()) == [1, 3]


@pytest.mark.parametrize("block_rows", [4000, 9])
def test_point_suppression(spark, block_rows):
    rows = points(600, 8)
    got = S.greedy_keep(frame(spark, rows), image="image_name", order=[-F.col("score"), F.col("id")], point=("cx", "cy"),
                        radius=6.0, block_rows=block_rows)
    kept = []
    for p in sorted(rows, key=lambda p: (-p[4], p[0])):
        if not any(near(p, k, 6.0) for k in kept):
            kept.append(p)
    assert sorted(r.id for r in got.collect()) == sorted(p[0] for p in kept)


def test_distance_joins_avoid_nested_loops(spark):
    pts = frame(spark, points(50, 1)).select("image_name", F.col("cx").alias("x"), F.col("cy").alias("y"))
    df = S.without_near(frame(spark, points(50, 2)), pts, 4.0)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
