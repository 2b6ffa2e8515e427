"""Overlaps of outlines in batches against the plain convex measure and against slices."""

import numpy as np
import pytest

from tidemark.functions import geo as G
from tidemark.functions import shapes as S


def star(rng, n, convex):
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    reach = np.ones(n) if convex else rng.uniform(0.2, 1, n)
    return (rng.uniform(-0.5, 0.5, 2) + reach[:, None] * np.c_[np.cos(turn), np.sin(turn)]).T


def test_batches_of_mixed_sizes():
    rng = np.random.default_rng(3)
    pairs = [(star(rng, rng.integers(3, 9), True), star(rng, rng.integers(3, 9), True)) for _ in range(300)]
    got = G._outline_iou(*[[p[i][j] for p in pairs] for i in (0, 1) for j in (0, 1)])
    want = [S.convex_iou(a.T.tolist(), b.T.tolist()) or 0.0 for a, b in pairs]
    assert got == pytest.approx(want, abs=1e-9)


def test_many_corners_are_measured_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [(star(rng, 40, False), star(rng, 30, False)) for _ in range(6)]
    columns = [[p[i][j] for p in pairs] for i in (0, 1) for j in (0, 1)]
    whole = G._outline_iou(*columns)
    monkeypatch.setattr(G, "BATCH_CELLS", 3000)
    assert (whole > 0).all() and G._outline_iou(*columns) == pytest.approx(whole.tolist(), abs=1e-12)


def test_nulls_in_outlines(spark):
    point = "array<struct<x:double,y:double>>"
    box = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([(0, box, box), (1, box, [(0.0, None), (1.0, 0.0), (1.0, 1.0)]), (2, None, None)], f"k int, a {point}, b {point}")
    assert {r["k"]: r["iou"] for r in G.add_outline_iou(df, "a", "b").collect()} == {0: 1.0, 1: 0.0, 2: 0.0}
