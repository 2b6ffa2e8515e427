"""Known values and planted truths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import angles as A
from tidemark.functions import geo as G
from tidemark.functions import labels as L
from tidemark.functions import shapes as SH
from tidemark.operators import detect as D
from tidemark.operators import evaluate as E
from tidemark.operators import hulls as H
from tidemark.operators import pixels as P
from tidemark.operators import spectral as SP
from tidemark.operators import training as TR
from tidemark.operators import velocity as V


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_angles(spark):
    lit = F.lit
    r = one(spark, a=A.angular_error(lit(10.0), lit(20.0)), b=A.angular_error(lit(350.0), lit(10.0)),
            w=A.wake_line_error(lit(0.0), lit(90.0)), v=A.wake_speed(lit(207.0), lit(3)))
    assert (r.a, r.b, r.w) == (10.0, 20.0, 90.0)
    assert r.v.lambda_m == 69.0 and r.v.v_kn == pytest.approx(20.165, abs=1e-3)


def test_sizes_and_keys(spark):
    lit = F.lit
    r = one(spark, a=L.aspect_ratio(lit(100.0), lit(25.0)), b=L.aspect_ratio(lit(0.0), lit(10.0)),
            f=L.label_fingerprint(lit("/x/s.jp2"), lit(100.123), lit(200.456)), g=L.label_fingerprint(lit("s.jp2"), lit(100.12), lit(200.46)),
            d=G.pixel_distance(lit(0.0), lit(0.0), lit(100.0), lit(0.0), 10.0), e=G.pixel_distance(lit(0.0), lit(0.0), lit(3.0), lit(4.0), 10.0),
            t=G.water_tile_key(lit(103.0), lit(1.0)), u=G.water_tile_key(lit(-5.0), lit(-15.0)))
    assert (r.a, r.b, r.d, r.e) == (4.0, None, 1000.0, 50.0)
    assert r.f == r.g and len(r.f) == 20
    assert (r.t, r.u) == ("100E_00N", "010W_20S")
    with pytest.raises(Exception, match="positive"):
        one(spark, d=G.pixel_distance(lit(0.0), lit(0.0), lit(1.0), lit(0.0), 0.0))


def test_agreement(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8), (1, None)], "y int, confidence double")
    r = E.agreement(df, 0.5).first()
    assert (r.accuracy, r.f1, r.n_vessel, r.n_negative, r.n_unscored) == (1.0, 1.0, 2, 1, 1)
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, confidence double")
    assert E.pearson(flat, "confidence", "y").first().r is None
    md = E.metrics_markdown(E.agreement(df.limit(0), 0.5).first())
    assert "| accuracy | N/A |" in md


def test_clear_water_and_tiles(spark):
    r = one(spark, a=P.clear_water(F.lit(6)), b=P.clear_water(F.lit(8)), c=P.clear_water(F.lit(9)), t=P.tile_starts(F.lit(1000), 640, 320),
            s=P.tile_starts(F.lit(500), 640, 320))
    assert (r.a, r.b, r.c) == (True, False, False)
    assert list(r.t) == [0, 320, 360] and list(r.s) == [0]
    cell = spark.createDataFrame([(50.0, 950.0, 1000, 1000)], "cx double, cy double, width int, height int")
    assert tuple(cell.select(P.grid_cell("cx", "cy").alias("c")).first().c) == (9, 0)


def test_geodesy(spark):
    # One degree along the equator and a quarter meridian on WGS84.
    d, az = G._vincenty([0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [0.0, 90.0])
    assert d[0] == pytest.approx(111319.4908, abs=1e-3) and az[0] == pytest.approx(90.0)
    assert d[1] == pytest.approx(10001965.7293, abs=1e-3) and az[1] == pytest.approx(0.0, abs=1e-9)
    # Central meridian of zone 48 at the equator, and a point north of it.
    s = spark.createDataFrame([(32648, 500000.0, 0.0), (32748, 500000.0, 1e7), (32648, 500000.0, 4997964.9431)], "epsg int, x double, y double")
    rows = G.add_map_lonlat(s, F.col("x"), F.col("y")).collect()
    assert rows[0].lon == pytest.approx(105.0) and rows[0].lat == pytest.approx(0.0)
    assert rows[1].lat == pytest.approx(0.0)
    # 5,000,000 m / 0.9996 of meridian arc lies near 45.135 degrees north.
    arc = G._vincenty([105.0], [0.0], [105.0], [rows[2].lat])[0][0]
    assert arc * 0.9996 == pytest.approx(4997964.9431, abs=1e-3)


def test_lonlat_matches_geodesic_distance(spark):
    s = spark.createDataFrame([(32648, 10.0, -10.0, 300000.0, 200000.0)], "epsg int, a double, e double, x0 double, y0 double")
    d = G.add_lonlat(G.add_lonlat(s, F.lit(0.0), F.lit(0.0), "lo1", "la1"), F.lit(300.0), F.lit(400.0), "lo2", "la2").first()
    dist = G._vincenty([d.lo1], [d.la1], [d.lo2], [d.la2])[0][0]
    # The scale at 200 km from the central meridian differs from 1 by less than a per mille.
    assert dist == pytest.approx(5000.0, rel=1e-3)


def test_rectangles():
    rng = np.random.default_rng(1)
    for angle in rng.uniform(0, np.pi, 20):
        u, v = np.array([np.cos(angle), np.sin(angle)]), np.array([-np.sin(angle), np.cos(angle)])
        corners = np.array([i * 50 * u + j * 25 * v for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]) + 200
        inner = corners.mean(axis=0) + rng.uniform(-0.99, 0.99, (30, 2)) @ np.array([50 * u, 25 * v])
        rect, long_side, short_side = SH.smallest_rectangle(np.vstack([corners, inner]))
        assert (long_side, short_side) == (pytest.approx(100), pytest.approx(50))
        assert abs(SH.polygon_area(rect)) == pytest.approx(5000)
        grown = SH.grow(rect, 2.0)
        assert abs(SH.polygon_area(grown)) == pytest.approx(104 * 54)
        assert math.cos(math.radians(SH.principal_axis_deg(corners)) - angle) ** 2 == pytest.approx(1)
        assert math.cos(math.radians(SH.longest_hull_edge_deg(corners)) - angle) ** 2 == pytest.approx(1)
    sq = [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert SH.convex_iou(sq, [(1, 0), (3, 0), (3, 2), (1, 2)]) == pytest.approx(1 / 3)
    assert SH.convex_iou(sq, sq[::-1]) == pytest.approx(1)
    assert SH.convex_iou(sq, [(5, 5), (6, 5), (6, 6)]) == 0.0
    assert SH.convex_iou(sq[:2], sq) is None


def test_mask_measure(spark):
    s = spark.createDataFrame([(None, 10.0, -10.0, 0.0, 0.0)], "epsg int, a double, e double, x0 double, y0 double")
    pt = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    d = s.withColumn("polygon", F.array(pt(0.0, 0.0), pt(100.0, 0.0), pt(100.0, 50.0), pt(0.0, 50.0)))
    r = H.add_oriented_size(d).first()
    assert (r.length_m, r.width_m, r.aspect) == (pytest.approx(1000), pytest.approx(500), pytest.approx(2))
    assert H.add_oriented_size(s.withColumn("polygon", F.array(pt(0.0, 0.0), pt(1.0, 0.0)))).first().length_m is None


@pytest.mark.parametrize("dx,dy", [(3, 2), (-4, 1), (0, 5)])
def test_planted_shift(spark, dx, dy):
    rng = np.random.default_rng(3)
    field = rng.normal(size=(120, 120))
    a, b = field[30:94, 30:94], field[30 - dy:94 - dy, 30 - dx:94 - dx]  # content moves by (dx, dy) from a to b
    row = [(1, a.ravel().tolist(), b.ravel().tolist(), 64, 64)]
    df = spark.createDataFrame(row, "id int, a array<double>, b array<double>, h int, w int")
    s = V.measure_shifts(df).first().shift
    assert (s.x, s.y) == (pytest.approx(dx, abs=0.05), pytest.approx(dy, abs=0.05)) and s.pnr > 10
    t = V.measure_shifts(df, sign="as_coded").first().shift
    assert (t.x, t.y) == (pytest.approx(-dx, abs=0.1), pytest.approx(-dy, abs=0.1))


def test_velocity_of_planted_motion(spark):
    rng = np.random.default_rng(4)
    field = rng.normal(size=(100, 100))
    at = {"B02": 0, "B03": 1, "B04": 2, "B08": -1}  # columns moved east by one pixel per 0.5 s
    bands = [[0.0] * 4096 for _ in range(12)]
    for name, k in at.items():
        bands[V.BAND_INDEX[name]] = field[18:82, 18 - k:82 - k].ravel().tolist()
    chips = spark.createDataFrame([(1, 64, 64, 12, bands)], "chip_id int, h int, w int, n_bands int, bands array<array<double>>")
    r = V.band_velocity(chips).first()
    assert r.heading_deg == pytest.approx(90, abs=1) and r.speed_ms == pytest.approx(20, rel=0.02) and r.n_pairs == 4


def test_library_rows_match_themselves(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"m{i}", "vessel" if i % 2 else "water", rng.uniform(0.01, 0.9, 12).tolist()) for i in range(140)]
    lib = spark.createDataFrame(rows, "pos int, material string, category string, spec array<double>")
    for part in (lib.filter("pos < 27"), lib):
        got = SP.best_two(part.select("material", "spec"), part).collect()
        assert all(r.match.material == r.material and r.match.angle < 1e-6 for r in got) and len(got) == part.count()


def test_anomaly_against_numpy(spark):
    rng = np.random.default_rng(6)
    chip = rng.uniform(0, 0.3, (12, 8, 8))
    seg = np.zeros((8, 8))
    seg[3:5, 2:6] = 1.0
    chip[:, seg > 0] += 0.2
    rows = [(1, r, c, *[float(x) for x in chip[:, r, c]], 12, float(seg[r, c])) for r in range(8) for c in range(8)]
    names = ", ".join(f"b{i} double" for i in range(12))
    df = spark.createDataFrame(rows, f"chip_id int, r int, c int, {names}, n_bands int, seg double")
    water, hull = chip[:, seg == 0], chip[:, seg == 1].mean(axis=1)
    diff = hull - water.mean(axis=1)
    want = math.sqrt(diff @ np.linalg.inv(np.cov(water) + np.eye(12) * 1e-6) @ diff)
    assert SP.anomaly_score(df).first().anomaly == pytest.approx(want, abs=2e-3)


def test_keel_heading_follows_bow(spark):
    m = lambda r, x, y: (r, float(x), float(y), 1)
    scene = (32648, 10.0, -10.0, 500000.0, 200000.0, 2000, 2000)  # on the central meridian, grid north is true north
    rows = [(1, 0, 0, [m("bow", 50, 10), m("stern", 50, 90), m("side", 40, 50), m("side", 60, 52)], *scene),
            (2, 0, 0, [m("bow", 50, 90), m("stern", 50, 10), m("port", 60, 50), m("starboard", 40, 50)], *scene),
            (3, 0, 0, [m("end", 10, 50), m("end", 90, 50), m("side", 50, 45), m("side", 50, 55)], *scene)]
    df = spark.createDataFrame(rows, "id int, col_off int, row_off int, markers array<struct<role:string,x:double,y:double,hull:int>>,"
                               "epsg int, a double, e double, x0 double, y0 double, width int, height int")
    got = {r.id: r for r in H.add_keel_heading(H.add_hull_quad(df)).collect()}
    assert min(got[1].heading_deg, 360 - got[1].heading_deg) < 0.1 and got[1].heading_source == "keel_quad_bow_stern"
    assert got[2].heading_deg == pytest.approx(180, abs=0.1)
    assert got[3].heading_deg % 180 == pytest.approx(90, abs=0.1) and got[3].heading_source == "keel_quad_ambiguous"
    assert abs(got[3].heading_alt_deg - got[3].heading_deg) == pytest.approx(180)
    metrics = {r.id: r for r in H.add_marker_metrics(df).collect()}
    assert metrics[1].length_m == pytest.approx(800) and metrics[3].heading_source == "ambiguous_end_end"


def test_weighted_draws(spark):
    df = spark.createDataFrame([(f"k{i}", 9.0 if i % 10 == 0 else 1.0) for i in range(4000)], "id string, weight double")
    got = TR.weighted_draws(df, seed=3, buckets=16).collect()
    assert sum(r.times for r in got) == 4000
    heavy = sum(r.times for r in got if int(r.id[1:]) % 10 == 0)
    assert heavy == pytest.approx(2000, rel=0.1)
    again = TR.weighted_draws(df.repartition(7), seed=3, buckets=16).collect()
    assert sorted(got) == sorted(again)


def test_fusion_levels(spark):
    names = "heading_keypoint_deg hull_axis_deg wake_side_deg chroma_heading_deg chroma_pnr heading_direct_deg heading_direct_conf".split()
    rows = [(5.0, 90.0, 90.0, 80.0, 9.0, 80.0, 0.9), (None, 90.0, 80.0, 80.0, 9.0, 80.0, 0.9), (None, 90.0, None, 80.0, 9.0, 280.0, 0.9),
            (None, 90.0, None, 80.0, 3.0, 280.0, 0.9), (None, 90.0, None, None, None, 280.0, 0.1), (None, None, 3.0, 1.0, 9.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = [tuple(r.f) for r in df.select(D.fuse_heading().alias("f")).collect()]
    assert got == [(5.0, "structures"), (270.0, "hull_wake_disambiguated"), (90.0, "hull_chroma_disambiguated"),
                   (270.0, "hull_model_disambiguated"), (90.0, "hull_axis_ambiguous"), (None, "none")]


def test_point_shift(spark):
    df = spark.createDataFrame([([("bow", 1.0, 2.0)],)], "m array<struct<role:string,x:double,y:double>>")
    assert [tuple(x) for x in df.select(G.shift_points("m", 10, 20).alias("m")).first().m] == [("bow", 11.0, 22.0)]


def test_exact_quantiles(spark):
    from tidemark.operators import quantiles as Q

    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=3000) * 10, np.full(2500, 1.25), rng.exponential(size=3000) * 1e6])
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "x double")
    got = Q.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.77, 1.0])
    assert got == pytest.approx(np.quantile(values, [0.0, 0.1, 0.5, 0.77, 1.0]).tolist())
    assert Q.exact_quantiles(df.limit(0), "x", [0.5]) == [None]


def test_quantiles_with_infinities_and_close_values(spark):
    from tidemark.operators.quantiles import exact_quantiles

    of = lambda values, q: exact_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", q)
    assert of([float(i) for i in range(2000)] + [float("inf")], [0.5, 1.0]) == [1000.0, float("inf")]
    assert of([float("-inf"), 1.0, 2.0, float("inf"), float("nan"), None], [0.0, 0.5, 1.0]) == [float("-inf"), 1.5, float("inf")]
    assert of([1.0, 1.0 + 2**-52, 1.0, 1e308, -1e308], [0.5, 0.75]) == [1.0, 1.0 + 2**-52]
    assert of([], [0.5]) == [None]


def test_geodesic_in_the_plan_equals_the_iterated_one(spark):
    rng = np.random.default_rng(1)
    one = np.c_[rng.uniform(-180, 180, 300), rng.uniform(-80, 80, 300)]
    rows = np.r_[np.c_[one, one + rng.normal(0, 0.01, (300, 2))], np.c_[one, one + rng.uniform(-60, 60, (300, 2)) * [1, 0.2]]].tolist()
    rows += [[1.0, 2.0, 1.0, 2.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 90.0], [None, 0.0, 1.0, 1.0]]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select(G.geodesic("a", "b", "c", "d").alias("g")).select("g.*").collect()
    assert got[-1]["dist_m"] is None and got[-4]["dist_m"] == 0
    dist, az = G._vincenty(*np.array(rows[:-1]).T)
    assert np.abs(dist - [r["dist_m"] for r in got[:-1]]).max() < 1e-6
    assert np.abs((az - [r["bearing_deg"] for r in got[:-1]] + 180) % 360 - 180).max() < 1e-6


def test_outlines_of_any_shape(spark):
    point = "array<struct<x:double,y:double>>"
    ell = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    box = [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0), (2.0, 3.0)]
    cross = [(0.5, -1.0), (2.5, -1.0), (2.5, 5.0), (0.5, 5.0)]
    rows = [(ell, ell), (ell, box), (ell, cross), (ell, ell[::-1]), (ell, []), (ell, None), (ell, [(0.0, 0.0), (1.0, 1.0)])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, a {point}, b {point}")
    got = {r["k"]: r["iou"] for r in G.add_outline_iou(df, "a", "b").collect()}
    # The L has area 7; the upright box shares 0.5 * 4 + 1.5 * 1 with it.
    assert got == pytest.approx({0: 1.0, 1: 0.0, 2: 3.5 / (7 + 12 - 3.5), 3: 1.0, 4: 0.0, 5: 0.0, 6: 0.0})
    spots = [(0.5, 3.0, True), (2.0, 2.0, False), (4.0, 0.5, True), (1.0, 2.0, True), (-0.1, 0.0, False), (3.0, 1.0, True), (5.0, 0.0, False)]
    df = spark.createDataFrame([(x, y, ell, w) for x, y, w in spots], f"x double, y double, p {point}, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", G.in_polygon("x", "y", "p").alias("got")).collect())
