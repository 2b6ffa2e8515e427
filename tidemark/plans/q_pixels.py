"""Registered queries: tiles, windows, masks, pixel statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo as G
from tidemark.operators import pixels as P
from tidemark.plans.q_eval import rounded
from tidemark.plans.q_labels import BASE
from tidemark.plans.registry import query


def mosaic_windows(v, w=8, h=4):
    """One window of the scene mosaic per detection."""
    return v.dets.select(
        "det_id", "scene", F.greatest(F.lit(0), F.floor(F.col("cx") / 2000 * 64).cast("int") - w // 2).alias("col0"),
        F.greatest(F.lit(0), F.floor(F.col("cy") / 2000 * 12).cast("int") - h // 2).alias("row0"),
        F.lit(w).alias("w"), F.lit(h).alias("h"))


WIN = """win AS (SELECT det_id, scene, greatest(0, floor(cx / 2000 * 64)::int - 4) AS col0, greatest(0, floor(cy / 2000 * 12)::int - 2) AS row0 FROM v_dets),
uwin AS (SELECT DISTINCT scene, col0, row0 FROM win),
pix AS (SELECT u.*, m.r, m.c, m.v, m.cls, m.occurrence FROM uwin u JOIN v_mosaic m ON m.scene = u.scene AND m.r >= row0 AND m.r < row0 + 4 AND m.c >= col0 AND m.c < col0 + 8)"""
LAND = "CASE WHEN occurrence BETWEEN 50 AND 100 THEN 0 ELSE 1 END"


@query("h1_scene_tiles", """
WITH s AS (SELECT scene, width, height, unnest(list_distinct(list_append(generate_series(0, height - 640, 320), height - 640))) AS row0 FROM v_scenes)
SELECT scene, row0::int AS row0, unnest(list_distinct(list_append(generate_series(0, width - 640, 320), width - 640)))::int AS col0 FROM s""")
def _(v):
    tile, stride = P.tiling(320, 0.5)
    return P.scene_tiles(v.scenes, tile, stride).select("scene", "row0", "col0")


@query("d5_window_pixels", f"""
WITH {WIN}, a AS (SELECT scene, col0, row0, count(*) AS n, round(sum(v), 6) AS total FROM pix GROUP BY ALL)
SELECT det_id, coalesce(n, NULL) AS n, total FROM win LEFT JOIN a USING (scene, col0, row0)""")
def _(v):
    s = P.window_statistics(mosaic_windows(v), v.mosaic, "scene", "det_id", {"n": F.count("*"), "total": F.sum("v")}, block=16)
    return s.select("det_id", "n", F.round("total", 6).alias("total"))


@query("h2_padded_window", """
WITH w AS (SELECT DISTINCT scene, least(54, floor(cx / 2000 * 64)::int) AS col0, 0 AS row0 FROM v_dets),
sz AS (SELECT scene, max(r) + 1 AS height, max(c) + 1 AS width FROM v_mosaic GROUP BY scene),
k AS (SELECT w.* FROM w JOIN sz USING (scene) WHERE least(16, width - col0) >= 8 AND least(16, height - row0) >= 8),
g AS (SELECT k.*, pr.x AS pr, pc.x AS pc FROM k, (SELECT unnest(generate_series(0, 15)) AS x) pr, (SELECT unnest(generate_series(0, 15)) AS x) pc)
SELECT concat(g.scene, ':', g.col0) AS win, pr::int AS pr, pc::int AS pc, coalesce(m.v, 0) AS v FROM g LEFT JOIN v_mosaic m ON m.scene = g.scene AND m.r = row0 + pr AND m.c = col0 + pc""")
def _(v):
    m = v.mosaic
    size = m.groupBy("scene").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    w = v.dets.select("scene", F.least(F.lit(54), F.floor(F.col("cx") / 2000 * 64).cast("int")).alias("col0"), F.lit(0).alias("row0")).distinct()
    w = w.join(size, "scene").withColumn("win", F.concat_ws(":", "scene", "col0"))
    return P.padded_window(w, m, "scene", "win", 16, block=16).select("win", "pr", "pc", "v")


@query("h3_max_normalise", """
WITH t AS (SELECT chip_id, greatest(max(b0), max(b1), max(b2), 1e-6) AS mx FROM v_wide GROUP BY chip_id)
SELECT chip_id, r, c, trunc(least(greatest(b0 / mx * 255.0::double, 0), 255))::int AS b0, trunc(least(greatest(b1 / mx * 255.0::double, 0), 255))::int AS b1,
 trunc(least(greatest(b2 / mx * 255.0::double, 0), 255))::int AS b2 FROM v_wide JOIN t USING (chip_id)""")
def _(v):
    return P.max_normalise(P.wide_pixels(v.pixels), "chip_id").select("chip_id", "r", "c", "b0", "b1", "b2")


@query("h3_minmax_normalise", """
WITH t AS (SELECT scene, min(v) AS mn, max(v) AS mx FROM v_mosaic GROUP BY scene)
SELECT scene, r, c, trunc(least(greatest((v - mn) / (mx - mn + 1e-9::double) * 255.0::double, 0), 255))::int AS v FROM v_mosaic JOIN t USING (scene)""")
def _(v):
    return P.minmax_normalise(v.mosaic, "scene").select("scene", "r", "c", "v")


@query("h4_block_mean", """
SELECT scene, r // 4 AS r, c // 4 AS c, round(avg(v), 6) AS v FROM v_mosaic GROUP BY scene, r // 4, c // 4""")
def _(v):
    return rounded(P.block_mean(v.mosaic, "scene", 4))


@query("h4_area_resize", """
WITH sz AS (SELECT scene, max(c) + 1 AS width, max(r) + 1 AS height FROM v_mosaic GROUP BY scene),
o AS (SELECT *, greatest(1, round_even(width * least(1.0::double, 27.0::double / greatest(width, height)), 0)::int) AS out_w,
  greatest(1, round_even(height * least(1.0::double, 27.0::double / greatest(width, height)), 0)::int) AS out_h FROM sz),
g AS (SELECT o.*, i::int AS i, j::int AS j FROM o, (SELECT unnest(generate_series(0, 26)) AS i) x, (SELECT unnest(generate_series(0, 26)) AS j) y WHERE i < out_h AND j < out_w),
m AS (SELECT g.scene, i, j, v, (least((r + 1) * out_h, (i + 1) * height) - greatest(r * out_h, i * height)) * (least((c + 1) * out_w, (j + 1) * width) - greatest(c * out_w, j * width)) AS share
  FROM g JOIN v_mosaic p ON p.scene = g.scene AND (r + 1) * out_h > i * height AND r * out_h < (i + 1) * height AND (c + 1) * out_w > j * width AND c * out_w < (j + 1) * width)
SELECT scene, i AS r, j AS c, round(sum(v * share) / sum(share), 6) AS v FROM m GROUP BY scene, i, j""")
def _(v):
    """Scenes of 64 columns at a longest side of 27: no factor divides."""
    m = v.mosaic
    sizes = m.groupBy("scene").agg((F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"))
    sizes = sizes.select("*", P.fitted_size("width", "height", 27).alias("o")).select("*", "o.*")
    return rounded(P.area_resize(m, sizes, "scene").select("scene", "r", "c", "v"))


@query("h3_closeup", f"""
WITH win AS (SELECT DISTINCT scene, greatest(0, floor(cx / 2000 * 64)::int - 4) AS col0, greatest(0, floor(cy / 2000 * 12)::int - 2) AS row0 FROM v_dets),
t AS (SELECT win.*, greatest(max(greatest(b0, b1, b2)), 1e-6) AS mx FROM win JOIN v_mosaic m ON m.scene = win.scene
  AND m.c >= col0 - 28 AND m.c < col0 + 36 AND m.r >= row0 - 14 AND m.r < row0 + 18 GROUP BY ALL)
SELECT t.scene, row0, col0, r, c, {', '.join(f"trunc(least(greatest({b} / mx * 255.0::double, 0), 255))::int AS {b}" for b in ('b0', 'b1', 'b2'))}
FROM t JOIN v_mosaic m ON m.scene = t.scene AND m.c >= col0 AND m.c < col0 + 8 AND m.r >= row0 AND m.r < row0 + 4""")
def _(v):
    """Close-ups of 8 by 4 pixels in windows eight times as wide."""
    w = mosaic_windows(v).withColumns({
        "wide_row0": F.col("row0") - 14, "wide_col0": F.col("col0") - 28, "wide_h": F.lit(32), "wide_w": F.lit(64)})
    blocks = P.pixel_blocks(v.mosaic, "scene", block=8)
    return P.closeup_normalise(w, blocks, "scene", block=8).select("scene", "row0", "col0", "r", "c", "b0", "b1", "b2")


@query("h5_align_nearest", """
WITH t AS (SELECT k, scene, r, c, floor((305.0::double + (c + 0.5) * 5 - 300) / 10)::int AS sc, floor((200.0::double + (r + 0.5) * -5 - 198) / -10)::int AS sr FROM v_mosaic)
SELECT t.scene, t.r, t.c, coalesce(s.cls, 0) AS cls FROM t LEFT JOIN v_mosaic s ON s.scene = t.scene AND s.r = t.sr AND s.c = t.sc""")
def _(v):
    m = v.mosaic
    affine = {"ta": 5.0, "te": -5.0, "tx0": 305.0, "ty0": 200.0, "sa": 10.0, "se": -10.0, "sx0": 300.0, "sy0": 198.0}
    t = m.select("scene", "r", "c", *[F.lit(x).alias(n) for n, x in affine.items()])
    return P.align_nearest(m, t, "scene").select("scene", "r", "c", "cls")


@query("h6_reflectance", """
SELECT det_id, least(1.0::double, greatest(0.0::double, (cx * 7 - 500) / 10000)) AS v, round_even(cx * 0.5 - 16, 0)::int AS col0, round_even(cy * 0.5 - 16, 0)::int AS row0, 32 AS side FROM v_dets""")
def _(v):
    d = v.dets.withColumn("q", P.native_window("cx", "cy", 32, 20))
    return d.select("det_id", P.reflectance(F.col("cx") * 7 - 500).alias("v"), "q.*")


@query("h7_stack_bands", "SELECT chip_id, r, c, n_bands, " + ", ".join(f"b{i}" for i in range(12)) + " FROM v_wide")
def _(v):
    return P.explode_chips(P.stack_bands(v.pixels))


@query("h8_land_mask", f"""
WITH m AS (SELECT scene, r, c, {LAND} AS land FROM v_mosaic)
SELECT scene, r, c, land FROM m WHERE scene IN (SELECT scene FROM m GROUP BY scene HAVING avg(land) < 1)""")
def _(v):
    m = v.mosaic.select("scene", "r", "c", P.is_land("occurrence").alias("land"))
    return P.usable_land_mask(m, "scene").select("scene", "r", "c", "land")


@query("h9_erode", f"""
WITH m AS (SELECT scene, r, c, ({LAND}) = 0 OR v < 0.1 AS water FROM v_mosaic)
SELECT a.scene, a.r, a.c, a.water AND coalesce(n.water, false) AND coalesce(s.water, false) AND coalesce(e.water, false) AND coalesce(w.water, false) AS water
FROM m a LEFT JOIN m n ON n.scene = a.scene AND n.r = a.r - 1 AND n.c = a.c LEFT JOIN m s ON s.scene = a.scene AND s.r = a.r + 1 AND s.c = a.c
LEFT JOIN m e ON e.scene = a.scene AND e.r = a.r AND e.c = a.c + 1 LEFT JOIN m w ON w.scene = a.scene AND w.r = a.r AND w.c = a.c - 1""")
def _(v):
    m = v.mosaic.select("scene", "r", "c", ((P.is_land("occurrence") == 0) | (F.col("v") < 0.1)).alias("water"))
    return P.erode(m, "scene").select("scene", "r", "c", "water")


@query("h10_masks", """
SELECT chip_id, r, c, band, (c - 1) * 2 - (r - 1) * 5 <= 0 AND (c - 6) * 3 - (r - 3) * -2 <= 0 AND (r - 6) * -3 - (c - 4) * -2 >= -1e9 AND
  ((6 - 1) * (r - 1) - (3 - 1) * (c - 1) >= 0 AND (4 - 6) * (r - 3) - (6 - 3) * (c - 6) >= 0 AND (1 - 4) * (r - 6) - (1 - 6) * (c - 4) >= 0) AS in_poly,
  pow(((c - 3.5) * cos(radians(v * 90)) + (r - 3.5) * sin(radians(v * 90))) / 3.3, 2) + pow(((r - 3.5) * cos(radians(v * 90)) - (c - 3.5) * sin(radians(v * 90))) / 1.7, 2) <= 1 AS in_ellipse,
  r >= 2 AND r < 6 AND c >= 2 AND c < 6 AS in_box FROM v_pixels""")
def _(v):
    pt = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    tri = F.array(pt(1, 1), pt(6, 3), pt(4, 6))
    return v.pixels.select(
        "chip_id", "r", "c", "band", P.in_convex_polygon("c", "r", tri).alias("in_poly"),
        P.in_ellipse("c", "r", F.lit(3.5), F.lit(3.5), F.lit(3.3), F.lit(1.7), F.col("v") * 90).alias("in_ellipse"),
        P.in_centre_box("r", "c", 8).alias("in_box"))


@query("h10_concave_mask", """
WITH x AS (SELECT chip_id, r, c, band, c - chip_id % 3 AS x, r AS y, c + v * 4 AS fx FROM v_pixels)
SELECT chip_id, r, c, band, (x >= 0 AND x <= 5 AND y >= 1 AND y <= 2.5) OR (x >= 0 AND x <= 1.5 AND y >= 1 AND y <= 6) AS in_l,
 fx >= 1 AND fx <= 7 AND r >= 1 AND r <= 6 AND NOT (fx > 2.5 AND fx < 5 AND r < 4.5) AS in_u FROM x""")
def _(v):
    """An L that moves with the chip and a U, borders included."""
    pt = lambda x, y: F.struct((F.lit(float(x)) + F.col("chip_id") % 3).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    up = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ell = F.array(*[pt(*p) for p in ((0, 1), (5, 1), (5, 2.5), (1.5, 2.5), (1.5, 6), (0, 6))])
    you = F.array(*[up(*p) for p in ((1, 1), (2.5, 1), (2.5, 4.5), (5, 4.5), (5, 1), (7, 1), (7, 6), (1, 6))])
    return v.pixels.select(
        "chip_id", "r", "c", "band", G.in_polygon("c", "r", ell).alias("in_l"), G.in_polygon(F.col("c") + F.col("v") * 4, "r", you).alias("in_u"))


@query("c9_drop_land_tiles", f"""
WITH {WIN}, a AS (SELECT scene, col0, row0, avg({LAND}) AS land FROM pix GROUP BY ALL)
SELECT det_id FROM win LEFT JOIN a USING (scene, col0, row0) WHERE land IS NULL OR land < 1""")
def _(v):
    mask = v.mosaic.select("scene", "r", "c", P.is_land("occurrence").alias("land"))
    return P.drop_land_tiles(mosaic_windows(v), mask, "scene", "det_id", 16).select("det_id")


@query("c10_drop_cloud_tiles_rgb", """
WITH g AS (SELECT chip_id, 0.299 * b0 * 2000 + 0.587 * b1 * 2000 + 0.114 * b2 * 2000 AS y FROM v_wide),
s AS (SELECT chip_id, avg(y) AS m, var_pop(y) AS vv FROM g GROUP BY chip_id)
SELECT chip_id FROM s WHERE NOT (m > 200 AND vv < 15000)""")
def _(v):
    w = P.wide_pixels(v.pixels).withColumns({b: F.col(b) * 2000 for b in ("b0", "b1", "b2")})
    stats = P.cloud_tile_stats(w, "chip_id", 200.0, 15000.0)
    return P.drop_cloud_tiles_rgb(w.select("chip_id").distinct(), stats, "chip_id")


@query("c11_drop_cloud_tiles_scl", f"""
WITH {WIN}, a AS (SELECT scene, col0, row0, bool_and(cls IN (3, 8, 9, 10)) AS allc FROM pix GROUP BY ALL)
SELECT det_id FROM win LEFT JOIN a USING (scene, col0, row0) WHERE NOT coalesce(allc, false)""")
def _(v):
    return P.drop_cloud_tiles_scl(mosaic_windows(v), v.mosaic, "scene", "det_id", 16).select("det_id")


@query("c13_clear_water", """
SELECT scene, r, c, cls = 6 AS clear, cls = 6 AS clear_any FROM v_mosaic""")
def _(v):
    return v.mosaic.select("scene", "r", "c", P.clear_water("cls").alias("clear"),
                           P.clear_water("cls", shadow=False, cirrus=False).alias("clear_any"))


@query("d4_detections_per_cell", """
SELECT det_id, least(9, greatest(0, trunc(cy / height * 10)::int)) AS grid_row, least(9, greatest(0, trunc(cx / width * 10)::int)) AS grid_col
FROM v_dets JOIN v_scenes USING (scene)""")
def _(v):
    d = v.dets.drop("w", "h").join(v.scenes.select("scene", "width", "height"), "scene")
    return P.detections_per_cell(d, "scene").select("det_id", "grid_row", "grid_col")


GRID = """sz AS (SELECT scene, max(r) + 1 AS h, max(c) + 1 AS w FROM v_mosaic GROUP BY scene),
fr AS (SELECT scene, h, w, gi, gj FROM sz, (SELECT unnest(generate_series(0, 9))::int AS gi) a, (SELECT unnest(generate_series(0, 9))::int AS gj) b),
wat AS (SELECT fr.scene, gi, gj, avg((cls = 6)::int) AS wf FROM fr JOIN v_mosaic m ON m.scene = fr.scene AND m.r >= gi * h // 10 AND m.r < (gi + 1) * h // 10
  AND m.c >= gj * w // 10 AND m.c < (gj + 1) * w // 10 GROUP BY ALL),
dc AS (SELECT scene, least(9, greatest(0, trunc(cy / height * 10)::int)) AS gi, least(9, greatest(0, trunc(cx / width * 10)::int)) AS gj, count(*) AS nd
  FROM v_dets JOIN v_scenes USING (scene) GROUP BY ALL),
grid AS (SELECT scene, gi AS grid_row, gj AS grid_col, coalesce(wf, 0) AS water_fraction, coalesce(nd, 0) AS n_detections FROM fr LEFT JOIN wat USING (scene, gi, gj) LEFT JOIN dc USING (scene, gi, gj))"""


def grid_of(v):
    d = v.dets.drop("w", "h").join(v.scenes.select("scene", "width", "height"), "scene")
    mask = v.mosaic.select("scene", "r", "c", P.clear_water("cls").alias("water"))
    return P.overview_grid(mask, d, "scene"), d


@query("e13_overview_grid", f"WITH {GRID} SELECT scene, grid_row, grid_col, round(water_fraction, 6) AS water_fraction, n_detections FROM grid")
def _(v):
    return rounded(grid_of(v)[0])


@query("e14_tile_feedback", f"""
WITH {GRID} SELECT scene, grid_row, grid_col, CASE WHEN water_fraction <= 0.05 AND n_detections = 0 THEN 'land_empty' WHEN water_fraction <= 0.05 THEN 'land_false_detections'
 WHEN water_fraction >= 0.2 THEN 'mostly_water' END AS feedback FROM grid""")
def _(v):
    return P.tile_feedback(grid_of(v)[0]).select("scene", "grid_row", "grid_col", "feedback")


@query("e14_auto_land_labels", f"""
WITH {GRID}, bad AS (SELECT scene, grid_row, grid_col FROM grid WHERE water_fraction <= 0.05 AND n_detections > 0),
d AS (SELECT det_id, scene, cx, cy, least(9, greatest(0, trunc(cy / height * 10)::int)) AS grid_row, least(9, greatest(0, trunc(cx / width * 10)::int)) AS grid_col FROM v_dets JOIN v_scenes USING (scene)),
lp AS (SELECT DISTINCT {BASE} AS scene, x, y FROM (SELECT tci_path, record_type, cx_full AS x, cy_full AS y FROM v_labels UNION ALL SELECT tci_path, record_type, cx_candidate, cy_candidate FROM v_labels) q
  WHERE (record_type IS NULL OR record_type NOT IN ('vessel_size_feedback','overview_grid_tile')) AND x IS NOT NULL AND y IS NOT NULL)
SELECT det_id, 'land' AS review_category FROM d SEMI JOIN bad USING (scene, grid_row, grid_col)
WHERE NOT EXISTS (SELECT 1 FROM lp WHERE lp.scene = d.scene AND (lp.x - d.cx) * (lp.x - d.cx) + (lp.y - d.cy) * (lp.y - d.cy) <= 9)""")
def _(v):
    grid, d = grid_of(v)
    return P.auto_land_labels(grid, d, v.labels, "scene").select("det_id", "review_category")


@query("e15_rgb_statistics", """
WITH p AS (SELECT chip_id, b0 * 255 AS r, b1 * 255 AS g, b2 * 255 AS b, 0.2126 * b0 * 255 + 0.7152 * b1 * 255 + 0.0722 * b2 * 255 AS y FROM v_wide)
SELECT chip_id, round_even(avg(r), 1) AS mean_r, round_even(avg(g), 1) AS mean_g, round_even(avg(b), 1) AS mean_b, round_even(stddev_pop(r), 1) AS std_r,
 round_even(stddev_pop(g), 1) AS std_g, round_even(stddev_pop(b), 1) AS std_b, round_even(avg(y), 1) AS brightness_mean, round_even(stddev_pop(y), 1) AS brightness_std,
 round_even(stddev_pop(y), 1) AS contrast_rms, round_even((avg(r) - avg(b)) / greatest(avg(b), 1), 4) AS nir_proxy FROM p GROUP BY chip_id""")
def _(v):
    w = P.wide_pixels(v.pixels).withColumns({b: F.col(b) * 255 for b in ("b0", "b1", "b2")})
    return P.rgb_statistics(w, "chip_id")


@query("e16_crop_features", """
WITH p AS (SELECT DISTINCT scene, cx / 2000 * 64 AS x, cy / 2000 * 12 AS y FROM v_dets),
o AS (SELECT i * (2.0::double * 3.0 / 7) - 3.0 AS d FROM (SELECT unnest(generate_series(0, 7)) AS i) t),
s AS (SELECT p.scene, x, y, coalesce(b0, 0) AS b0, coalesce(b1, 0) AS b1, coalesce(b2, 0) AS b2 FROM p CROSS JOIN o ox CROSS JOIN o oy
  LEFT JOIN v_mosaic m ON m.scene = p.scene AND m.c = floor(x + ox.d)::int AND m.r = floor(y + oy.d)::int),
f AS (SELECT scene, x, y, round(avg(b0), 4) AS mean_r, round(avg(b1), 4) AS mean_g, round(avg(b2), 4) AS mean_b, round(stddev_pop(b0), 4) AS std_r,
  round(stddev_pop(b1), 4) AS std_g, round(stddev_pop(b2), 4) AS std_b FROM s GROUP BY ALL)
SELECT det_id, mean_r, mean_g, mean_b, std_r, std_g, std_b FROM v_dets d JOIN f ON f.scene = d.scene AND f.x = d.cx / 2000 * 64 AND f.y = d.cy / 2000 * 12""")
def _(v):
    pts = v.dets.select("det_id", "scene", (F.col("cx") / 2000 * 64).alias("cx"), (F.col("cy") / 2000 * 12).alias("cy"))
    out = P.crop_features(pts, v.mosaic, "scene", "det_id", half=3.0, n=8, block=8)
    return rounded(out.drop("scene", "cx", "cy"), 4)


@query("e17_scl_fractions", f"""
WITH {WIN} SELECT scene, col0, row0, round_even(avg((cls IN (8, 9))::int), 4) AS cloud_fraction, round_even(avg((cls = 10)::int), 4) AS cirrus_fraction,
 round_even(avg((cls = 3)::int), 4) AS shadow_fraction, round_even(avg((cls = 6)::int), 4) AS clear_water_fraction FROM pix GROUP BY ALL""")
def _(v):
    win = mosaic_windows(v).drop("det_id").distinct()
    return P.scl_fractions(P.window_pixels(win, v.mosaic, "scene", 16), ["scene", "col0", "row0"])


@query("e18_cloud_tile_stats", """
WITH g AS (SELECT chip_id, 0.299 * b0 * 2000 + 0.587 * b1 * 2000 + 0.114 * b2 * 2000 AS y FROM v_wide),
s AS (SELECT chip_id, avg(y) AS m, var_pop(y) AS vv FROM g GROUP BY chip_id)
SELECT chip_id, round_even(m, 1) AS brightness_mean, round_even(vv, 1) AS pixel_variance, m > 235 AND vv < 400 AS would_skip,
 round_even(m - 235, 1) AS margin_brightness, round_even(400 - vv, 1) AS margin_variance FROM s""")
def _(v):
    w = P.wide_pixels(v.pixels).withColumns({b: F.col(b) * 2000 for b in ("b0", "b1", "b2")})
    return P.cloud_tile_stats(w, "chip_id")


@query("e19_land_fraction", f"""
WITH {WIN}, a AS (SELECT scene, col0, row0, round_even(avg({LAND}), 4) AS land_fraction FROM pix GROUP BY ALL)
SELECT det_id, land_fraction FROM win LEFT JOIN a USING (scene, col0, row0)""")
def _(v):
    mask = v.mosaic.select("scene", "r", "c", P.is_land("occurrence").alias("land"))
    return P.land_fraction(mosaic_windows(v), mask, "scene", "det_id", 16).select("det_id", "land_fraction")


@query("e25_ocean_score", """
SELECT chip_id, round(least(1, greatest(0, 1.15 * avg(b2 / (b0 + b1 + b2 + 1e-6)) - 0.35 * avg(b1 / (b0 + b1 + b2 + 1e-6)) - 0.2 * avg(b0 / (b0 + b1 + b2 + 1e-6)) + 0.1)), 6) AS ocean_score
FROM v_wide GROUP BY chip_id""")
def _(v):
    return rounded(P.ocean_score(P.wide_pixels(v.pixels), "chip_id"))


@query("e25_ocean_score_grey", """
SELECT scene, round(least(0.35, greatest(0, avg(v * 900) / 255)), 6) AS ocean_score FROM v_mosaic GROUP BY scene""")
def _(v):
    return rounded(P.ocean_score_grey(v.mosaic.withColumn("v", F.col("v") * 900), "scene"))
