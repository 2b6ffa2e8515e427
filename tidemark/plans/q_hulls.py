"""Registered queries: markers, outlines, headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo as G
from tidemark.functions import labels as L
from tidemark.operators import hulls as H
from tidemark.operators.scenes import with_georeference
from tidemark.plans.q_eval import rounded
from tidemark.plans.q_scenes import DET_BASE, lines_sql
from tidemark.plans.registry import query

H1 = "list_filter(markers, lambda m: coalesce(m.hull, 1) <> 2)"
LAST = "list_filter(h, lambda m: m.role = '{r}')[-1]"
ROLE = "list_filter(h, lambda m: m.role = '{r}')"


@query("b11_marker_bits", """
SELECT id, len(list_filter(markers, lambda m: m.role = 'bow')) > 0 AS bow, len(list_filter(markers, lambda m: m.role = 'end')) > 0 AS end_,
 len(list_filter(markers, lambda m: m.role IN ('side', 'port', 'starboard'))) > 0 AS side, len(list_filter(markers, lambda m: m.role = 'wake')) > 0 AS wake FROM v_markers""")
def _(v):
    b = v.markers.withColumn("b", L.marker_bits("markers"))
    return b.select("id", *[(F.get("b", i) == 1.0).alias(n) for i, n in ((0, "bow"), (2, "end_"), (3, "side"), (5, "wake"))])


@query("f2_marker_choice", f"""
WITH x AS (SELECT id, {H1} AS h FROM v_markers),
y AS (SELECT id, {LAST.format(r='bow')} AS bow, {LAST.format(r='wake')} AS wake, {ROLE.format(r='side')} AS s, {LAST.format(r='port')} AS po, {LAST.format(r='starboard')} AS st,
  {ROLE.format(r='end')} AS e, {ROLE.format(r='wake')} AS w FROM x)
SELECT id, bow.x AS bow_x, wake.y AS wake_y, CASE WHEN len(s) >= 2 THEN s[-2].x WHEN po IS NOT NULL AND st IS NOT NULL THEN po.x END AS side_x,
 CASE WHEN len(s) >= 2 THEN s[-1].y WHEN po IS NOT NULL AND st IS NOT NULL THEN st.y END AS side_y, CASE WHEN len(e) >= 2 THEN e[-1].x END AS end_x,
 CASE WHEN len(w) >= 2 THEN w[1].y END AS line_y FROM y""")
def _(v):
    m = v.markers.withColumn("h", H.for_hull("markers"))
    return m.select(
        "id", H.last_of("h", "bow")["x"].alias("bow_x"), H.last_of("h", "wake")["y"].alias("wake_y"),
        F.get(H.side_pair("h"), 0)["x"].alias("side_x"), F.get(H.side_pair("h"), 1)["y"].alias("side_y"),
        F.get(H.end_pair("h"), 1)["x"].alias("end_x"), F.get(H.wake_line("h"), 0)["y"].alias("line_y"))


def placed(v):
    return with_georeference(v.markers, v.scenes, "scene")


@query("g10_oriented_size", """
WITH x AS (SELECT det_id, w, h, CASE WHEN epsg = 4326 THEN (abs(a) * 111320 * cos(radians(y0 + (round_even(cy, 0) + 0.5) * e)) + abs(e) * 111320) / 2 ELSE (abs(a) + abs(e)) / 2 END AS g
  FROM v_dets d JOIN v_scenes s USING (scene))
SELECT det_id, round(greatest(w, h) * g, 4) AS length_m, round(least(w, h) * g, 4) AS width_m, round(greatest(w, h) / least(w, h), 5) AS aspect FROM x""")
def _(v):
    d = with_georeference(v.dets, v.scenes, "scene")
    t = F.radians(F.col("score") * 180)
    u = lambda a, b: F.struct((F.col("cx") + a * F.cos(t) - b * F.sin(t)).alias("x"), (F.col("cy") + a * F.sin(t) + b * F.cos(t)).alias("y"))
    w, h = F.col("w") / 2, F.col("h") / 2
    d = d.withColumn("polygon", F.array(u(-w, -h), u(w, -h), u(w, h), u(-w, h)))
    d = H.add_oriented_size(d)
    return d.select("det_id", F.round("length_m", 4).alias("length_m"), F.round("width_m", 4).alias("width_m"), F.round("aspect", 5).alias("aspect"))


@query("g11_hull_quad")
def _(v):
    q = H.add_hull_quad(v.markers).select("id", F.posexplode("quad").alias("i", "p"))
    return rounded(q.select("id", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y")))


@query("g11_keel_quad", f"""
WITH x AS (SELECT id, {H1} AS h FROM v_markers), y AS (SELECT id, {LAST.format(r='bow')} AS b, {LAST.format(r='stern')} AS s, {ROLE.format(r='side')} AS d,
 list_filter(h, lambda m: m.role <> 'wake') AS p FROM x),
z AS (SELECT id, b, s, d[-2] AS d0, d[-1] AS d1, greatest(1.5, 0.02 * greatest(list_max(list_transform(p, lambda m: m.x)) - list_min(list_transform(p, lambda m: m.x)),
  list_max(list_transform(p, lambda m: m.y)) - list_min(list_transform(p, lambda m: m.y)))) AS pad, sqrt((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)) AS n FROM y
  WHERE b IS NOT NULL AND s IS NOT NULL AND len(d) >= 2),
q AS (SELECT *, abs(((d1.x - d0.x) * (b.y - s.y) + (d1.y - d0.y) * (s.x - b.x)) / n) AS beam FROM z)
SELECT id, round(n * least(1 + pad / (sqrt(n * n + beam * beam) / 2), 1.2), 5) AS keel_px, round(beam * least(1 + pad / (sqrt(n * n + beam * beam) / 2), 1.2), 5) AS beam_px FROM q""")
def _(v):
    m = v.markers.withColumn("h", H.for_hull("markers"))
    sides = F.size(H.of_role("h", "side")) >= 2
    m = m.filter(H.last_of("h", "bow").isNotNull() & H.last_of("h", "stern").isNotNull() & sides)
    m = H.add_hull_quad(m)
    bow, stern = H.last_of("h", "bow"), H.last_of("h", "stern")
    e = lambda i, j: F.struct((F.get("quad", j)["x"] - F.get("quad", i)["x"]).alias("x"), (F.get("quad", j)["y"] - F.get("quad", i)["y"]).alias("y"))
    m = m.withColumns({"a": e(0, 1), "b": e(1, 2), "kx": bow["x"] - stern["x"], "ky": bow["y"] - stern["y"]})
    par = lambda c: F.abs(F.col(f"{c}.x") * F.col("kx") + F.col(f"{c}.y") * F.col("ky"))
    first = par("a") / F.greatest(F.hypot("a.x", "a.y"), F.lit(1e-9)) >= par("b") / F.greatest(F.hypot("b.x", "b.y"), F.lit(1e-9))
    la, lb = F.hypot("a.x", "a.y"), F.hypot("b.x", "b.y")
    return rounded(m.select("id", F.when(first, la).otherwise(lb).alias("keel_px"), F.when(first, lb).otherwise(la).alias("beam_px")), 5)


@query("g12_keel_heading")
def _(v):
    d = H.add_keel_heading(H.add_hull_quad(placed(v)))
    return rounded(d.select("id", "heading_deg", "heading_alt_deg", "heading_source"), 5)


@query("g13_marker_metrics", f"""
WITH x AS (SELECT m.id, {H1} AS h, m.col_off, m.row_off, s.* FROM v_markers m LEFT JOIN v_scenes s USING (scene)),
y AS (SELECT * EXCLUDE (h), {LAST.format(r='bow')} AS b, {LAST.format(r='stern')} AS s, {LAST.format(r='port')} AS po, {LAST.format(r='starboard')} AS sb, {ROLE.format(r='side')} AS d,
  {ROLE.format(r='end')} AS ends, {LAST.format(r='wake')} AS w, {ROLE.format(r='wake')} AS wl, {LAST.format(r='bridge')} AS br FROM x),
z AS (SELECT *, CASE WHEN b IS NOT NULL AND s IS NOT NULL THEN 'bow_stern' WHEN len(ends) >= 2 THEN 'ambiguous_end_end' WHEN w IS NOT NULL AND s IS NOT NULL THEN 'wake_stern'
  WHEN len(wl) >= 2 THEN 'wake_polyline' WHEN br IS NOT NULL AND b IS NOT NULL THEN 'bridge_bow' END AS src,
  CASE WHEN b IS NOT NULL AND s IS NOT NULL THEN [s.x, s.y, b.x, b.y] WHEN len(ends) >= 2 THEN [ends[-2].x, ends[-2].y, ends[-1].x, ends[-1].y] END AS l1,
  CASE WHEN po IS NOT NULL AND sb IS NOT NULL THEN [po.x, po.y, sb.x, sb.y] WHEN len(d) >= 2 THEN [d[-2].x, d[-2].y, d[-1].x, d[-1].y] END AS l2 FROM y),
both_lines AS (SELECT id, epsg, a, e, x0, y0, col_off, row_off, line, CASE line WHEN 1 THEN l1 ELSE l2 END AS p FROM z, (SELECT unnest([1, 2]) AS line) q),
{lines_sql('col_off + p[1]', 'row_off + p[2]', 'col_off + p[3]', 'row_off + p[4]', 'both_lines')}
SELECT z.id, round(m.metres_, 3) AS length_m, round(n.metres_, 3) AS width_m, CASE WHEN z.epsg IS NOT NULL THEN src END AS heading_source
FROM z JOIN measured m ON m.id = z.id AND m.line = 1 JOIN measured n ON n.id = z.id AND n.line = 2""")
def _(v):
    return rounded(H.add_marker_metrics(placed(v)).select("id", "length_m", "width_m", "heading_source"), 3)


@query("g13_marker_headings")
def _(v):
    return rounded(H.add_marker_metrics(placed(v)).select("id", "heading_deg", "heading_alt_deg", "wake_direction_deg"), 5)


@query("g17_axes")
def _(v):
    p = v.markers.withColumn("polygon", F.transform("markers", lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y"))))
    return rounded(H.add_axes(p).select("id", "edge_deg", "axis_deg"))


@query("g21_quad_sides", f"""
WITH {DET_BASE}, sides AS (SELECT base.*, i, cx + [0, w, w, 0][i] AS px, cy + [0, 0, h, h][i] AS py, cx + [w, w, 0, 0][i] AS qx, cy + [0, h, h, 0][i] AS qy
  FROM base, (SELECT unnest([1, 2, 3, 4]) AS i) q),
{lines_sql('px', 'py', 'qx', 'qy', 'sides')},
pairs AS (SELECT det_id, i % 2 AS way, avg(metres_) AS m FROM measured GROUP BY ALL)
SELECT det_id, round(min(m), 3) AS shorter_m, round(max(m), 3) AS longer_m FROM pairs GROUP BY det_id""")
def _(v):
    d = with_georeference(v.dets, v.scenes, "scene")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z = F.lit(0.0)
    d = d.withColumns({"quad": F.array(pt(z, z), pt(F.col("w"), z), pt(F.col("w"), F.col("h")), pt(z, F.col("h"))),
                       "col_off": F.col("cx"), "row_off": F.col("cy")})
    return rounded(H.add_quad_sides(d).select("det_id", "shorter_m", "longer_m"), 3)


@query("g25_heading_truth", f"""
WITH x AS (SELECT id, l.heading_deg_from_north AS hd, {H1.replace('markers', 'm.markers')} AS h, s.epsg FROM v_labels l JOIN v_markers m USING (id) LEFT JOIN v_scenes s ON s.scene = m.scene)
SELECT id, CASE WHEN hd IS NOT NULL THEN 'heading_deg_from_north' WHEN {LAST.format(r='bow')} IS NOT NULL AND {LAST.format(r='stern')} IS NOT NULL AND epsg IS NOT NULL THEN 'bow_stern_markers' ELSE 'none' END AS gt_heading_source FROM x""")
def _(v):
    d = placed(v).select("id", "markers", "epsg", "a", "e", "x0", "y0", "col_off", "row_off")
    d = d.join(v.labels.select("id", "heading_deg_from_north", "cx_full", "cy_full"), "id")
    d = d.withColumns({"marker_origin_col": F.col("col_off"), "marker_origin_row": F.col("row_off")}).drop("col_off", "row_off")
    return H.add_heading_truth(d).select("id", "gt_heading_source")


@query("d12_polygon_iou", """
WITH x AS (SELECT det_id, w, h, greatest(0, w - abs(w - h) / 2) AS iw, h - h / 4 AS ih FROM v_dets)
SELECT det_id, round(CASE WHEN iw * ih > 0 THEN iw * ih / (2 * w * h - iw * ih) ELSE 0 END, 6) AS iou FROM x""")
def _(v):
    t = F.radians(F.col("score") * 360)
    w, h = F.col("w"), F.col("h")
    pt = lambda a, b: F.struct((F.col("cx") + a * F.cos(t) - b * F.sin(t)).alias("x"), (F.col("cy") + a * F.sin(t) + b * F.cos(t)).alias("y"))
    z = F.lit(0.0)
    s, q = F.abs(w - h) / 2, h / 4
    d = v.dets.withColumns({"pa": F.array(pt(z, z), pt(w, z), pt(w, h), pt(z, h)),
                            "pb": F.array(pt(s, q), pt(s + w, q), pt(s + w, q + h), pt(s, q + h))})
    return rounded(H.add_polygon_iou(d, "pa", "pb").select("det_id", "iou"))


RECTS = {
    # Every outline is a few rectangles that do not overlap: (left, top, right, bottom) in shares of w and h.
    "L": ((0.0, 0.0, 1.0, 0.4), (0.0, 0.4, 0.3, 1.0)),
    "U": ((0.1, 0.2, 0.35, 0.8), (0.35, 0.6, 0.8, 0.8), (0.8, 0.2, 1.1, 0.8)),
}


def _common(scale: str) -> str:
    terms = []
    for l1, t1, r1, b1 in RECTS["L"]:
        for l2, t2, r2, b2 in RECTS["U"]:
            terms.append(f"greatest(0, least({r1} * w, {r2} * w) - greatest({l1} * w, {l2} * w)) * greatest(0, least({b1} * h, {b2} * h {scale}) - greatest({t1} * h, {t2} * h {scale}))")
    return " + ".join(terms)


@query("d12_concave_iou", f"""
WITH x AS (SELECT det_id, ({_common('+ score * h')})::double AS i, (0.58::double + {0.25 * 0.6 + 0.45 * 0.2 + 0.3 * 0.6}::double) * w * h AS u FROM v_dets)
SELECT det_id, round(CASE WHEN i > 0 THEN i / (u - i) ELSE 0 END, 6) AS iou FROM x""")
def _(v):
    """An L and a U that slides along it, both turned by the same angle: turning does not change the overlap."""
    t = F.radians(F.col("score") * 360)
    pt = lambda a, b: F.struct(
        (F.col("cx") + a * F.col("w") * F.cos(t) - (b * F.col("h")) * F.sin(t)).alias("x"),
        (F.col("cy") + a * F.col("w") * F.sin(t) + (b * F.col("h")) * F.cos(t)).alias("y"))
    down = F.col("score")
    ell = [(0, 0), (1, 0), (1, 0.4), (0.3, 0.4), (0.3, 1), (0, 1)]
    you = [(0.1, 0.2), (0.35, 0.2), (0.35, 0.6), (0.8, 0.6), (0.8, 0.2), (1.1, 0.2), (1.1, 0.8), (0.1, 0.8)]
    d = v.dets.withColumns({
        "pa": F.array(*[pt(F.lit(float(a)), F.lit(float(b))) for a, b in ell]),
        "pb": F.array(*[pt(F.lit(float(a)), F.lit(float(b)) + down) for a, b in you])})
    return rounded(G.add_outline_iou(d, "pa", "pb").select("det_id", "iou"))


@query("g20_outline_centres", """
SELECT det_id, CASE det_id % 4 WHEN 0 THEN 'markers' WHEN 1 THEN 'manual' WHEN 2 THEN 'pca' ELSE 'fallback' END AS outline_source,
 CASE WHEN det_id % 4 = 3 THEN (greatest(0, least(47, 30.0 - 4)) + greatest(0, least(47, 30.0 + 4))) / 2 ELSE 10 + w / 2 END + cx AS cx_new,
 CASE WHEN det_id % 4 = 3 THEN (greatest(0, least(31, 20.0 - 4)) + greatest(0, least(31, 20.0 + 4))) / 2 ELSE 5 + h / 2 END + cy AS cy_new FROM v_dets""")
def _(v):
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.lit(10.0), F.lit(5.0)
    quad = F.array(pt(x, y), pt(x + F.col("w"), y), pt(x + F.col("w"), y + F.col("h")), pt(x, y + F.col("h")))
    d = v.dets.withColumns({
        "marker_quad": F.when(F.col("det_id") % 4 == 0, quad), "manual_quad": F.when(F.col("det_id") % 4 == 1, quad),
        "blob_quad": F.when(F.col("det_id") % 4 == 2, quad), "px": F.lit(30.0), "py": F.lit(20.0), "gsd_m": F.lit(10.0),
        "col_off": F.col("cx"), "row_off": F.col("cy"),
    }).drop("w", "h").withColumns({"w": F.lit(48), "h": F.lit(32)})
    return H.outline_centres(d).select("det_id", "outline_source", "cx_new", "cy_new")


@query("g20_recentre_counts", """
WITH s AS (SELECT CASE WHEN record_type = 'overview_grid_tile' THEN 'skipped_record_type' WHEN cx_full IS NULL OR cy_full IS NULL OR cx_full < 0 OR cy_full < 0 THEN 'skipped_invalid_xy'
 WHEN n % 23 = 5 THEN 'missing_file' WHEN wake_present IS NULL THEN 'error' WHEN wake_present THEN 'unchanged' ELSE 'updated' END AS status FROM v_labels)
SELECT status, count(*) AS n FROM s GROUP BY status""")
def _(v):
    from tidemark.operators import labels as LB

    t = v.labels
    c = t.filter("wake_present is not null").select("id", (F.col("cx_full") + F.when(F.col("wake_present"), 0.0).otherwise(1.0)).alias("cx_new"), F.col("cy_full").alias("cy_new"))
    return LB.job_counts(H.recentre(LB.resolve_assets(t, v.scenes), c))
