"""Registered queries: decoding, suppression, heading fusion, scene pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators import detect as D
from tidemark.operators import pixels as P
from tidemark.plans.q_eval import ANG, rounded
from tidemark.plans.q_pixels import LAND
from tidemark.plans.registry import query
from tidemark.settings import DetectSettings

SIG = "(1 / (1 + exp(-({x}))))"


@query("k1_decode_heads", f"""
WITH x AS (SELECT *, {SIG.format(x='logit')} AS p FROM v_heads)
SELECT tile_id, round(p, 6) AS confidence, CASE WHEN p >= 0.3 THEN round((degrees(atan2(hs, hc)) + 360) % 360, 6) END AS heading_direct_deg,
 round(CASE WHEN p >= 0.3 THEN {SIG.format(x='hconf')} ELSE 0 END, 6) AS heading_direct_conf, CASE WHEN p >= 0.3 THEN round(wx / greatest(1e-6, sqrt(wx * wx + wy * wy)), 6) END AS wake_dx,
 CASE WHEN p >= 0.3 THEN len_norm END AS length_norm FROM x""")
def _(v):
    d = D.decode_heads(v.heads, threshold=0.3)
    d = d.withColumn("heading_direct_deg", F.pmod(F.round("heading_direct_deg", 6), F.lit(360.0)))
    return d.select("tile_id", *[F.round(c, 6).alias(c) for c in ("confidence", "heading_direct_deg", "heading_direct_conf", "wake_dx")], "length_norm")


@query("k1_proposals", f"SELECT tile_id, round({SIG.format(x='logit')}, 6) AS confidence FROM v_heads WHERE {SIG.format(x='logit')} >= 0.02")
def _(v):
    return rounded(D.decode_heads(v.heads, proposal_floor=0.02).select("tile_id", "confidence"))


def heatmap_tiles(v):
    """Eight 8×8 planes per tile: the first eight bands of each chip, null where one is missing."""
    c = P.stack_bands(v.pixels, fill=False)
    return c.select("chip_id", "h", "w", F.slice("bands", 1, 8).alias("planes"), (F.col("chip_id") * 7).alias("col0"),
                    (F.col("chip_id") * 3).alias("row0"), F.lit(640).alias("tile_w"), F.lit(480).alias("tile_h"))


@query("k2_landmarks", f"""
WITH m AS (SELECT chip_id, band, arg_max(struct_pack(r := r, c := c, v := v), (v, -(r * 8 + c))) AS p FROM (SELECT chip_id, r, c, v, band FROM v_pixels) q WHERE band < 8 GROUP BY chip_id, band)
SELECT chip_id, band, round(chip_id * 7 + p.c / 7.0::double * 640, 6) AS x, round(chip_id * 3 + p.r / 7.0::double * 480, 6) AS y, round({SIG.format(x='p.v')}, 6) AS conf FROM m""")
def _(v):
    t = heatmap_tiles(v).withColumn("lm", D.landmarks_from_heatmaps("planes", "h", "w"))
    return rounded(t.select("chip_id", F.posexplode("lm").alias("band", "p")).filter("p IS NOT NULL").select("chip_id", "band", "p.*"))


def boxed(v):
    x, y, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    return v.dets.withColumns({"x1": x - w / 2, "y1": y - h / 2, "x2": x + w / 2, "y2": y + h / 2})


@query("f5_suppress")
def _(v):
    return D.suppress(boxed(v), 0.3).select("det_id", "scene", "score")


@query("k4_suppress_copies")
def _(v):
    copies = v.heads.select(F.col("tile_id").alias("det_id"), "scene", F.lit(640).alias("tile_w"), F.lit(640).alias("tile_h"),
                            (F.floor(F.col("col0") / 320) * 320).alias("col0"), (F.floor(F.col("row0") / 320) * 320).alias("row0"),
                            D.sigmoid("logit").alias("score"))
    return D.suppress(D.with_boxes(copies, None), 0.45).select("det_id", "scene", F.round("score", 6).alias("score"))


@query("k5_finalise", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, det_id)::int AS rank FROM v_dets),
land AS (SELECT scene, r, c FROM v_mosaic WHERE ({LAND}) = 1)
SELECT det_id, scene, rank FROM r WHERE score >= 0.5 AND NOT EXISTS (SELECT 1 FROM land l WHERE l.scene = r.scene AND l.r = round_even(((cy - h / 2) + (cy + h / 2)) / 2, 0) AND l.c = round_even(((cx - w / 2) + (cx + w / 2)) / 2, 0))""")
def _(v):
    land = v.mosaic.select("scene", "r", "c", P.is_land("occurrence").alias("land"))
    return D.finalise(boxed(v), land, threshold=0.5).select("det_id", "scene", "rank")


FUSE = """x AS (SELECT id, CASE WHEN n % 4 = 1 THEN heading_keypoint_deg END AS k, CASE WHEN n % 7 <> 2 THEN ((n * 29) % 360)::double END AS a, CASE WHEN n % 3 = 0 THEN heading_wake_deg END AS w,
 chroma_heading_deg AS c, chroma_pnr AS p, CASE WHEN n % 2 = 0 THEN heading_fused_deg END AS m, heading_trust AS mc, CASE WHEN n % 5 = 2 THEN heading_wake_heuristic_deg END AS mk
 FROM (SELECT *, cast(substr(id, 2) AS bigint) AS n FROM v_preds) q),
y AS (SELECT *, (a + 180) % 360 AS b, (w + 180) % 360 AS bow FROM x)"""
PICK = "CASE WHEN least(abs(a - {t}), 360 - abs(a - {t})) <= least(abs(b - {t}), 360 - abs(b - {t})) THEN a ELSE b END"
FUSED = f"""z AS (SELECT *, CASE WHEN k IS NOT NULL THEN k WHEN a IS NOT NULL AND w IS NOT NULL THEN {PICK.format(t='bow')} WHEN a IS NOT NULL AND p >= 4 AND c IS NOT NULL THEN {PICK.format(t='c')}
 WHEN a IS NOT NULL AND m IS NOT NULL AND mc >= 0.6 THEN {PICK.format(t='m')} ELSE a END AS fused_deg,
 CASE WHEN k IS NOT NULL THEN 'structures' WHEN a IS NOT NULL AND w IS NOT NULL THEN 'hull_wake_disambiguated' WHEN a IS NOT NULL AND p >= 4 AND c IS NOT NULL THEN 'hull_chroma_disambiguated'
 WHEN a IS NOT NULL AND m IS NOT NULL AND mc >= 0.6 THEN 'hull_model_disambiguated' WHEN a IS NOT NULL THEN 'hull_axis_ambiguous' ELSE 'none' END AS fused_source FROM y)"""


def fusion_input(v):
    n = F.substring("id", 2, 20).cast("bigint")
    p = v.preds.withColumn("n", n)
    n = F.col("n")
    return p.select(
        "id", F.when(n % 4 == 1, F.col("heading_keypoint_deg")).alias("heading_keypoint_deg"),
        F.when(n % 7 != 2, ((n * 29) % 360).cast("double")).alias("hull_axis_deg"),
        F.when(n % 3 == 0, F.col("heading_wake_deg")).alias("wake_side_deg"), "chroma_heading_deg", "chroma_pnr",
        F.when(n % 2 == 0, F.col("heading_fused_deg")).alias("heading_direct_deg"), F.col("heading_trust").alias("heading_direct_conf"),
        F.when(n % 5 == 2, F.col("heading_wake_heuristic_deg")).alias("heading_deg_from_north"))


@query("k6_fuse_heading", f"WITH {FUSE}, {FUSED} SELECT id, fused_deg, fused_source FROM z")
def _(v):
    return fusion_input(v).select("id", D.fuse_heading().alias("f")).select(
        "id", F.col("f.heading_deg").alias("fused_deg"), F.col("f.source").alias("fused_source"))


@query("k7_shown_heading", f"""WITH {FUSE}, {FUSED}, d AS (SELECT *, {ANG.format(a='a', b='c')} AS da, {ANG.format(a='b', b='c')} AS db FROM z)
SELECT id, coalesce(CASE WHEN fused_source = 'hull_axis_ambiguous' THEN CASE WHEN p >= 2 AND da <= 45 AND da < db THEN a WHEN p >= 2 AND db <= 45 AND db < da THEN b END ELSE fused_deg END, mk) AS shown_deg FROM d""")
def _(v):
    d = fusion_input(v).withColumn("f", D.fuse_heading()).withColumns({"fused_deg": F.col("f.heading_deg"), "fused_source": F.col("f.source")})
    return d.select("id", D.shown_heading().alias("shown_deg"))


SETTINGS = DetectSettings(chip_half=320, threshold=0.05)


def land_mask(v):
    return v.mosaic.select("scene", "r", "c", P.is_land("occurrence").alias("land"))


MOSAIC_TILES = f"""sz AS (SELECT scene, max(c) + 1 AS width, max(r) + 1 AS height FROM v_mosaic GROUP BY scene),
t0 AS (SELECT scene, width, unnest(list_distinct(list_append(generate_series(0, greatest(0, height - 16), 8), greatest(0, height - 16))))::int AS row0 FROM sz),
t AS (SELECT scene, row0, unnest(list_distinct(list_append(generate_series(0, greatest(0, width - 16), 8), greatest(0, width - 16))))::int AS col0 FROM t0),
tiles AS (SELECT t.scene, row0, col0, avg({LAND}) AS land, bool_and(cls IN (3, 8, 9, 10)) AS cloud FROM t LEFT JOIN v_mosaic m ON m.scene = t.scene AND m.r >= row0 AND m.r < row0 + 16
  AND m.c >= col0 AND m.c < col0 + 16 GROUP BY ALL)"""


@query("k8_tiles_to_scan", f"WITH {MOSAIC_TILES} SELECT scene, row0, col0, CASE WHEN land >= 1 THEN 'land' WHEN cloud THEN 'cloud' END AS skipped FROM tiles")
def _(v):
    s = v.mosaic.groupBy("scene").agg((F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"))
    t = D.tiles_to_scan(s, land_mask(v), v.mosaic.select("scene", "r", "c", "cls"), DetectSettings(chip_half=8, block=16))
    return t.select("scene", "row0", "col0", "skipped")


@query("k8_scene_queue")
def _(v):
    return D.scene_queue(v.heads, v.labels, SETTINGS, land_mask(v)).select("scene", "tile_id", "cx", "cy", F.round("score", 6).alias("score"), "rank")


@query("k8_scene_counters", f"""
WITH {MOSAIC_TILES}, d AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, det_id) AS rank FROM v_dets),
f AS (SELECT det_id, scene, ((cx - w / 2) + (cx + w / 2)) / 2 AS x, ((cy - h / 2) + (cy + h / 2)) / 2 AS y FROM d WHERE score >= 0.05),
n AS (SELECT scene, count(*) AS detections, count(*) FILTER (EXISTS (SELECT 1 FROM v_labels l WHERE review_category = 'land' AND regexp_replace(tci_path, '^.*[/\\\\]', '') = f.scene
  AND (x - cx_full) * (x - cx_full) + (y - cy_full) * (y - cy_full) <= 1024)) AS land_review_rejected FROM f GROUP BY scene)
SELECT t.scene, count(*) AS tiles, count(*) FILTER (land >= 1) AS land_skipped, 0::bigint AS cloud_skipped, coalesce(any_value(n.detections), 0) AS detections,
 coalesce(any_value(n.land_review_rejected), 0) AS land_review_rejected FROM tiles t LEFT JOIN n USING (scene) GROUP BY t.scene""")
def _(v):
    s = v.mosaic.groupBy("scene").agg((F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"))
    t = D.tiles_to_scan(s, land_mask(v), None, DetectSettings(chip_half=8, block=16))
    found = D.finalise(boxed(v))
    return D.scene_counters(t, found, C.drop_reviewed_land(found, v.labels))


@query("k9_spot_records", f"""
WITH {FUSE}, {FUSED} SELECT z.id, fused_deg AS det_fused_deg, fused_source AS det_fused_source, confidence AS det_confidence, b AS det_hull_axis_alt_deg,
 CASE WHEN c IS NOT NULL AND fused_deg IS NOT NULL THEN least({ANG.format(a='c', b='fused_deg')}, {ANG.format(a='c + 180', b='fused_deg')}) <= 45 END AS det_chroma_agrees
FROM z JOIN v_preds p USING (id)""")
def _(v):
    spots = v.preds.select("id")
    parts = {"geometry": fusion_input(v), "scores": v.preds.select("id", "confidence", "length_m", "width_m")}
    r = D.spot_records(spots, parts)
    return r.select("id", "det_fused_deg", "det_fused_source", "det_confidence", "det_hull_axis_alt_deg", "det_chroma_agrees")
