"""Registered queries: training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pixels as P
from tidemark.operators import training as TR
from tidemark.plans.q_eval import rounded
from tidemark.plans.q_labels import BASE, Y
from tidemark.plans.registry import query

SIG = "(1 / (1 + exp(-({x}))))"
COAST = "(coalesce(coastal_or_land_adjacent, false) OR coalesce(near_coast_proxy, false))"
C = lambda cond, v: f"CASE WHEN {cond} THEN {v} ELSE 0 END"
UNC = "least(1, greatest(0, " + " + ".join([
    C("confidence BETWEEN 0.36 AND 0.64", "0.34::double"), C("partial_cloud_obscuration", "0.2"), C("manual_locator", "0.12"), C("heading_trust < 0.38", "0.16"),
    C("length_m < 62", "0.14"), C(COAST, "0.08"), C("spectral_quality < 0.35", "0.18"), C("fp_spectral_flag", "0.22"), C("spectral_consistency > 0.5", "0.10")]) + "))"
SMALL = "CASE WHEN length_m < 45 THEN 1.0::double WHEN length_m < 90 THEN (90 - length_m) / 90 ELSE 0 END"
PRIO = "least(5.0, greatest(0.45, (CASE WHEN training_priority > 0 THEN least(3, greatest(0.5, training_priority)) ELSE 1.0::double END + " + " + ".join([
    C("confidence BETWEEN 0.38 AND 0.62", "1.15"), C("length_m < 45", "1.25"), C("length_m < 85", "0.95"), C("length_m < 55", "0.55"), C("length_m < 38", "0.4"),
    C("heading_trust < 0.42", "0.55"), C("partial_cloud_obscuration", "0.45"), C("manual_locator", "0.3"), C(COAST, "0.92"), C("cat = 'land'", "0.35"),
    C("cat = 'ambiguous'", "1.85"), C("hd IS NOT NULL", "0.15"), C("fp_spectral_flag", "1.35"),
    "CASE WHEN spectral_quality < 0.3 THEN 0.85 WHEN spectral_quality < 0.45 THEN 0.4 ELSE 0 END"]) + f") * (1 + 0.26::double * {UNC})))"
ROWS = f"""rows_ AS (SELECT l.*, p.* EXCLUDE (id), coalesce(record_type = 'vessel_size_feedback', false) AS sz,
  CASE WHEN coalesce(record_type = 'vessel_size_feedback', false) THEN NULL ELSE review_category END AS cat FROM v_labels l JOIN v_scenes s ON s.scene = {BASE} LEFT JOIN v_preds p USING (id)),
base_ AS (SELECT *, coalesce(NOT sz AND cat IN ('water', 'cloud', 'land'), false) AS neg, coalesce(NOT sz AND cat = 'vessel', false) AS ves FROM rows_),
hd_ AS (SELECT *, CASE WHEN NOT neg AND heading_source NOT IN ('ambiguous_end_end', 'keel_quad_ambiguous') THEN heading_deg_from_north % 360 END AS hd FROM base_ WHERE sz OR neg OR ves),
samples AS (SELECT id, CASE WHEN neg THEN 0.0::double ELSE 1.0 END AS cls, hd AS heading_deg, CASE WHEN neg THEN 0.5::double ELSE {PRIO} END AS al_priority,
  CASE WHEN neg THEN 0.0::double ELSE {UNC} END AS review_uncertainty, CASE WHEN {COAST} THEN 1.0::double ELSE 0 END AS coastal_hint, CASE WHEN neg THEN 0.0::double ELSE {SMALL} END AS small_vessel_hint,
  CASE WHEN ves THEN wake_present::int::double END AS wake_visible, CASE WHEN ves THEN estimated_length_m END AS dim_length_m, CASE WHEN ves THEN estimated_width_m END AS dim_width_m,
  CASE WHEN ves THEN chroma_heading_deg END AS chroma_heading_deg, CASE WHEN ves THEN chroma_pnr END AS chroma_pnr,
  CASE WHEN sz THEN 0 WHEN neg THEN coalesce(CASE human_material_category WHEN 'vessel' THEN 0 WHEN 'cloud' THEN 2 END, CASE cat WHEN 'water' THEN 1 WHEN 'cloud' THEN 2 ELSE -1 END)
   ELSE coalesce(CASE human_material_category WHEN 'vessel' THEN 0 WHEN 'cloud' THEN 2 END, 0) END AS mat_cat_idx FROM hd_)"""


def samples(v):
    return TR.samples(v.labels, v.scenes, v.preds)


@query("l1_samples", f"""WITH {ROWS} SELECT id, cls, heading_deg, round(al_priority, 6) AS al_priority, round(review_uncertainty, 6) AS review_uncertainty, coastal_hint,
 round(small_vessel_hint, 6) AS small_vessel_hint, wake_visible, dim_length_m, dim_width_m, chroma_heading_deg, chroma_pnr, mat_cat_idx FROM samples""")
def _(v):
    s = samples(v).drop("image_name", "resolved_path", "cx", "cy")
    return s.withColumns({c: F.round(c, 6) for c in ("al_priority", "review_uncertainty", "small_vessel_hint")})


@query("l2_review_uncertainty", f"SELECT id, round({UNC}, 6) AS u FROM v_preds JOIN (SELECT id, partial_cloud_obscuration FROM v_labels) l USING (id)")
def _(v):
    d = v.preds.join(v.labels.select("id", "partial_cloud_obscuration"), "id")
    return rounded(d.select("id", TR.review_uncertainty().alias("u")))


@query("l3_hints", f"SELECT id, CASE WHEN {COAST} THEN 1.0::double ELSE 0 END AS coastal, round({SMALL}, 6) AS small FROM v_preds")
def _(v):
    return rounded(v.preds.select("id", TR.coastal_hint().alias("coastal"), TR.small_vessel_hint().alias("small")))


@query("l4_priority", f"SELECT id, round({PRIO}, 6) AS p FROM v_preds JOIN (SELECT id, partial_cloud_obscuration, review_category AS cat, heading_deg_from_north AS hd FROM v_labels) l USING (id)")
def _(v):
    d = v.preds.join(v.labels.select("id", "partial_cloud_obscuration", "review_category", "heading_deg_from_north"), "id")
    return rounded(d.select("id", TR.priority(F.col("heading_deg_from_north").isNotNull(), F.col("review_category")).alias("p")))


WEIGHT = "greatest(al_priority, 0.25) * (1 + 0.13 * least(1, review_uncertainty)) * (1 + 0.22 * coastal_hint) * (1 + 0.18 * small_vessel_hint)"


@query("l5_sampling_weight", f"WITH {ROWS} SELECT id, round(ln({WEIGHT}), 6) AS log_weight FROM samples")
def _(v):
    return rounded(samples(v).select("id", F.ln(TR.sampling_weight()).alias("log_weight")))


@query("l5_weighted_draws")
def _(v):
    return TR.weighted_draws(samples(v).withColumn("weight", TR.sampling_weight()), seed=7, buckets=64)


U = f"(0.52 * (1 - abs(2 * {SIG.format(x='logit')} - 1)) + 0.48 * 4 * {SIG.format(x='hconf')} * (1 - {SIG.format(x='hconf')}))"


@query("l6_model_uncertainty", f"SELECT tile_id, round(least(1, greatest(0, {U})), 6) AS u, round(greatest(0.45, least(5.8, (1 + len_norm * 4) * (1 + 0.72 * least(1, greatest(0, {U}))))), 6) AS merged FROM v_heads")
def _(v):
    d = v.heads.withColumns({"model_u": TR.model_uncertainty(), "al_priority": 1 + F.col("len_norm") * 4})
    return rounded(d.select("tile_id", F.col("model_u").alias("u"), TR.merged_priority().alias("merged")))


@query("l6_heatmap_entropy", """
WITH p AS (SELECT chip_id, least(1 - 1e-5, greatest(1e-5, 1 / (1 + exp(-v)))) AS q FROM v_pixels WHERE band < 8)
SELECT chip_id, round(avg(-(q * ln(q) + (1 - q) * ln(1 - q))) / 0.69314718056, 6) AS entropy FROM p GROUP BY chip_id""")
def _(v):
    from tidemark.plans.q_detect import heatmap_tiles

    return rounded(heatmap_tiles(v).select("chip_id", TR.heatmap_entropy("planes").alias("entropy")))


TRUST = "least(1.0, greatest(0.06, pow(1 - u, 1.08) * pow(p, 1.05))) * greatest(0.42, 1 - 0.35 * e)"


@query("l7_self_training", f"""
WITH x AS (SELECT tile_id AS id, {SIG.format(x='logit')} AS p, least(1, greatest(0, {U})) AS u, wid_norm * 5 AS e0 FROM v_heads), y AS (SELECT *, least(1, greatest(0, e0)) AS e FROM x)
SELECT id, round({TRUST}, 6) AS trust FROM y WHERE p >= 0.7 AND u <= 0.62""")
def _(v):
    d = v.heads.select(F.col("tile_id").alias("id"), _sig("logit").alias("prob"), TR.model_uncertainty().alias("model_u"),
                       (F.col("wid_norm") * 5).alias("export_uncertainty"))
    return rounded(TR.self_training_batch(d).select("id", "trust"))


def _sig(c):
    from tidemark.operators.detect import sigmoid

    return sigmoid(c)


@query("l8_teacher_targets", """
WITH x AS (SELECT id, radians(coalesce(heading_fused_deg, heading_keypoint_deg, heading_wake_deg)) AS h, radians(coalesce(heading_fused_deg, heading_keypoint_deg)) AS w FROM v_preds)
SELECT id, round(sin(h), 6) AS teacher_sin, round(cos(h), 6) AS teacher_cos, CASE WHEN h IS NOT NULL THEN 1.0::double ELSE 0 END AS teacher_valid, round(cos(w), 6) AS wake_cos, round(sin(w), 6) AS wake_sin FROM x""")
def _(v):
    d = TR.teacher_targets(v.preds)
    return rounded(d.select("id", "teacher_sin", "teacher_cos", "teacher_valid", "wake_cos", "wake_sin"))


@query("l9_marker_landmarks", """
WITH x AS (SELECT id, list_filter(markers, lambda m: coalesce(m.hull, 1) <> 2) AS h FROM v_markers),
y AS (SELECT id, list_filter(h, lambda m: m.role = 'bow')[-1] AS b, list_filter(h, lambda m: m.role = 'side') AS s, list_filter(h, lambda m: m.role = 'port')[-1] AS po,
  list_filter(h, lambda m: m.role = 'starboard')[-1] AS st, list_filter(h, lambda m: m.role = 'end') AS e FROM x)
SELECT id, round(coalesce(least(1, greatest(0, b.x / 80)), 0), 6) AS bow_x, CASE WHEN b IS NOT NULL THEN 1.0::double ELSE 0 END AS bow_visible,
 round(coalesce(least(1, greatest(0, CASE WHEN len(s) >= 2 THEN s[-2].y WHEN po IS NOT NULL AND st IS NOT NULL THEN po.y END / 60)), 0), 6) AS side_y,
 CASE WHEN len(e) >= 2 THEN 1.0::double ELSE 0 END AS end_visible FROM y""")
def _(v):
    d = TR.marker_landmarks(v.markers, F.lit(80.0), F.lit(60.0))
    g = lambda i, f: F.get("landmarks", i)[f]
    return rounded(d.select("id", g(0, "x").alias("bow_x"), g(0, "visible").alias("bow_visible"), g(4, "y").alias("side_y"), g(6, "visible").alias("end_visible")))


@query("l10_batch_columns", f"""WITH {ROWS}, x AS (SELECT *, chroma_heading_deg IS NOT NULL AND coalesce(chroma_pnr >= 2.8, false) AS ch FROM samples)
SELECT id, cls, coalesce(heading_deg, 0) AS hdg_deg, (heading_deg IS NOT NULL)::int::double AS hdg_valid, coalesce(wake_visible, 0) AS wake_visible, (wake_visible IS NOT NULL)::int::double AS wake_mask,
 round(coalesce(dim_length_m / 500, 0), 6) AS dim_length, round(coalesce(dim_width_m / 500, 0), 6) AS dim_width, (dim_length_m IS NOT NULL AND dim_width_m IS NOT NULL)::int::double AS dim_mask,
 round(CASE WHEN ch THEN cos(radians(chroma_heading_deg)) ELSE 1 END, 6) AS chroma_cos, round(CASE WHEN ch THEN sin(radians(chroma_heading_deg)) ELSE 0 END, 6) AS chroma_sin,
 ch::int::double AS chroma_valid, mat_cat_idx, (mat_cat_idx >= 0)::int::double AS mat_cat_mask FROM x""")
def _(v):
    return rounded(TR.batch_columns(samples(v)))


@query("l11_turned_headings", f"""WITH {ROWS}, h AS (SELECT id, heading_deg AS h FROM samples),
a AS (SELECT id, f.x AS hf, CASE WHEN f.x THEN (360 - h) % 360 ELSE h END AS h FROM h, (VALUES (false), (true)) f(x)),
b AS (SELECT id, hf, g.x AS vf, CASE WHEN g.x THEN ((180 - h) % 360 + 360) % 360 ELSE h END AS h FROM a, (VALUES (false), (true)) g(x))
SELECT id, hf AS hflip, vf AS vflip, k.x AS quarter_turns, (h + 90 * k.x) % 360 AS heading_deg FROM b, (VALUES (0), (1), (2), (3)) k(x)""")
def _(v):
    t = TR.turned_variants(samples(v).select("id", "heading_deg"))
    return t.select("id", "hflip", "vflip", "quarter_turns", TR.turn_heading().alias("heading_deg"))


@query("l11_turned_pixels", """
WITH a AS (SELECT chip_id, band, r, c, v, f.x AS hf, CASE WHEN f.x THEN 7 - c ELSE c END AS x FROM v_pixels, (VALUES (false), (true)) f(x)),
b AS (SELECT *, g.x AS vf, CASE WHEN g.x THEN 7 - r ELSE r END AS y FROM a, (VALUES (false), (true)) g(x))
SELECT chip_id, band, hf AS hflip, vf AS vflip, k.x AS quarter_turns, CASE k.x WHEN 0 THEN y WHEN 1 THEN b.x WHEN 2 THEN 7 - y ELSE 7 - b.x END AS r, CASE k.x WHEN 0 THEN b.x WHEN 1 THEN 7 - y WHEN 2 THEN 7 - b.x ELSE y END AS c, v
FROM b, (VALUES (0), (1), (2), (3)) k(x)""")
def _(v):
    t = TR.turned_variants(v.pixels).withColumn("q", TR.turn_pixel(8))
    return t.select("chip_id", "band", "hflip", "vflip", "quarter_turns", F.col("q.y").alias("r"), F.col("q.x").alias("c"), "v")


@query("l12_feature_matrix", f"""
WITH r AS (SELECT l.id, ({Y}) AS y, s.scene, cx_full AS x0_, cy_full AS y0_ FROM v_labels l JOIN v_scenes s ON s.scene = {BASE} WHERE ({Y}) IS NOT NULL),
p AS (SELECT DISTINCT scene, x0_, y0_ FROM r), o AS (SELECT i * (2.0::double * 16.0 / 31) - 16.0 AS d FROM (SELECT unnest(generate_series(0, 31)) AS i) t),
s AS (SELECT p.scene, x0_, y0_, coalesce(b0, 0) AS b0, coalesce(b1, 0) AS b1, coalesce(b2, 0) AS b2 FROM p CROSS JOIN o ox CROSS JOIN o oy
  LEFT JOIN v_mosaic m ON m.scene = p.scene AND m.c = floor(x0_ + ox.d)::int AND m.r = floor(y0_ + oy.d)::int),
f AS (SELECT scene, x0_, y0_, round(avg(b0), 4) AS mean_r, round(avg(b1), 4) AS mean_g, round(avg(b2), 4) AS mean_b, round(stddev_pop(b0), 4) AS std_r, round(stddev_pop(b1), 4) AS std_g,
  round(stddev_pop(b2), 4) AS std_b FROM s GROUP BY ALL)
SELECT id, y, mean_r, mean_g, mean_b, std_r, std_g, std_b FROM r JOIN f USING (scene, x0_, y0_)""")
def _(v):
    return rounded(TR.feature_matrix(v.labels, v.scenes, v.mosaic), 4)


@query("l12_chip_vector", "SELECT vec_id, generate_subscripts(spec, 1)::int - 1 AS i, unnest(spec) / 255.0::double AS x FROM v_spectra")
def _(v):
    return v.spectra.select("vec_id", F.posexplode(TR.chip_vector("spec")).alias("i", "x"))


@query("l11_turned_points", """
WITH p AS (SELECT det_id, (cx / 2000)::double AS x, (cy / 2000)::double AS y FROM v_dets),
a AS (SELECT det_id, y, f.x AS hf, CASE WHEN f.x THEN 1 - p.x ELSE p.x END AS x FROM p, (VALUES (false), (true)) f(x)),
b AS (SELECT det_id, hf, a.x, g.x AS vf, CASE WHEN g.x THEN 1 - y ELSE y END AS y FROM a, (VALUES (false), (true)) g(x))
SELECT det_id, hf AS hflip, vf AS vflip, k.x AS quarter_turns, round(CASE k.x WHEN 0 THEN b.x WHEN 1 THEN 1 - y WHEN 2 THEN 1 - b.x ELSE y END, 6) AS x,
 round(CASE k.x WHEN 0 THEN y WHEN 1 THEN b.x WHEN 2 THEN 1 - y ELSE 1 - b.x END, 6) AS y FROM b, (VALUES (0), (1), (2), (3)) k(x)""")
def _(v):
    points = v.dets.select("det_id", (F.col("cx") / 2000).alias("x"), (F.col("cy") / 2000).alias("y"))
    t = TR.turned_variants(points, key="det_id").withColumn("q", TR.turn_point())
    return rounded(t.select("det_id", "hflip", "vflip", "quarter_turns", F.col("q.x").alias("x"), F.col("q.y").alias("y")))


@query("f6_top_by_priority", f"""WITH {ROWS} SELECT id, round(al_priority, 6) AS al_priority FROM samples ORDER BY samples.al_priority DESC, id LIMIT 50""")
def _(v):
    return rounded(TR.top_by_priority(samples(v).select("id", "al_priority"), 50))
