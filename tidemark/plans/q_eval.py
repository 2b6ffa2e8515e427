"""Registered queries: evaluation, headings, wakes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import angles as A
from tidemark.functions import labels as L
from tidemark.operators import evaluate as E
from tidemark.plans.q_labels import BASE, Y
from tidemark.plans.registry import query

ANG = "least(((({a}) - ({b})) % 360 + 360) % 360, 360 - ((({a}) - ({b})) % 360 + 360) % 360)"
WAKE = "coalesce(heading_wake_deg, heading_wake_heuristic_deg)"
GT = "heading_deg_from_north"

SCORED = f"scored AS (SELECT ({Y}) AS y, confidence FROM v_labels l JOIN v_scenes s ON s.scene = {BASE} LEFT JOIN v_preds p USING (id) WHERE ({Y}) IS NOT NULL)"
TRUTH = f"""truth AS (SELECT l.id, l.reviewed_at, {GT} AS gt,
 CASE WHEN human_length_m IS NOT NULL AND human_width_m IS NOT NULL THEN human_length_m WHEN graphic_length_m IS NOT NULL AND graphic_width_m IS NOT NULL THEN graphic_length_m
  WHEN estimated_length_m IS NOT NULL AND estimated_width_m IS NOT NULL THEN estimated_length_m END AS gl,
 CASE WHEN human_length_m IS NOT NULL AND human_width_m IS NOT NULL THEN human_width_m WHEN graphic_length_m IS NOT NULL AND graphic_width_m IS NOT NULL THEN graphic_width_m
  WHEN estimated_length_m IS NOT NULL AND estimated_width_m IS NOT NULL THEN estimated_width_m END AS gw,
 CASE WHEN human_length_m IS NOT NULL AND human_width_m IS NOT NULL THEN 'human' WHEN graphic_length_m IS NOT NULL AND graphic_width_m IS NOT NULL THEN 'graphic' ELSE 'estimated' END AS gsrc
 FROM v_labels l JOIN v_scenes s ON s.scene = {BASE} WHERE record_type = 'vessel_size_feedback' AND cx_full IS NOT NULL)"""
ERRS = f"""errs AS (SELECT t.id, gt, gl, gw, gsrc, confidence,
 least({ANG.format(a=WAKE, b='gt')}, {ANG.format(a=WAKE + ' + 180', b='gt')}) AS wake_err,
 {ANG.format(a='heading_keypoint_deg', b='gt')} AS keypoint_err, {ANG.format(a='heading_fused_deg', b='gt')} AS fused_err,
 CASE WHEN gl > 1e-6 THEN abs(p.length_m - gl) / gl END AS length_err, CASE WHEN gw > 1e-6 THEN abs(p.width_m - gw) / gw END AS width_err
 FROM truth t LEFT JOIN v_preds p USING (id))"""
# A null wake axis must not turn into the other side's error.
ERRS = ERRS.replace("least(least(", "least(least(")
F1 = "2.0 * count(*) FILTER (y = 1 AND confidence >= 0.5) / (2.0 * count(*) FILTER (y = 1 AND confidence >= 0.5) + count(*) FILTER (confidence IS NOT NULL AND y <> (confidence >= 0.5)::int))"


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("e1_agreement", f"""
WITH {SCORED}
SELECT count(confidence) AS n_scored, count(*) FILTER (y = (confidence >= 0.5)::int) AS n_correct,
 round(count(*) FILTER (y = (confidence >= 0.5)::int) / count(confidence), 6) AS accuracy, round(({F1})::double, 6) AS f1,
 count(*) FILTER (confidence IS NOT NULL AND y = 1) AS n_vessel, count(*) FILTER (confidence IS NOT NULL AND y = 0) AS n_negative,
 count(*) FILTER (confidence IS NULL) AS n_unscored FROM scored""")
def _(v):
    return rounded(E.agreement(E.scored_labels(v.labels, v.scenes, v.preds), 0.5))


@query("e2_pearson", f"""
WITH {SCORED} SELECT round(corr(confidence, y), 6) AS r, count(*) FILTER (confidence IS NOT NULL AND y IS NOT NULL) AS n FROM scored""")
def _(v):
    return rounded(E.pearson(E.scored_labels(v.labels, v.scenes, v.preds), "confidence", "y"))


@query("e3_spot_heading_errors", f"""
WITH {TRUTH}, {ERRS} SELECT id, round(wake_err, 6) AS wake_err, round(keypoint_err, 6) AS keypoint_err, round(fused_err, 6) AS fused_err FROM errs""")
def _(v):
    e = E.spot_errors(E.geometry_truth(v.labels, v.scenes), v.preds)
    return rounded(e.select("id", "wake_err", "keypoint_err", "fused_err"))


@query("e3_heading_metrics", f"""
WITH {TRUTH}, {ERRS} SELECT round(avg(wake_err), 6) AS wake_mae, count(wake_err) AS wake_n, round(avg(keypoint_err), 6) AS keypoint_mae,
 round(median(keypoint_err), 6) AS keypoint_median, count(keypoint_err) AS keypoint_n, round(avg(fused_err), 6) AS fused_mae, count(fused_err) AS fused_n FROM errs""")
def _(v):
    return rounded(E.heading_metrics(E.spot_errors(E.geometry_truth(v.labels, v.scenes), v.preds)))


@query("e4_size_errors", f"""
WITH {TRUTH}, {ERRS} SELECT round(avg(length_err), 6) AS mean_length_err, count(length_err) AS n_length, round(avg(width_err), 6) AS mean_width_err,
 count(width_err) AS n_width FROM errs""")
def _(v):
    return rounded(E.size_metrics(E.spot_errors(E.geometry_truth(v.labels, v.scenes), v.preds)))


BETTER = """round(100.0::double * count(*) FILTER (keypoint_err + 5 < wake_err) / count(*) FILTER (keypoint_err IS NOT NULL AND wake_err IS NOT NULL), 6) AS pct_keypoint_better,
 count(*) FILTER (keypoint_err IS NOT NULL AND wake_err IS NOT NULL) AS n_keypoint_pairs,
 round(100.0::double * count(*) FILTER (fused_err + 5 < wake_err) / count(*) FILTER (fused_err IS NOT NULL AND wake_err IS NOT NULL), 6) AS pct_fused_better,
 count(*) FILTER (fused_err IS NOT NULL AND wake_err IS NOT NULL) AS n_fused_pairs"""


@query("e5_pct_better", f"WITH {TRUTH}, {ERRS} SELECT {BETTER} FROM errs")
def _(v):
    return rounded(E.pct_better(E.spot_errors(E.geometry_truth(v.labels, v.scenes), v.preds)))


@query("e6_evaluate", f"""
WITH {SCORED}, {TRUTH}, {ERRS}
SELECT a.*, b.* FROM (SELECT count(*) AS n_labelled_points, count(confidence) AS n_scored_points, round(corr(confidence, y), 6) AS pearson_r FROM scored) a,
 (SELECT count(*) AS n_geometry_spots, count(gt) AS n_heading_gt, round(avg(wake_err), 6) AS wake_mae, round(avg(keypoint_err), 6) AS keypoint_mae,
  round(median(keypoint_err), 6) AS keypoint_median, round(avg(fused_err), 6) AS fused_mae, round(avg(length_err), 6) AS mean_length_err,
  round(avg(width_err), 6) AS mean_width_err, NULL::double AS mean_iou, 0::bigint AS n_iou, {BETTER} FROM errs) b""")
def _(v):
    return rounded(E.evaluate(v.labels, v.scenes, v.preds))


PERFORMANCE = f"""
WITH {SCORED}, {TRUTH}, {ERRS}
SELECT b.*, a.* FROM (SELECT round(({F1})::double, 6) AS binary_f1, round(corr(confidence, y), 6) AS pearson_r FROM scored) a,
 (SELECT count(*) AS n_geometry_spots, round(count(*) FILTER (gl > 0 AND gl < 45 AND confidence >= 0.5) / count(*) FILTER (gl > 0 AND gl < 45), 6) AS small_vessel_rate,
  count(*) FILTER (gl > 0 AND gl < 45) AS n_small_vessel, count(*) FILTER (gl > 0 AND gl < 45 AND confidence >= 0.5) AS n_small_detected,
  round(coalesce(avg(fused_err), avg(keypoint_err)), 6) AS heading_mae_deg, round((avg(length_err) + avg(width_err)) / 2, 6) AS mean_size_err FROM errs) b"""


@query("e7_performance_summary", PERFORMANCE)
def _(v):
    return rounded(E.performance_summary(v.labels, v.scenes, v.preds))


RATIO = "coalesce(CASE WHEN graphic_length_m > 0 AND graphic_width_m > 0 THEN greatest(graphic_length_m, graphic_width_m) / least(graphic_length_m, graphic_width_m) END, CASE WHEN estimated_length_m > 0 AND estimated_width_m > 0 THEN greatest(estimated_length_m, estimated_width_m) / least(estimated_length_m, estimated_width_m) END)"


@query("e9_aspect_summary", f"""
WITH r AS (SELECT {RATIO} AS q FROM v_labels WHERE review_category = 'vessel')
SELECT count(q) AS n, round(avg(q), 6) AS mean, round(quantile_cont(q, 0.5), 6) AS median, round(quantile_cont(q, 0.1), 6) AS p10,
 round(quantile_cont(q, 0.9), 6) AS p90 FROM r""")
def _(v):
    rows = v.labels.withColumn("hull_aspect_ratio", L.hull_aspect()["ratio"])
    return rounded(E.aspect_summary(rows))


@query("a13_metrics_json", PERFORMANCE)
def _(v):
    """The report written as JSON text and read back from it."""
    report = E.performance_summary(v.labels, v.scenes, v.preds)
    text = E.metrics_json(report).select(F.from_json("json", report.schema).alias("r"))
    return rounded(text.select("r.*"))


@query("l13_labelled_with_skips", f"""
WITH r AS (SELECT s.scene IS NOT NULL AND cx_full IS NOT NULL AS ok FROM v_labels l LEFT JOIN v_scenes s ON s.scene = {BASE} WHERE ({Y}) IS NOT NULL)
SELECT count(*) FILTER (ok) AS n_points, count(*) FILTER (NOT ok) AS n_skipped FROM r""")
def _(v):
    return E.labelled_with_skips(v.labels, v.scenes)


@query("j5_heading_agreement", f"""
SELECT id, round({ANG.format(a='chroma_heading_deg', b='heading_fused_deg')}, 6) AS diff,
 least({ANG.format(a='chroma_heading_deg', b='heading_fused_deg')}, {ANG.format(a='chroma_heading_deg + 180', b='heading_fused_deg')}) <= 45 AS agrees,
 round((degrees(atan2(chroma_pnr - 3, -(chroma_speed_ms - 5))) + 360 + 360 - 1.25) % 360, 6) AS shift_heading
FROM v_preds""")
def _(v):
    return v.preds.select(
        "id", F.round(A.heading_difference("chroma_heading_deg", "heading_fused_deg"), 6).alias("diff"),
        F.when(F.col("chroma_heading_deg").isNotNull() & F.col("heading_fused_deg").isNotNull(),
               A.headings_agree("chroma_heading_deg", "heading_fused_deg")).alias("agrees"),
        F.round(_shift(), 6).alias("shift_heading"))


def _shift():
    from tidemark.functions.geo import heading_of_shift

    return heading_of_shift(F.col("chroma_pnr") - 3, F.col("chroma_speed_ms") - 5, 1.25)


@query("j7_wake_speed", """
SELECT l_orderkey, l_linenumber, round(distance_m / crests, 6) AS lambda_m, round(sqrt(distance_m / crests * 9.8 / (2 * pi())), 6) AS v_ms,
 round(sqrt(distance_m / crests * 9.8 / (2 * pi())) * 1.94384, 6) AS v_kn FROM v_wakes""")
def _(v):
    w = v.wakes.withColumn("s", A.wake_speed("distance_m", "crests"))
    return w.select("l_orderkey", "l_linenumber", *[F.round(f"s.{c}", 6).alias(c) for c in ("lambda_m", "v_ms", "v_kn")])
