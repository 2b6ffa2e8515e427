"""Evaluation of predictions against labels: long error tables, one-row reports, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import angles as A
from tidemark.functions import labels as L
from tidemark.operators import labels as LB
from tidemark.operators.quantiles import exact_quantiles


def agreement(df: DataFrame, threshold: float) -> DataFrame:
    """Binary agreement of ``y`` with ``confidence >= threshold``; rows without a score are counted apart."""
    scored = F.col("confidence").isNotNull()
    pred = F.when(scored, (F.col("confidence") >= threshold).cast("int"))
    y = F.col("y")
    n = F.count_if(scored)
    tp = F.count_if((y == 1) & (pred == 1))
    wrong = F.count_if(y != pred)
    right = F.count_if(y == pred)
    return df.filter(y.isNotNull()).agg(
        n.alias("n_scored"), right.alias("n_correct"), F.try_divide(right, n).alias("accuracy"),
        F.when(n > 0, F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + wrong), F.lit(0.0))).alias("f1"),
        F.count_if(scored & (y == 1)).alias("n_vessel"), F.count_if(scored & (y == 0)).alias("n_negative"),
        F.count_if(~scored).alias("n_unscored"),
    )


def _pearson(x, y):
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)).cast("double"), F.when(both, F.col(y)).cast("double")
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (sa >= 1e-12) & (sb >= 1e-12), F.covar_pop(a, b) / (sa * sb))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation; null for fewer than two rows or a constant column."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.agg(_pearson(x, y).alias("r"), F.count_if(both).alias("n"))


def geometry_truth(labels: DataFrame, scenes: DataFrame) -> DataFrame:
    """Truth rows from size feedback on known scenes: heading and best size pair with its source."""
    rows = LB.resolve_assets(LB.size_feedback(labels), scenes).filter(
        F.col("resolved_path").isNotNull() & F.col("cx_full").isNotNull() & F.col("cy_full").isNotNull()
    )
    d = L.pick_dims(("human", "graphic", "estimated"))
    return rows.select(
        "id", "image_name", "cx_full", "cy_full", F.col("heading_deg_from_north").alias("gt_heading_deg"),
        d["length_m"].alias("gt_length_m"), d["width_m"].alias("gt_width_m"),
        F.coalesce(d["source"], F.lit("estimated")).alias("gt_source"), "reviewed_at",
    )


def spot_errors(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """One row per spot with every error that can be measured; null where either side is missing."""
    j = truth.join(preds, "id", "left")
    wake = F.coalesce("heading_wake_deg", "heading_wake_heuristic_deg")
    gt = F.col("gt_heading_deg")
    return j.select(
        *truth.columns, "confidence",
        A.wake_line_error(wake, gt).alias("wake_err"),
        A.angular_error("heading_keypoint_deg", gt).alias("keypoint_err"),
        A.angular_error("heading_fused_deg", gt).alias("fused_err"),
        A.rel_dim_error("length_m", "gt_length_m").alias("length_err"),
        A.rel_dim_error("width_m", "gt_width_m").alias("width_err"),
    )


def _better(err: str):
    pair = F.col(err).isNotNull() & F.col("wake_err").isNotNull()
    hits = F.count_if(pair & (F.col(err) + 5.0 < F.col("wake_err")))
    return F.try_divide(100.0 * hits, F.count_if(pair)), F.count_if(pair)


def pct_better(errors: DataFrame) -> DataFrame:
    """Share of spots where a heading beats the wake axis by more than five degrees."""
    kp, n_kp = _better("keypoint_err")
    fu, n_fu = _better("fused_err")
    return errors.agg(
        kp.alias("pct_keypoint_better"), n_kp.alias("n_keypoint_pairs"),
        fu.alias("pct_fused_better"), n_fu.alias("n_fused_pairs"),
    )


def _median(df: DataFrame, column: str):
    """Exact median as a literal, found by counting passes instead of one task that holds every value."""
    return F.lit(exact_quantiles(df, column, [0.5])[0]).cast("double")


def heading_metrics(errors: DataFrame) -> DataFrame:
    """Mean and median heading errors with their counts."""
    return errors.agg(
        F.avg("wake_err").alias("wake_mae"), F.count("wake_err").alias("wake_n"),
        F.avg("keypoint_err").alias("keypoint_mae"), _median(errors, "keypoint_err").alias("keypoint_median"),
        F.count("keypoint_err").alias("keypoint_n"),
        F.avg("fused_err").alias("fused_mae"), F.count("fused_err").alias("fused_n"),
    )


def size_metrics(errors: DataFrame) -> DataFrame:
    return errors.agg(
        F.avg("length_err").alias("mean_length_err"), F.count("length_err").alias("n_length"),
        F.avg("width_err").alias("mean_width_err"), F.count("width_err").alias("n_width"),
    )


def scored_labels(labels: DataFrame, scenes: DataFrame, preds: DataFrame) -> DataFrame:
    """Binary-labelled rows of known scenes with their score."""
    rows = LB.resolve_assets(LB.with_binary_label(labels).filter("y is not null"), scenes)
    return rows.filter(F.col("resolved_path").isNotNull()).join(preds.select("id", "confidence"), "id", "left")


def labelled_with_skips(labels: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row: labelled points usable and skipped because their scene or position is missing."""
    rows = LB.resolve_assets(LB.with_binary_label(labels).filter("y is not null"), scenes)
    ok = F.col("resolved_path").isNotNull() & F.col("cx_full").isNotNull() & F.col("cy_full").isNotNull()
    return rows.agg(F.count_if(ok).alias("n_points"), F.count_if(~ok).alias("n_skipped"))


def evaluate(
    labels: DataFrame, scenes: DataFrame, preds: DataFrame, ious: DataFrame | None = None,
) -> DataFrame:
    """Full report as one row; ``ious`` (id, iou) adds the outline overlap."""
    errors = spot_errors(geometry_truth(labels, scenes), preds)
    if ious is not None:
        errors = errors.join(ious.select("id", "iou"), "id", "left")
    kp, n_kp = _better("keypoint_err")
    fu, n_fu = _better("fused_err")
    iou = F.col("iou") if ious is not None else F.lit(None).cast("double")
    spots = errors.agg(
        F.count("*").alias("n_geometry_spots"), F.count("gt_heading_deg").alias("n_heading_gt"),
        F.avg("wake_err").alias("wake_mae"), F.avg("keypoint_err").alias("keypoint_mae"),
        _median(errors, "keypoint_err").alias("keypoint_median"), F.avg("fused_err").alias("fused_mae"),
        F.avg("length_err").alias("mean_length_err"), F.avg("width_err").alias("mean_width_err"),
        F.avg(iou).alias("mean_iou"), F.count(iou).alias("n_iou"),
        kp.alias("pct_keypoint_better"), n_kp.alias("n_keypoint_pairs"),
        fu.alias("pct_fused_better"), n_fu.alias("n_fused_pairs"),
    )
    points = scored_labels(labels, scenes, preds).agg(
        F.count("*").alias("n_labelled_points"), F.count("confidence").alias("n_scored_points"),
        _pearson("confidence", "y").alias("pearson_r"),
    )
    return points.crossJoin(spots)


def performance_summary(labels: DataFrame, scenes: DataFrame, preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Headline row: small-vessel rate (0 < L < 45 m), heading error, size error, F1, correlation."""
    errors = spot_errors(geometry_truth(labels, scenes), preds)
    small = (F.col("gt_length_m") > 0) & (F.col("gt_length_m") < 45)
    hit = small & (F.col("confidence") >= threshold)
    ml, mw = F.avg("length_err"), F.avg("width_err")
    spots = errors.agg(
        F.count("*").alias("n_geometry_spots"),
        F.try_divide(F.count_if(hit), F.count_if(small)).alias("small_vessel_rate"),
        F.count_if(small).alias("n_small_vessel"), F.count_if(hit).alias("n_small_detected"),
        F.coalesce(F.avg("fused_err"), F.avg("keypoint_err")).alias("heading_mae_deg"),
        F.coalesce((ml + mw) / 2, ml, mw).alias("mean_size_err"),
    )
    scored = scored_labels(labels, scenes, preds)
    f1 = agreement(scored, threshold).select(F.col("f1").alias("binary_f1"))
    r = pearson(scored, "confidence", "y").select(F.col("r").alias("pearson_r"))
    return spots.crossJoin(f1).crossJoin(r)


def aspect_summary(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Spread of stored hull ratios of vessel rows; ``limit`` takes the first in log order."""
    rows = labels.filter((F.col("review_category") == "vessel") & F.col("hull_aspect_ratio").isNotNull())
    if limit is not None:
        rows = rows.orderBy("reviewed_at", "id").limit(limit)
    p10, median, p90 = exact_quantiles(rows, "hull_aspect_ratio", [0.1, 0.5, 0.9])
    lit = lambda v: F.lit(v).cast("double")
    return rows.agg(F.count("*").alias("n"), F.avg("hull_aspect_ratio").alias("mean")).select(
        "n", "mean", lit(median).alias("median"), lit(p10).alias("p10"), lit(p90).alias("p90"))


def metrics_json(report: DataFrame) -> DataFrame:
    """The report row as one JSON text; missing or non-finite values become null."""
    cols = [
        F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c)
        for c, t in report.dtypes
    ]
    return report.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def metrics_markdown(row, digits: int = 4) -> str:
    """Markdown table of one report row (a ``Row`` fetched by the caller)."""
    import math

    def text(x):
        if x is None or (isinstance(x, float) and not math.isfinite(x)):
            return "N/A"
        return f"{x:.{digits}f}" if isinstance(x, float) else str(x)

    lines = ["| Metric | Value |", "| :--- | ---: |"]
    lines += [f"| {k} | {text(v)} |" for k, v in row.asDict().items()]
    return "\n".join(lines)
