"""Registered queries: the log as text, chip keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.plans.q_labels import BASE, Y
from tidemark.plans.registry import query
from tidemark.sources import labels as SL
from tidemark.sources import scenes as SS
from tidemark.session import shared_folder
from tidemark.streaming import labels as ST


def log_lines(v, reviewed_at="reviewed_at", *more):
    """Log text made from the labels, with ``more`` of their columns: one in nine lines is cut off, water carries its old name."""
    cat = F.when(F.col("review_category") == "water", "not_vessel").otherwise(F.col("review_category"))
    extra = F.struct("label_confidence", "estimated_length_m", F.when(F.col("n") % 4 == 0, F.lit("wide")).otherwise(
        F.col("estimated_width_m").cast("string")).alias("estimated_width_m"), "wake_present")
    doc = F.to_json(F.struct("id", "record_type", "tci_path", "cx_full", "cy_full", "is_vessel", cat.alias("review_category"), L.col(reviewed_at).alias("reviewed_at"), *more, extra.alias("extra")))
    cut = F.when(F.col("n") % 9 == 4, F.substring(doc, 1, 25)).when(F.col("n") % 9 == 5, F.lit("[1, 2]")).otherwise(doc)
    return v.labels.select("n", cut.alias("line"))


def new_folder(v, name):
    """A new folder beside the other intermediate tables, which all executors share."""
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_read_labels", """
SELECT id, review_category, cx_full, is_vessel, label_confidence, estimated_length_m, CASE WHEN n % 4 <> 0 THEN estimated_width_m END AS estimated_width_m, wake_present
FROM v_labels WHERE n % 9 NOT IN (4, 5)""")
def _(v):
    return SL.curate(SL.parse_lines(log_lines(v))).select(
        "id", "review_category", "cx_full", "is_vessel", "label_confidence", "estimated_length_m", "estimated_width_m", "wake_present")


@query("a1_ingest_counts", """
SELECT count(*) AS n_lines, count(*) FILTER (n % 9 NOT IN (4, 5)) AS n_parsed, count(*) FILTER (n % 9 IN (4, 5)) AS n_corrupt FROM v_labels""")
def _(v):
    return SL.count_lines(SL.parse_lines(log_lines(v)))


@query("a11_chip_keys", f"""
SELECT id, concat(regexp_replace({BASE}, '\\.[^.]*$', ''), '_', substr(sha256(tci_path), 1, 12)) AS scene_key,
 substr(sha256(concat(printf('%.2f', round_even(cx_full, 2)), '|', printf('%.2f', round_even(cy_full, 2)), '|48|64')), 1, 16) AS chip_key FROM v_labels""")
def _(v):
    return SS.with_chip_keys(v.labels).select("id", "scene_key", "chip_key")


@query("a11_missing_chips", f"""
WITH k AS (SELECT id, tci_path, printf('%.2f', round_even(cx_full, 2)) AS x, printf('%.2f', round_even(cy_full, 2)) AS y, confidence FROM v_labels JOIN v_preds USING (id)),
h AS (SELECT DISTINCT tci_path, x, y FROM k WHERE confidence >= 0.4)
SELECT count(*) AS n_missing FROM (SELECT DISTINCT tci_path, x, y FROM k) w ANTI JOIN h USING (tci_path, x, y)""")
def _(v):
    k = SS.with_chip_keys(v.labels)
    have = k.join(v.preds.filter("confidence >= 0.4").select("id"), "id", "left_semi")
    return SS.missing_chips(k, have).agg(F.count("*").alias("n_missing"))


@query("a3_read_lines", """
SELECT id, review_category, cx_full FROM v_labels WHERE n % 9 NOT IN (4, 5)""")
def _(v):
    folder = new_folder(v, "log")
    log_lines(v).select("line").write.text(folder)
    return SL.read_labels(v.spark, folder).select("id", "review_category", "cx_full")


@query("a4_append_reviews", """
SELECT tci_path, cx_full, cy_full, review_category, review_category = 'vessel' AS is_vessel, 'review_ui' AS source
FROM v_labels WHERE review_category IS NOT NULL AND cx_full IS NOT NULL""")
def _(v):
    folder = new_folder(v, "reviews")
    new = v.labels.filter("review_category is not null and cx_full is not null").select("tci_path", "cx_full", "cy_full", "review_category")
    SL.append_reviews(new, folder)
    return SL.read_labels(v.spark, folder).select("tci_path", "cx_full", "cy_full", "review_category", "is_vessel", "source")


@query("a5_append_grid_feedback", """
SELECT tci_path, 'overview_grid_tile' AS record_type, -1.0::double AS cx_full, (n % 10)::int AS grid_row, (n % 7)::int AS grid_col, 10::int AS grid_divisions FROM v_labels""")
def _(v):
    folder = new_folder(v, "tiles")
    n = F.col("n")
    SL.append_grid_feedback(v.labels.select(
        "tci_path", (n % 10).alias("grid_row"), (n % 7).alias("grid_col"), F.lit(10).alias("grid_divisions"), F.lit("land_empty").alias("feedback_kind"),
        F.lit(0.25).alias("tile_water_fraction"), F.lit(3).alias("tile_detector_count"), F.lit(" seen ").alias("notes")), folder)
    return SL.read_labels(v.spark, folder).select("tci_path", "record_type", "cx_full", "grid_row", "grid_col", "grid_divisions")


@query("a6_append_size_feedback", """
SELECT tci_path, cx_full, cy_full, (n % 200)::double AS estimated_length_m, (n % 40)::double AS estimated_width_m, CASE WHEN n % 3 = 0 THEN (n % 190)::double END AS human_length_m,
 CASE WHEN n % 5 = 0 THEN true END AS transhipment_side_by_side FROM v_labels WHERE cx_full IS NOT NULL""")
def _(v):
    folder = new_folder(v, "sizes")
    n = F.col("n")
    SL.append_size_feedback(v.labels.filter("cx_full is not null").select(
        "tci_path", "cx_full", "cy_full", (n % 200).alias("estimated_length_m"), (n % 40).alias("estimated_width_m"), F.lit("markers").alias("footprint_source"),
        F.when(n % 3 == 0, (n % 190).cast("double")).alias("human_length_m"), (n % 5 == 0).alias("transhipment_side_by_side")), folder)
    return SL.read_labels(v.spark, folder).select(
        "tci_path", "cx_full", "cy_full", "estimated_length_m", "estimated_width_m", "human_length_m", "transhipment_side_by_side")


@query("a7_append_witness", f"""
SELECT l.tci_path, cx_full, cy_full, review_category FROM v_labels l JOIN v_scenes s ON s.scene = {BASE} WHERE cx_full IS NOT NULL AND epsg IS NOT NULL""")
def _(v):
    folder = new_folder(v, "witnesses")
    SL.append_witness(v.labels.filter("cx_full is not null").select("tci_path", "cx_full", "cy_full", "review_category"), v.scenes, folder)
    return SL.read_labels(v.spark, folder).select("tci_path", "cx_full", "cy_full", "review_category")


@query("a15_pseudo_chips", """
SELECT concat('s', det_id % 7) AS tci_path, cx, cy, CASE WHEN det_id % 2 = 0 THEN concat('p', det_id) ELSE 'made' END AS id,
 greatest(0, least(1, det_id % 3 - 0.5))::double AS export_uncertainty FROM v_dets WHERE det_id % 11 <> 0""")
def _(v):
    folder = new_folder(v, "chips")
    i = F.col("det_id")
    doc = F.struct(
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("s"), i % 7)).alias("tci_path"), F.col("cx").alias("cx_full"), F.col("cy").alias("cy_full"),
        F.when(i % 2 == 0, F.concat(F.lit("p"), i)).alias("id"), F.struct((i % 3 - 0.5).cast("double").alias("af_export_uncertainty")).alias("extra"))
    v.dets.select(F.to_json(doc).alias("value")).write.text(folder)
    made = F.when(F.col("id").rlike("^pseudo_[0-9]+$"), "made").otherwise(F.col("id"))
    return SL.read_pseudo_chips(v.spark, folder).withColumn("id", made)


@query("t1_stream_labels", """
SELECT id, review_category, cx_full, label_confidence, CASE WHEN n % 7 <> 0 THEN reviewed_at END AS reviewed_at FROM v_labels WHERE n % 9 NOT IN (4, 5)""")
def _(v):
    """Three batches: the newest rows first, then older ones, then the rest with repeats; undated rows in each."""
    log, table, checkpoint = (new_folder(v, name) for name in ("stream-log", "stream-table", "stream-state"))
    lines = log_lines(v, F.when(F.col("n") % 7 != 0, F.col("reviewed_at")))
    for rows in ("n % 3 = 2", "n % 3 = 1", "n % 3 = 0 or n % 5 = 0"):
        lines.filter(rows).select("line").write.mode("append").text(log)
        ST.run_curation(v.spark, log, table, checkpoint).awaitTermination()
    return v.spark.read.parquet(table).select("id", "review_category", "cx_full", "label_confidence", "reviewed_at")


def counted(v, counts):
    """Changes that ``counts`` left in its table after three rounds of log, curation and counting; a fifth of the ids repeat."""
    log, table, seen, target, checkpoint = (new_folder(v, f"counts-{name}") for name in ("log", "table", "seen", "target", "state"))
    lines = log_lines(v, "reviewed_at", "lon", "lat")
    for rows in ("n % 3 = 2", "n % 3 = 1", "n % 3 = 0 or n % 5 = 0"):
        lines.filter(rows).select("line").write.mode("append").text(log)
        ST.run_curation(v.spark, log, table, seen).awaitTermination()
        ST.run_counts(v.spark, table, target, checkpoint, counts).awaitTermination()
    return v.spark.read.parquet(target)


@query("t1_running_counts", f"""
WITH y AS (SELECT {Y} AS y FROM v_labels WHERE n % 9 NOT IN (4, 5))
SELECT count(y) AS total, count(*) FILTER (y = 1) AS n_vessel, count(*) FILTER (y = 0) AS n_negative FROM y""")
def _(v):
    return ST.latest(counted(v, ST.running_counts), [])


@query("t1_running_cells", """
SELECT round_even(lon, 4) AS cell_lon, round_even(lat, 4) AS cell_lat, count(*) AS hits
FROM v_labels WHERE n % 9 NOT IN (4, 5) AND record_type = 'static_sea_witness' AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2""")
def _(v):
    return ST.latest(counted(v, ST.running_static_cells), ["cell_lon", "cell_lat"])
