"""Registered queries: label log, candidates, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import candidates as C
from tidemark.operators import labels as LB
from tidemark.plans.registry import query

POINT = "(record_type IS NULL OR record_type NOT IN ('overview_grid_tile','static_sea_witness','vessel_size_feedback'))"
BASE = "regexp_replace(tci_path, '^.*[/\\\\]', '')"
Y = f"""CASE WHEN NOT {POINT} OR review_category = 'ambiguous' THEN NULL
  WHEN review_category IS NOT NULL AND review_category <> '' THEN CASE WHEN review_category = 'vessel' THEN 1 ELSE 0 END
  ELSE CASE WHEN is_vessel THEN 1 WHEN NOT is_vessel THEN 0 END END"""
CAT = """coalesce(nullif(trim(review_category), ''), CASE WHEN is_vessel THEN 'vessel' WHEN NOT is_vessel THEN 'water' END)"""
CONF_SET = "coalesce(lower(trim(label_confidence)) IN ('high','medium','low'), false)"


@query("a2_typed_views", f"""
SELECT id, CASE WHEN {POINT} THEN 'point' ELSE record_type END AS kind, cx_full, cy_full, reviewed_at
FROM v_labels WHERE NOT {POINT} OR (cx_full IS NOT NULL AND cy_full IS NOT NULL)""")
def _(v):
    t = v.labels
    cols = ["id", "cx_full", "cy_full", "reviewed_at"]
    out = LB.points(t).select(*cols, F.lit("point").alias("kind"))
    for part in (LB.size_feedback(t), LB.grid_tiles(t), LB.witnesses(t)):
        out = out.unionByName(part.select(*cols, F.col("record_type").alias("kind")))
    return out


@query("b1_effective_category", f"SELECT id, {CAT} AS category FROM v_labels")
def _(v):
    return v.labels.select("id", L.effective_category("review_category", "is_vessel").alias("category"))


@query("b2_binary_label", f"SELECT id, {Y} AS y FROM v_labels")
def _(v):
    return LB.with_binary_label(v.labels).select("id", "y")


@query("b3_label_fingerprint", f"""
SELECT id, substr(sha256(concat({BASE}, '|', printf('%.2f', round_even(cx_full, 2)), '|',
  printf('%.2f', round_even(cy_full, 2)))), 1, 20) AS fingerprint FROM v_labels""")
def _(v):
    return v.labels.select("id", L.label_fingerprint("tci_path", "cx_full", "cy_full").alias("fingerprint"))


@query("b4_resolve_assets", f"""
SELECT l.id, {BASE} AS image_name, CASE WHEN s.scene IS NOT NULL THEN concat('/data/scenes/', s.scene) END AS resolved_path,
  coalesce('/data/scenes/' || s.scene, lower({BASE})) AS image_key
FROM v_labels l LEFT JOIN v_scenes s ON s.scene = {BASE}""")
def _(v):
    return LB.resolve_assets(v.labels, v.scenes).select("id", "image_name", "resolved_path", "image_key")


@query("b7_day_key", """
WITH x AS (SELECT id, CASE WHEN n % 3 = 0 THEN replace(reviewed_at, '-', '/') WHEN n % 3 = 1 THEN reviewed_at END AS s FROM v_labels)
SELECT id, CASE WHEN s IS NULL THEN '' WHEN length(trim(s)) >= 10 AND substr(trim(s), 5, 1) = '-' AND substr(trim(s), 8, 1) = '-'
  THEN substr(trim(s), 1, 10) ELSE substr(trim(s), 1, 16) END AS day FROM x""")
def _(v):
    s = F.when(F.col("n") % 3 == 0, F.replace("reviewed_at", F.lit("-"), F.lit("/"))).when(
        F.col("n") % 3 == 1, F.col("reviewed_at"))
    return v.labels.select("id", L.day_key(s).alias("day"))


@query("b8_pick_dims", """
SELECT id,
 CASE WHEN graphic_length_m IS NOT NULL AND graphic_width_m IS NOT NULL THEN graphic_length_m
      WHEN estimated_length_m IS NOT NULL AND estimated_width_m IS NOT NULL THEN estimated_length_m END AS length_m,
 CASE WHEN graphic_length_m IS NOT NULL AND graphic_width_m IS NOT NULL THEN graphic_width_m
      WHEN estimated_length_m IS NOT NULL AND estimated_width_m IS NOT NULL THEN estimated_width_m END AS width_m,
 CASE WHEN graphic_length_m > 0 AND graphic_width_m > 0 THEN graphic_length_m
      WHEN estimated_length_m > 0 AND estimated_width_m > 0 THEN estimated_length_m END AS cluster_length_m,
 CASE WHEN human_length_m IS NOT NULL AND human_width_m IS NOT NULL THEN 'human'
      WHEN graphic_length_m IS NOT NULL AND graphic_width_m IS NOT NULL THEN 'graphic'
      WHEN estimated_length_m IS NOT NULL AND estimated_width_m IS NOT NULL THEN 'estimated' END AS truth_source,
 CASE WHEN graphic_width_m_hull2 IS NOT NULL THEN graphic_length_m_hull2 END AS second_length_m
FROM v_labels""")
def _(v):
    return v.labels.select(
        "id", L.pick_dims()["length_m"].alias("length_m"), L.pick_dims()["width_m"].alias("width_m"),
        L.pick_dims(positive=True)["length_m"].alias("cluster_length_m"),
        L.pick_dims(("human", "graphic", "estimated"))["source"].alias("truth_source"),
        L.second_hull_dims()["length_m"].alias("second_length_m"),
    )


RATIO = "CASE WHEN {l} > 0 AND {w} > 0 AND least({l}, {w}) >= 1e-6 THEN greatest({l}, {w}) / least({l}, {w}) END"
G_RATIO = RATIO.format(l="graphic_length_m", w="graphic_width_m")
E_RATIO = RATIO.format(l="estimated_length_m", w="estimated_width_m")


@query("b9_hull_aspect", f"""
SELECT id, round(coalesce({G_RATIO}, {E_RATIO}), 6) AS ratio,
  CASE WHEN {G_RATIO} IS NOT NULL THEN 'graphic_hull' WHEN {E_RATIO} IS NOT NULL THEN 'footprint_estimate' END AS source
FROM v_labels""")
def _(v):
    a = L.hull_aspect()
    return v.labels.select("id", F.round(a["ratio"], 6).alias("ratio"), a["source"].alias("source"))


@query("b10_size_error", """
SELECT id, round(CASE WHEN estimated_length_m > 0 THEN greatest(12.0, 0.12 * estimated_length_m) END, 6) AS err_m,
  round(CASE WHEN estimated_length_m > 0 THEN greatest(4.0, 0.5 * 10 * sqrt(2.0), 0.06 * estimated_length_m) END, 6) AS err_gsd_m,
  CASE WHEN estimated_length_m > 0 THEN printf('%.0f', round_even(estimated_length_m, 0)) END AS shown
FROM v_labels""")
def _(v):
    e = F.col("estimated_length_m")
    return v.labels.select(
        "id", F.round(L.dim_plus_minus(e), 6).alias("err_m"),
        F.round(L.dim_plus_minus_gsd(e, F.lit(10.0)), 6).alias("err_gsd_m"),
        F.when(e > 0, L.whole_number_text(e)).alias("shown"),
    )


@query("b12_merge_predictions", """
SELECT l.id, p.confidence AS det_confidence, p.length_m AS det_length_m, p.chroma_pnr AS det_chroma_pnr
FROM v_labels l LEFT JOIN v_preds p USING (id)""")
def _(v):
    p = v.preds.select("id", "confidence", "length_m", "chroma_pnr")
    return LB.merge_predictions(v.labels, p).select("id", "det_confidence", "det_length_m", "det_chroma_pnr")


@query("b15_label_confidence", f"""
SELECT id, {CONF_SET} AS is_set, CASE WHEN label_confidence IS NULL OR trim(label_confidence) = '' THEN '(unset)'
  ELSE lower(label_confidence) END AS bucket FROM v_labels""")
def _(v):
    return v.labels.select(
        "id", L.confidence_is_set("label_confidence").alias("is_set"),
        L.confidence_bucket("label_confidence").alias("bucket"))


@query("b16_run_fingerprint", """
SELECT o_custkey, substr(sha256(string_agg(concat('/models/', o_orderkey, ':', cast(epoch_us(o_orderdate) AS bigint)), chr(10)
  ORDER BY o_orderkey)), 1, 16) AS run_id FROM orders GROUP BY o_custkey""")
def _(v):
    files = v.table("orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct(
            "o_orderkey", F.concat(F.lit("/models/"), F.col("o_orderkey").cast("string")).alias("path"),
            F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz")).alias("mtime")))).alias("files"))
    return files.select("o_custkey", L.run_fingerprint("files").alias("run_id"))


@query("c1_verified_counts", f"""
WITH y AS (SELECT {Y} AS y FROM v_labels)
SELECT count(y) AS total, count(*) FILTER (y = 1) AS n_vessel, count(*) FILTER (y = 0) AS n_negative FROM y""")
def _(v):
    return LB.verified_counts(v.labels)


@query("c2_filter_labels", f"""
SELECT id FROM v_labels WHERE {POINT} AND cx_full IS NOT NULL AND cy_full IS NOT NULL
 AND coalesce(nullif(review_category,''), CASE WHEN is_vessel THEN 'vessel' WHEN NOT is_vessel THEN 'water' END, '') IN ('vessel','cloud')
 AND (contains(lower({BASE}), '_t48nu') OR contains(lower(id), '_t48nu'))
 AND (CASE WHEN label_confidence IS NULL OR trim(label_confidence) = '' THEN '(unset)' ELSE lower(label_confidence) END)
     IN ('high','medium','(unset)')
 AND coalesce(CASE WHEN graphic_length_m > 0 THEN graphic_length_m END, CASE WHEN estimated_length_m > 0 THEN estimated_length_m END)
     BETWEEN 30 AND 220
 AND NOT coalesce(wake_present, false)""")
def _(v):
    spec = LB.LabelFilter(
        categories=frozenset({"vessel", "cloud"}), text=" _T48NU", confidences=frozenset({"high", "medium", "(unset)"}),
        length_min=30.0, length_max=220.0, wake=frozenset({"no"}), bridge=frozenset({"yes", "no"}))
    return LB.filter_labels(v.labels, spec).select("id")


EXPORT = f"""({Y}) IS NOT NULL AND review_category = 'vessel' AND {CONF_SET} AND s.scene IS NOT NULL
 AND ((graphic_length_m IS NOT NULL AND graphic_width_m IS NOT NULL) OR (estimated_length_m IS NOT NULL AND estimated_width_m IS NOT NULL))"""


@query("c3_exportable", f"""
SELECT l.id, s.scene AS image_name FROM v_labels l LEFT JOIN v_scenes s ON s.scene = {BASE} WHERE {EXPORT}""")
def _(v):
    return LB.exportable(v.labels, v.scenes, require_dims=True).select("id", "image_name")


LABELLED = f"""(SELECT DISTINCT {BASE} AS scene, x, y FROM (
  SELECT tci_path, record_type, cx_full AS x, cy_full AS y FROM v_labels UNION ALL
  SELECT tci_path, record_type, cx_candidate, cy_candidate FROM v_labels) q
  WHERE (record_type IS NULL OR record_type NOT IN ('vessel_size_feedback','overview_grid_tile')) AND x IS NOT NULL AND y IS NOT NULL)"""


@query("s1_labelled_points", f"SELECT scene AS image_name, x, y FROM {LABELLED} p")
def _(v):
    return LB.labelled_points(v.labels)


@query("s2_grid_feedback_cells", f"""
SELECT DISTINCT {BASE} AS image_name, grid_row, grid_col FROM v_labels
WHERE record_type = 'overview_grid_tile' AND grid_row IS NOT NULL AND grid_col IS NOT NULL""")
def _(v):
    return LB.grid_feedback_cells(v.labels)


@query("c4_unlabelled_candidates", f"""
SELECT det_id, scene, score FROM v_dets d WHERE NOT EXISTS (SELECT 1 FROM {LABELLED} p WHERE p.scene = d.scene
  AND p.x BETWEEN d.cx - 2.5 AND d.cx + 2.5 AND (d.cx-p.x)*(d.cx-p.x) + (d.cy-p.y)*(d.cy-p.y) <= 4)""")
def _(v):
    return C.unlabelled(v.dets, v.labels).select("det_id", "scene", "score")


@query("c5_drop_reviewed_land", f"""
SELECT det_id, scene FROM v_dets d WHERE NOT EXISTS (SELECT 1 FROM v_labels l WHERE review_category = 'land'
  AND {BASE} = d.scene AND (d.cx-cx_full)*(d.cx-cx_full) + (d.cy-cy_full)*(d.cy-cy_full) <= 1024)""")
def _(v):
    return C.drop_reviewed_land(v.dets, v.labels).select("det_id", "scene")


PENDING = """(SELECT n AS det_id, scene, ((n * 7919) % 6000) / 3e0 + 1 AS cx, ((n * 104729) % 14000) / 7e0 AS cy, -1e0 AS score
  FROM v_events JOIN v_scenes USING (k))"""


def pending_picks(v):
    return v.sql(f"SELECT * FROM {PENDING}")


@query("c7_remove_near", f"""
SELECT det_id FROM {PENDING} d WHERE NOT EXISTS (SELECT 1 FROM v_dets p WHERE p.scene = d.scene
  AND (d.cx-p.cx)*(d.cx-p.cx) + (d.cy-p.cy)*(d.cy-p.cy) <= 16)""")
def _(v):
    done = v.dets.select("scene", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return C.remove_near(pending_picks(v), done, 4.0).select("det_id")


@query("c7_add_picks", f"""
SELECT det_id, CASE WHEN EXISTS (SELECT 1 FROM {LABELLED} p WHERE p.scene = d.scene
  AND (d.cx-p.x)*(d.cx-p.x) + (d.cy-p.y)*(d.cy-p.y) <= 4) THEN 'labeled'
 WHEN EXISTS (SELECT 1 FROM {PENDING} p WHERE p.scene = d.scene
  AND (d.cx-p.cx)*(d.cx-p.cx) + (d.cy-p.cy)*(d.cy-p.cy) <= 4) THEN 'duplicate_pending' END AS reason FROM v_dets d""")
def _(v):
    return C.add_picks(pending_picks(v), v.dets, v.labels).select("det_id", "reason")


@query("c8_recenter_eligible", """
SELECT id FROM v_labels WHERE coalesce(record_type, '') <> 'overview_grid_tile' AND isfinite(cx_full) AND isfinite(cy_full)
 AND cx_full >= 0 AND cy_full >= 0 AND trim(tci_path) <> ''""")
def _(v):
    return LB.recenter_eligible(v.labels).select("id")


@query("d1_nearest_size_feedback", f"""
WITH p AS (SELECT det_id, scene, cx, cy FROM v_dets),
f AS (SELECT id, {BASE} AS scene, cx_full, cy_full, heading_deg_from_north FROM v_labels WHERE record_type = 'vessel_size_feedback'),
j AS (SELECT det_id, id, heading_deg_from_north, (cx-cx_full)*(cx-cx_full)+(cy-cy_full)*(cy-cy_full) AS d2
  FROM p JOIN f USING (scene) WHERE (cx-cx_full)*(cx-cx_full)+(cy-cy_full)*(cy-cy_full) <= 1600),
b AS (SELECT det_id, arg_min(id, (d2, id)) AS match_id, min(d2) AS near_d2, arg_min(struct_pack(h := heading_deg_from_north), (d2, id)).h AS heading_deg
  FROM j GROUP BY det_id)
SELECT det_id, match_id, round(near_d2, 6) AS near_d2, heading_deg FROM p LEFT JOIN b USING (det_id)""")
def _(v):
    spots = v.dets.select("det_id", F.col("scene").alias("image_name"), "cx", "cy")
    out = C.size_truth_near(spots, v.labels, 40.0)
    return out.select("det_id", "match_id", F.round("near_d2", 6).alias("near_d2"), "heading_deg")


@query("d2_matched_vessels", f"""
SELECT id, EXISTS (SELECT 1 FROM v_dets d WHERE d.scene = {BASE}
  AND (d.cx-cx_full)*(d.cx-cx_full)+(d.cy-cy_full)*(d.cy-cy_full) <= 96*96) AS matched
FROM v_labels WHERE ({Y}) = 1""")
def _(v):
    return C.tiled_matches(v.labels, v.dets, 96.0).select("id", "matched")


@query("e8_tiled_recall", f"""
WITH r AS (SELECT l.*, ({Y}) AS y, s.scene FROM v_labels l JOIN v_scenes s ON s.scene = {BASE}),
u AS (SELECT y, scene, EXISTS (SELECT 1 FROM v_dets d WHERE d.scene = r.scene
  AND (d.cx-cx_full)*(d.cx-cx_full)+(d.cy-cy_full)*(d.cy-cy_full) <= 96*96) AS hit FROM r WHERE y IS NOT NULL)
SELECT count(*) AS labelled_rows, count(DISTINCT scene) AS unique_scenes, count(*) FILTER (y = 1) AS n_vessel,
 count(*) FILTER (y = 1 AND hit) AS n_matched, count(*) FILTER (y = 1 AND hit) / count(*) FILTER (y = 1) AS recall FROM u""")
def _(v):
    return C.tiled_recall(v.labels, v.scenes, v.dets, 96.0)


@query("d8_replace_rows", """
SELECT l.id, CASE WHEN p.id IS NOT NULL THEN 'water' ELSE review_category END AS review_category,
  CASE WHEN p.id IS NOT NULL THEN cx_full + 1 ELSE cx_full END AS cx_full, p.id IS NOT NULL AS replaced
FROM v_labels l LEFT JOIN (SELECT id FROM v_preds WHERE confidence < 0.2) p USING (id)""")
def _(v):
    t = v.labels.select("id", "review_category", "cx_full")
    up = t.join(v.preds.filter("confidence < 0.2").select("id"), "id", "left_semi")
    up = up.withColumns({"review_category": F.lit("water"), "cx_full": F.col("cx_full") + 1})
    return LB.replace_rows(t, up)


@query("d9_delete_rows", """
SELECT id FROM v_labels WHERE id NOT IN (SELECT id FROM v_preds WHERE confidence < 0.2)""")
def _(v):
    return LB.delete_rows(v.labels, v.preds.filter("confidence < 0.2")).select("id")


@query("d10_patch_decisions", """
SELECT l.id, CASE WHEN confidence > 0.5 THEN 'accepted_ignore' WHEN confidence <= 0.5 THEN 'rejected' END AS nomination_status,
  CASE WHEN confidence IS NOT NULL THEN concat('c', l.id) END AS nomination_cluster
FROM v_labels l LEFT JOIN v_preds p USING (id)""")
def _(v):
    d = v.preds.filter("confidence is not null").select(
        "id", F.when(F.col("confidence") > 0.5, "accepted_ignore").otherwise("rejected").alias("decision"),
        F.concat(F.lit("c"), "id").alias("cluster_key"))
    return LB.patch_decisions(v.labels, d).select("id", "nomination_status", "nomination_cluster")


@query("e24_job_counts", f"""
WITH s AS (SELECT CASE WHEN NOT {POINT} THEN 'skipped' WHEN review_category IS NULL THEN 'errors' ELSE 'updated' END AS status FROM v_labels)
SELECT status, count(*) AS n FROM s GROUP BY status""")
def _(v):
    status = F.when(~L.is_point("record_type"), "skipped").when(F.col("review_category").isNull(), "errors").otherwise("updated")
    return LB.job_counts(v.labels.withColumn("status", status))


DUP_ROWS = f"""(SELECT l.id, {BASE} AS image, cx_full AS x, cy_full AS y, reviewed_at FROM v_labels l
 WHERE {POINT} AND ({CAT}) = 'vessel' AND cx_full IS NOT NULL)"""


GROUPS = f"""r AS MATERIALIZED (SELECT image, x, y, min(id) AS node, count(*) AS copies, min(reviewed_at) AS first_seen FROM {DUP_ROWS} q GROUP BY image, x, y),
e AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM r a JOIN r b ON a.image = b.image AND a.node <> b.node
  AND b.x BETWEEN a.x - 6 AND a.x + 6 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 36),
walk(node, root) AS (SELECT node, node FROM r UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.node),
c AS (SELECT node, min(root) AS g FROM walk GROUP BY node),
s AS (SELECT g, sum(copies)::bigint AS group_rows, min(first_seen) AS group_first_seen FROM c JOIN r USING (node) GROUP BY g HAVING sum(copies) >= 2)"""


@query("d3_duplicate_groups", f"""
WITH RECURSIVE {GROUPS}
SELECT q.id, s.group_rows, s.group_first_seen, s.g AS group_id FROM {DUP_ROWS} q JOIN r ON q.image = r.image AND q.x = r.x AND q.y = r.y
JOIN c ON c.node = r.node JOIN s ON s.g = c.g""")
def _(v):
    return C.duplicate_groups(v.labels, v.scenes).select("id", "group_rows", "group_first_seen", "group_id")


@query("f1_duplicate_listing", f"""
WITH RECURSIVE {GROUPS}, m AS (SELECT s.g AS group_id, any_value(r.image) AS image, sum(copies)::bigint AS n, sum(r.x * copies) / sum(copies) AS mx, sum(r.y * copies) / sum(copies) AS my,
  any_value(s.group_first_seen) AS group_first_seen FROM r JOIN c ON c.node = r.node JOIN s ON s.g = c.g GROUP BY s.g)
SELECT group_id, group_first_seen, concat(image, ' · ', n, ' rows ~(', printf('%.0f', round_even(mx, 0)), ',', printf('%.0f', round_even(my, 0)), ') px · tol 6 px') AS label FROM m""")
def _(v):
    return C.duplicate_group_labels(C.duplicate_groups(v.labels, v.scenes)).orderBy(
        F.col("group_first_seen").desc(), "group_id")


@query("f3_top_unlabelled", f"""
SELECT det_id, scene, score, row_number() OVER (PARTITION BY scene ORDER BY score DESC, det_id)::int AS rank
FROM v_dets d WHERE NOT EXISTS (SELECT 1 FROM {LABELLED} p WHERE p.scene = d.scene
  AND (d.cx-p.x)*(d.cx-p.x) + (d.cy-p.y)*(d.cy-p.y) <= 4) QUALIFY rank <= 15""")
def _(v):
    return C.top_unlabelled(v.dets, v.labels).select("det_id", "scene", "score", "rank")


@query("f3_review_queue")
def _(v):
    return C.review_queue(v.dets, v.labels, pending_picks(v), k=15).select(
        "scene", "det_id", "cx", "cy", "score", "manual", "rank")
