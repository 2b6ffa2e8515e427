"""Candidate lists per scene: reviewed and labelled ones drop out, the rest becomes a queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import labels as LB
from tidemark.operators import spatial as S

MANUAL_SCORE = -1.0


def unlabelled(cands: DataFrame, labels: DataFrame, tol: float = 2.0, *, image: str = "scene") -> DataFrame:
    """Candidates with no labelled point of their image within ``tol`` pixels."""
    return S.without_near(cands, LB.labelled_points(labels), tol, image=image)


def land_points(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("review_category") == "land").select(
        L.basename("tci_path").alias("image_name"), F.col("cx_full").alias("x"), F.col("cy_full").alias("y")
    )


def drop_reviewed_land(dets: DataFrame, labels: DataFrame, radius: float = 32.0, *, image: str = "scene") -> DataFrame:
    """Detections away from every point a reviewer called land."""
    return S.without_near(dets, land_points(labels), radius, image=image)


def remove_near(pending: DataFrame, done: DataFrame, tol: float = 2.0, *, image: str = "scene") -> DataFrame:
    """Pending picks that are not within ``tol`` of a point just handled (image, x, y)."""
    return S.without_near(pending, done, tol, image=image, point_image=image)


def add_picks(
    pending: DataFrame, picks: DataFrame, labels: DataFrame, tol: float = 2.0, *, image: str = "scene"
) -> DataFrame:
    """Judge new picks: ``reason`` is null when one may join the queue, else why it is skipped.

    Picks are judged against labels and against what is already pending. Picks of one call that lie near
    each other are settled by :func:`review_queue`, which deduplicates in order.
    """
    out = S.with_near_flag(picks, LB.labelled_points(labels), tol, "_labelled", image=image)
    out = S.with_near_flag(
        out, pending.select(image, F.col("cx").alias("x"), F.col("cy").alias("y")), tol, "_pending",
        image=image, point_image=image,
    )
    return out.withColumn(
        "reason", F.when(F.col("_labelled"), "labeled").when(F.col("_pending"), "duplicate_pending")
    ).drop("_labelled", "_pending")


def review_queue(
    dets: DataFrame, labels: DataFrame, pending: DataFrame | None = None, *, k: int | None = None,
    tol: float = 2.0, image: str = "scene", id_col: str = "det_id",
) -> DataFrame:
    """Queue per scene: unlabelled manual picks, then detections, near-equal ones once, at most ``k`` automatic.

    Detections come by score descending, then id, numbered by ``rank`` from 1; manual picks have no rank
    and come first. Only the automatic part is ranked, so the limit cuts rows before the shuffle.
    """
    cols = [image, id_col, "cx", "cy", "score"]
    both = dets.select(*cols).withColumn("manual", F.lit(False))
    if pending is not None:
        both = both.unionByName(pending.select(*cols).withColumn("manual", F.lit(True)))
    fresh = unlabelled(both, labels, tol, image=image)
    order = [(~F.col("manual")).alias("m"), -F.col("score"), F.col(id_col)]
    kept = S.greedy_keep(fresh, image=image, order=order, point=("cx", "cy"), radius=tol)
    w = W.partitionBy(image).orderBy(F.col("score").desc(), id_col)
    top = kept.filter(~F.col("manual")).withColumn("rank", F.row_number().over(w))
    if k is not None:
        top = top.filter(F.col("rank") <= k)
    if pending is None:
        return top
    return top.unionByName(kept.filter("manual").withColumn("rank", F.lit(None).cast("int")))


def top_unlabelled(
    cands: DataFrame, labels: DataFrame, k: int = 15, tol: float = 2.0, *, image: str = "scene",
    id_col: str = "det_id",
) -> DataFrame:
    """Best ``k`` unlabelled candidates per scene, without the near-equal test."""
    w = W.partitionBy(image).orderBy(F.col("score").desc(), id_col)
    return (
        unlabelled(cands, labels, tol, image=image)
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    )


def duplicate_rows(labels: DataFrame, scenes: DataFrame, tol: float = 6.0, categories=("vessel",)) -> DataFrame:
    """Label rows that take part in near-duplicate search, with their image key."""
    rows = labels.filter(
        L.is_point("record_type") & F.col("id").isNotNull() & (F.col("id") != "")
        & F.col("tci_path").isNotNull() & (F.trim("tci_path") != "")
        & F.col("cx_full").isNotNull() & F.col("cy_full").isNotNull()
    ).withColumn("category", L.effective_category("review_category", "is_vessel"))
    rows = rows.filter(F.col("category").isNotNull())
    if categories is not None:
        rows = rows.filter(F.col("category").isin(*categories))
    return LB.resolve_assets(rows, scenes)


def duplicate_groups(labels: DataFrame, scenes: DataFrame, tol: float = 6.0, categories=("vessel",)) -> DataFrame:
    """Members of near-duplicate groups of at least two labels.

    One row per member with its group's size, earliest time and mean position. A listing sorts by
    ``group_first_seen desc, group_key, reviewed_at, id``: newest groups first, oldest members first.
    """
    rows = duplicate_rows(labels, scenes, tol, categories)
    grouped = S.near_groups(rows, tol)
    spots = grouped.groupBy("image_key", "group_key", "cx_full", "cy_full").agg(
        F.count("*").alias("copies"), F.min(F.coalesce("reviewed_at", F.lit(""))).alias("seen"),
        F.min("id").alias("id"), F.min("image_name").alias("image_name"),
    )
    stats = spots.groupBy("image_key", "group_key").agg(
        F.sum("copies").alias("group_rows"), F.min("seen").alias("group_first_seen"),
        _weighted_mean("cx_full").alias("group_x"), _weighted_mean("cy_full").alias("group_y"),
        F.min("id").alias("group_id"), F.min("image_name").alias("group_image"),
    ).filter("group_rows >= 2")
    return grouped.join(stats, ["image_key", "group_key"])


def _weighted_mean(c: str) -> Column:
    """Mean of positions by their copies, the same in any order of the rows.

    Two numbers add up to the same in either order. More of them are added as decimals, which do not depend on the
    order, unless one is out of their range.
    """
    part = F.col(c) * F.col("copies")
    fixed = part.try_cast("decimal(28,15)")
    exact = (F.count("*") > 2) & (F.count(fixed) == F.count("*"))
    return F.when(exact, F.sum(fixed).cast("double")).otherwise(F.sum(part)) / F.sum("copies")


def duplicate_group_labels(groups: DataFrame, tol: float = 6.0) -> DataFrame:
    """One line of text per group for a chooser."""
    one = groups.select(
        "group_id", "group_image", "group_rows", "group_x", "group_y", "group_first_seen"
    ).distinct()
    return one.select(
        "group_id", "group_first_seen",
        F.format_string(
            f"%s · %d rows ~(%s,%s) px · tol {tol:g} px", "group_image", "group_rows",
            L.whole_number_text("group_x"), L.whole_number_text("group_y"),
        ).alias("label"),
    )


def size_truth_near(spots: DataFrame, labels: DataFrame, tol: float = 4.0, *, image: str = "image_name") -> DataFrame:
    """Heading truth of the size-feedback row nearest each spot, if one lies within ``tol``.

    A nearest row without a heading leaves the spot without truth.
    """
    rows = LB.size_feedback(labels).select(
        L.basename("tci_path").alias("image_name"), "id", F.col("cx_full").alias("x"),
        F.col("cy_full").alias("y"), "heading_deg_from_north",
    )
    out = S.nearest_within(spots, rows, tol, image=image)
    return out.select(
        *spots.columns, F.col("near.id").alias("match_id"), "near_d2",
        F.col("near.heading_deg_from_north").alias("heading_deg"),
    )


def tiled_matches(labels: DataFrame, dets: DataFrame, radius: float = 96.0, *, image: str = "scene") -> DataFrame:
    """Vessel labels with ``matched``: does any detection of the scene lie within ``radius``?"""
    vessels = LB.with_binary_label(labels).filter("y = 1").withColumn("image_name", L.basename("tci_path"))
    return S.with_near_flag(
        vessels, dets.select(F.col(image).alias("image_name"), F.col("cx").alias("x"), F.col("cy").alias("y")),
        radius, "matched", x="cx_full", y="cy_full",
    )


def tiled_recall(labels: DataFrame, scenes: DataFrame, dets: DataFrame, radius: float = 96.0) -> DataFrame:
    """One row: scenes with labels, vessel labels, matched ones and their share."""
    usable = LB.with_binary_label(labels).filter("y is not null")
    # Counted by path first, so that the side which meets the listing has one row per image.
    paths = LB.resolve_assets(usable.groupBy("tci_path").agg(F.count("*").alias("n")), scenes)
    n_scenes = paths.filter(F.col("resolved_path").isNotNull()).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("labelled_rows"), F.count_distinct("image_name").alias("unique_scenes")
    )
    rows = LB.resolve_assets(usable, scenes).filter(F.col("resolved_path").isNotNull())
    hits = tiled_matches(rows.drop("y", "image_name", "image_key", "resolved_path"), dets, radius).agg(
        F.count("*").alias("n_vessel"), F.count_if("matched").alias("n_matched")
    )
    return n_scenes.crossJoin(hits).withColumn("recall", F.try_divide(F.col("n_matched"), F.col("n_vessel")))
