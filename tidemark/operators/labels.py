"""Jobs over the curated label table: typed views, counts, filters, patches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels as L


def points(df: DataFrame, newest_first: bool = False) -> DataFrame:
    """Point reviews with a position; sorted only when a listing asks for it."""
    has_xy = F.col("cx_full").isNotNull() & F.col("cy_full").isNotNull()
    out = df.filter(L.is_point("record_type") & has_xy)
    return out.orderBy(F.coalesce("reviewed_at", F.lit("")).desc(), "id") if newest_first else out


def of_record_type(df: DataFrame, record_type: str) -> DataFrame:
    return df.filter(F.col("record_type") == record_type)


def size_feedback(df: DataFrame) -> DataFrame:
    return of_record_type(df, L.SIZE_FEEDBACK)


def grid_tiles(df: DataFrame) -> DataFrame:
    return of_record_type(df, L.GRID_TILE)


def witnesses(df: DataFrame) -> DataFrame:
    return of_record_type(df, L.STATIC_WITNESS)


def with_binary_label(df: DataFrame) -> DataFrame:
    return df.withColumn("y", L.binary_label("record_type", "review_category", "is_vessel"))


def verified_counts(df: DataFrame) -> DataFrame:
    """One row: usable labels, vessels, negatives."""
    return with_binary_label(df).agg(
        F.count("y").alias("total"),
        F.count_if(F.col("y") == 1).alias("n_vessel"),
        F.count_if(F.col("y") == 0).alias("n_negative"),
    )


def resolve_assets(df: DataFrame, scenes: DataFrame) -> DataFrame:
    """Attach the stored scene a label belongs to.

    The full recorded path wins when the catalog knows it, else its base name. ``image_key`` is the
    resolved path, or the lower-case base name for labels whose scene is gone.
    """
    name = L.basename("tci_path")
    by_name = scenes.select(
        F.col("scene").alias("_scene"), F.concat(F.lit("/data/scenes/"), "scene").alias("_path")
    ) if "path" not in scenes.columns else scenes.select(
        F.col("scene").alias("_scene"), F.col("path").alias("_path")
    )
    by_name = by_name.groupBy("_scene").agg(F.min("_path").alias("_path"))
    return (
        df.withColumn("image_name", name)
        .join(by_name, F.col("image_name") == F.col("_scene"), "left")
        .withColumn("resolved_path", F.col("_path"))
        .withColumn("image_key", F.coalesce("_path", F.lower("image_name")))
        .drop("_scene", "_path")
    )


@dataclass
class LabelFilter:
    """Browser filter; an empty set or ``None`` leaves a test off, and so does {"yes", "no"}."""

    categories: frozenset = frozenset()
    text: str = ""
    confidences: frozenset = frozenset()
    length_min: float | None = None
    length_max: float | None = None
    wake: frozenset = frozenset()
    multiple: frozenset = frozenset()
    bridge: frozenset = frozenset()
    cloud: frozenset = frozenset()
    flags: dict = field(
        default_factory=lambda: {
            "wake": "wake_present",
            "multiple": "transhipment_side_by_side",
            "bridge": "has_bridge",
            "cloud": "partial_cloud_obscuration",
        }
    )


def filter_labels(df: DataFrame, spec: LabelFilter) -> DataFrame:
    """Point rows that pass every active test of ``spec``; a missing length fails a length bound."""
    has_xy = F.col("cx_full").isNotNull() & F.col("cy_full").isNotNull()
    out = df.filter(L.is_point("record_type") & has_xy)
    category = F.coalesce(
        F.nullif("review_category", F.lit("")),
        F.when(F.col("is_vessel"), "vessel").when(~F.col("is_vessel"), "water"),
        F.lit(""),
    )
    if spec.categories:
        out = out.filter(category.isin(*spec.categories))
    text = spec.text.strip().lower()
    if text:
        out = out.filter(
            F.lower(L.basename("tci_path")).contains(text) | F.lower("id").contains(text)
        )
    if spec.confidences:
        out = out.filter(L.confidence_bucket("label_confidence").isin(*spec.confidences))
    length = F.coalesce(
        *[F.when(F.col(c) > 0, F.col(c)) for c in ("graphic_length_m", "estimated_length_m")]
    )
    if spec.length_min is not None:
        out = out.filter(length >= spec.length_min)
    if spec.length_max is not None:
        out = out.filter(length <= spec.length_max)
    for name, column in spec.flags.items():
        chosen = getattr(spec, name)
        if len(chosen & {"yes", "no"}) == 1:
            yes = F.coalesce(column, F.lit(False))
            out = out.filter(yes if "yes" in chosen else ~yes)
    return out


def exportable(
    df: DataFrame,
    scenes: DataFrame,
    categories=("vessel",),
    require_dims: bool = False,
    require_confidence: bool = True,
) -> DataFrame:
    """Rows good enough for a report: usable label, wanted category, known scene, set confidence."""
    out = with_binary_label(df).filter(
        F.col("y").isNotNull() & F.col("review_category").isin(*categories)
    )
    if require_confidence:
        out = out.filter(L.confidence_is_set("label_confidence"))
    if require_dims:
        out = out.filter(L.pick_dims().isNotNull())
    return resolve_assets(out, scenes).filter(F.col("resolved_path").isNotNull())


def replace_rows(df: DataFrame, updates: DataFrame) -> DataFrame:
    """Whole-row replacement by id, and ``replaced`` telling which rows changed.

    ``updates`` has the columns of ``df`` and one row per id. Rows of unknown ids are not added.
    """
    names = [c for c in df.columns if c != "id"]
    new = updates.select("id", F.struct(*names).alias("_new"))
    j = df.join(new, "id", "left")
    hit = F.col("_new").isNotNull()
    return j.select(
        "id",
        *[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in names],
        hit.alias("replaced"),
    )


def delete_rows(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def patch_decisions(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Write an accept/reject decision and its cluster key onto rows, keeping earlier ones elsewhere."""
    d = decisions.select(
        "id", F.col("decision").alias("_decision"), F.col("cluster_key").alias("_cluster")
    )
    old = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return (
        df.join(d, "id", "left")
        .withColumn("nomination_status", F.coalesce("_decision", old("nomination_status")))
        .withColumn("nomination_cluster", F.coalesce("_cluster", old("nomination_cluster")))
        .drop("_decision", "_cluster")
    )


def merge_predictions(df: DataFrame, preds: DataFrame, prefix: str = "det_") -> DataFrame:
    """Store every non-null prediction field on its label row; older values stay where none is new."""
    fields = [c for c in preds.columns if c != "id"]
    p = preds.select("id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = df.join(p, "id", "left")
    for c in fields:
        name = f"{prefix}{c}"
        old = F.col(name) if name in df.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(F.col(f"_new_{c}"), old))
    return out.drop(*[f"_new_{c}" for c in fields])


def merge_extra(df: DataFrame, preds: DataFrame, prefix: str = "det_") -> DataFrame:
    """As :func:`merge_predictions`, into a ``map<string,string>`` column ``extra``."""
    fields = [c for c in preds.columns if c != "id"]
    entries = F.map_filter(
        F.create_map(*[x for c in fields for x in (F.lit(prefix + c), F.col(c).cast("string"))]),
        lambda k, v: v.isNotNull(),
    )
    p = preds.select("id", entries.alias("_new"))
    empty = F.create_map().cast("map<string,string>")
    old = F.map_filter(
        F.coalesce("extra", empty), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("_new", empty)), k)
    )
    return df.join(p, "id", "left").withColumn(
        "extra", F.map_concat(old, F.coalesce("_new", empty))
    ).drop("_new")


def labelled_points(df: DataFrame) -> DataFrame:
    """Distinct (image_name, x, y) of saved centres and of the candidates they came from."""
    rows = df.filter(F.col("record_type").isNull() | ~F.col("record_type").isin(L.SIZE_FEEDBACK, L.GRID_TILE))
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    both = F.explode(F.array(at("cx_full", "cy_full"), at("cx_candidate", "cy_candidate"))).alias("p")
    return rows.select(L.basename("tci_path").alias("image_name"), both).select("image_name", "p.*").dropna().distinct()


def grid_feedback_cells(df: DataFrame) -> DataFrame:
    """Distinct overview cells that already carry tile feedback."""
    return (
        grid_tiles(df)
        .select(L.basename("tci_path").alias("image_name"), "grid_row", "grid_col")
        .dropna()
        .distinct()
    )


def recenter_eligible(df: DataFrame) -> DataFrame:
    """Rows whose centre may be recomputed from an outline."""
    finite = [
        F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) >= 0)
        for c in ("cx_full", "cy_full")
    ]
    path = F.col("tci_path").isNotNull() & (F.trim("tci_path") != "")
    tile = F.coalesce(F.col("record_type") == L.GRID_TILE, F.lit(False))
    return df.filter(~tile & finite[0] & finite[1] & path)


def job_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Batch outcome counts per status."""
    return df.groupBy(status).agg(F.count("*").alias("n"))


def vessel_report(df: DataFrame, scenes: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Manifest of exportable vessels: place, time, both hulls with their errors, flags.

    ``scenes`` must carry the georeference columns. ``max_rows`` takes a page in log order.
    """
    from tidemark.functions import geo as G

    rows = exportable(df, scenes, require_dims=True)
    s = scenes.select(
        F.col("scene").alias("image_name"), *[F.col(c) for c in ("epsg", "a", "e", "x0", "y0", "width", "height")]
    )
    rows = G.add_lonlat(rows.drop("lon", "lat").join(s, "image_name"), "cx_full", "cy_full")
    gx, gy = G.ground_metres_per_pixel("cx_full", "cy_full")
    first, second = L.pick_dims(), L.second_hull_dims()
    g = (gx + gy) / 2
    out = rows.select(
        "id", "review_category", "tci_path", "cx_full", "cy_full", "lon", "lat", "reviewed_at", "label_confidence",
        first["length_m"].alias("length_m"), first["width_m"].alias("width_m"),
        second["length_m"].alias("second_length_m"), second["width_m"].alias("second_width_m"),
        F.coalesce(F.col("transhipment_side_by_side"), F.lit(False)).alias("multiple_vessels"),
        g.alias("_g"),
    )
    for c in ("length_m", "width_m", "second_length_m", "second_width_m"):
        out = out.withColumn(f"{c[:-2]}_error_m", L.dim_plus_minus_gsd(c, "_g"))
    out = out.drop("_g")
    return out.orderBy("reviewed_at", "id").limit(max_rows) if max_rows is not None else out
