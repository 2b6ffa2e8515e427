"""Label log in and out: JSON lines to the curated table, and appends of new records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.schemas import EXTRA_FIELDS, LABEL_SCHEMA_VERSION, RECORD_FIELDS


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines of a file, a folder or a glob, with the file each came from."""
    raw = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return raw.filter(F.col("line") != "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``rec``, the parsed document, null for malformed lines and for lines that hold no object."""
    return lines.withColumn("rec", F.when(F.col("line").startswith("{"), F.try_parse_json("line")))


def curate(parsed: DataFrame) -> DataFrame:
    """Typed label rows from parsed lines.

    A value of the wrong type becomes null, as a missing key does. Legacy categories become water. Size
    and heading keys may sit on the record or in ``extra``; the record wins. ``extra`` keeps the rest.
    """
    top = lambda k, t: F.try_variant_get("rec", f"$.{k}", t)
    ext = lambda k, t: F.try_variant_get("rec", f"$.extra.{k}", t)
    cols = {}
    for k, t in RECORD_FIELDS.items():
        cols[k] = top(k, t)
    for k, t in EXTRA_FIELDS.items():
        cols[k] = F.coalesce(cols[k], ext(k, t)) if k in cols else ext(k, t)
    cols["review_category"] = L.current_category(cols["review_category"])
    markers = RECORD_FIELDS["dimension_markers"]
    cols["dimension_markers"] = F.coalesce(top("dimension_markers", markers), ext("dimension_markers", markers))
    cols["has_bridge"] = F.coalesce(F.exists(cols["dimension_markers"], lambda m: m["role"] == "bridge"), F.lit(False))
    cols["extra"] = F.try_variant_get("rec", "$.extra", "variant")
    ts = F.coalesce(cols["reviewed_at"], cols["witnessed_at"])
    cols["reviewed_ts"] = F.try_to_timestamp(ts)
    keep = [c for c in ("file",) if c in parsed.columns]
    return parsed.filter(F.col("rec").isNotNull()).select(*keep, *[c.alias(k) for k, c in cols.items()])


def read_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Curated label rows; blank and malformed lines are left out (see :func:`corrupt_lines`)."""
    return curate(parse_lines(read_lines(spark, path)))


def corrupt_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines :func:`read_labels` leaves out, with their file."""
    return parse_lines(read_lines(spark, path)).filter(F.col("rec").isNull()).select("file", "line")


def count_lines(parsed: DataFrame) -> DataFrame:
    """One row: lines, parsed lines and corrupt lines."""
    return parsed.agg(
        F.count("*").alias("n_lines"), F.count("rec").alias("n_parsed"),
        F.count_if(F.col("rec").isNull()).alias("n_corrupt"),
    )


def ingest_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return count_lines(parse_lines(read_lines(spark, path)))


def _append(df: DataFrame, path: str) -> None:
    """Append JSON lines; keys whose value is null are left out by the writer."""
    df.write.mode("append").json(path)


def _now():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def new_reviews(df: DataFrame, source: str = "review_ui") -> DataFrame:
    """Complete point records from (tci_path, cx_full, cy_full, review_category[, scl_path, extra]).

    An unknown category fails the job, so nothing is half written under a wrong name.
    """
    ok = F.col("review_category").isin(*L.CATEGORIES)
    category = F.when(ok, F.col("review_category")).otherwise(
        F.raise_error(F.concat(F.lit("unknown review_category "), F.coalesce("review_category", F.lit("null"))))
    )
    optional = [c for c in ("scl_path", "extra") if c in df.columns]
    return df.select(
        F.expr("uuid()").alias("id"), F.lit(LABEL_SCHEMA_VERSION).alias("schema_version"), "tci_path",
        F.col("cx_full").cast("double"), F.col("cy_full").cast("double"),
        (category == "vessel").alias("is_vessel"), category.alias("review_category"),
        F.lit(source).alias("source"), _now().alias("reviewed_at"), *optional,
    )


def append_reviews(df: DataFrame, path: str, source: str = "review_ui") -> None:
    _append(new_reviews(df, source), path)


def new_grid_feedback(df: DataFrame) -> DataFrame:
    """Tile-feedback records; the centre is fixed at -1 because a tile is no point."""
    optional = [c for c in ("scl_path",) if c in df.columns]
    notes = F.trim(F.coalesce("notes", F.lit(""))) if "notes" in df.columns else F.lit("")
    return df.select(
        F.expr("uuid()").alias("id"), F.lit(LABEL_SCHEMA_VERSION).alias("schema_version"),
        F.lit(L.GRID_TILE).alias("record_type"), F.lit("overview_grid_feedback").alias("source"), "tci_path",
        F.lit(-1.0).alias("cx_full"), F.lit(-1.0).alias("cy_full"), "feedback_kind",
        *[F.col(c).cast("int") for c in ("grid_row", "grid_col", "grid_divisions")],
        F.col("tile_water_fraction").cast("double"), F.col("tile_detector_count").cast("int"),
        _now().alias("reviewed_at"), F.struct(notes.alias("notes")).alias("extra"), *optional,
    )


def append_grid_feedback(df: DataFrame, path: str) -> None:
    _append(new_grid_feedback(df), path)


SIZE_OPTIONAL = (
    "scl_path", "human_length_m", "human_width_m", "dimension_markers", "graphic_length_m",
    "graphic_width_m", "heading_deg_from_north", "heading_source",
)


def new_size_feedback(df: DataFrame) -> DataFrame:
    """Size-feedback records; optional keys appear only where they hold a value."""
    optional = [F.col(c) for c in SIZE_OPTIONAL if c in df.columns]
    if "transhipment_side_by_side" in df.columns:
        flag = F.col("transhipment_side_by_side")
        optional.append(F.when(flag, flag).alias("transhipment_side_by_side"))
    notes = F.trim(F.coalesce("notes", F.lit(""))) if "notes" in df.columns else F.lit("")
    return df.select(
        F.expr("uuid()").alias("id"), F.lit(L.SIZE_FEEDBACK).alias("record_type"), "tci_path",
        *[F.col(c).cast("double") for c in ("cx_full", "cy_full", "estimated_length_m", "estimated_width_m")],
        "footprint_source", notes.alias("notes"), _now().alias("reviewed_at"),
        F.lit("review_ui").alias("source"), *optional,
    )


def append_size_feedback(df: DataFrame, path: str) -> None:
    _append(new_size_feedback(df), path)


def new_witnesses(df: DataFrame, scenes: DataFrame) -> DataFrame:
    """Sightings of bright spots at sea; rows whose scene gives no position are dropped."""
    from tidemark.operators.scenes import with_lonlat

    rows = with_lonlat(df.withColumn("image_name", L.basename("tci_path")), scenes).filter("lon is not null")
    key = F.concat_ws("_", F.bround("lon", 4).cast("string"), F.bround("lat", 4).cast("string"))
    notes = F.trim(F.coalesce("notes", F.lit(""))) if "notes" in df.columns else F.lit("")
    return rows.select(
        F.expr("uuid()").alias("id"), F.lit(L.STATIC_WITNESS).alias("record_type"), key.alias("cell_key"),
        "lon", "lat", "tci_path", "cx_full", "cy_full", "review_category", _now().alias("witnessed_at"),
        F.struct(notes.alias("notes")).alias("extra"),
    )


def append_witness(df: DataFrame, scenes: DataFrame, path: str) -> None:
    _append(new_witnesses(df, scenes), path)


def read_pseudo_chips(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Unlabelled chips for self-training: position, id (made from place when absent), clamped hint."""
    p = parse_lines(read_lines(spark, path)).filter(F.col("rec").isNotNull())
    get = lambda k, t: F.try_variant_get("rec", f"$.{k}", t)
    rows = p.select(
        get("tci_path", "string").alias("tci_path"), get("cx_full", "double").alias("cx"),
        get("cy_full", "double").alias("cy"), get("id", "string").alias("_id"),
        get("extra.af_export_uncertainty", "double").alias("_u"),
    ).filter("tci_path <> '' and cx is not null and cy is not null")
    made = F.concat(F.lit("pseudo_"), F.pmod(F.xxhash64("tci_path", "cx", "cy"), F.lit(10**9)).cast("string"))
    hint = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_u", F.lit(0.0))))
    return rows.select(
        "tci_path", "cx", "cy", F.coalesce(F.nullif("_id", F.lit("")), made).alias("id"),
        hint.alias("export_uncertainty"),
    )


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a patched label table as a new version folder; the one being read is never overwritten."""
    path = f"{root.rstrip('/')}/v{version:06d}"
    df.write.mode("error").parquet(path)
    return path
