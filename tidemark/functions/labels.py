"""Column expressions over label rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the label log.
CATEGORIES = ("vessel", "water", "cloud", "land", "ambiguous")
LEGACY_WATER = ("not_vessel", "not_a_ship")
GRID_TILE = "overview_grid_tile"
STATIC_WITNESS = "static_sea_witness"
SIZE_FEEDBACK = "vessel_size_feedback"
SPECIAL_RECORDS = (GRID_TILE, STATIC_WITNESS, SIZE_FEEDBACK)
CONFIDENCE_LEVELS = ("high", "medium", "low")
MARKER_ROLES = ("bow", "stern", "end", "side", "bridge", "wake")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    """Last path part; both slash kinds separate."""
    return F.regexp_replace(col(path), r"^.*[/\\]", "")


def current_category(category: Column | str) -> Column:
    """Legacy names become water."""
    c = col(category)
    return F.when(c.isin(*LEGACY_WATER), "water").otherwise(c)


def is_point(record_type: Column | str) -> Column:
    rt = col(record_type)
    return rt.isNull() | ~rt.isin(*SPECIAL_RECORDS)


def effective_category(category: Column | str, is_vessel: Column | str) -> Column:
    """Category text, else the boolean flag, else null."""
    text = F.nullif(F.trim(col(category)), F.lit(""))
    return F.coalesce(
        text, F.when(col(is_vessel), "vessel").when(~col(is_vessel), "water")
    )


def binary_label(record_type: Column | str, category: Column | str, is_vessel: Column | str) -> Column:
    """1 vessel, 0 negative, null unusable; the category wins over the flag."""
    cat = F.nullif(col(category), F.lit(""))
    return (
        F.when(~is_point(record_type) | (cat == "ambiguous"), F.lit(None).cast("int"))
        .when(cat.isNotNull(), (cat == "vessel").cast("int"))
        .otherwise(col(is_vessel).cast("int"))
    )


def label_fingerprint(path: Column | str, x: Column | str, y: Column | str) -> Column:
    """First 20 hex digits of SHA-256 over name and centre at two decimals."""
    fixed = [F.format_string("%.2f", F.bround(col(c), 2)) for c in (x, y)]
    return F.substring(F.sha2(F.concat_ws("|", basename(path), *fixed), 256), 1, 20)


def confidence_is_set(value: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(value))).isin(*CONFIDENCE_LEVELS), F.lit(False))


def confidence_bucket(value: Column | str) -> Column:
    v = col(value)
    return F.when(v.isNull() | (F.trim(v) == ""), "(unset)").otherwise(F.lower(v))


def _pair(length: str, width: str, source: str, positive: bool) -> Column:
    ok = F.col(length).isNotNull() & F.col(width).isNotNull()
    if positive:
        ok = ok & (F.col(length) > 0) & (F.col(width) > 0)
    return F.when(
        ok,
        F.struct(
            F.col(length).cast("double").alias("length_m"),
            F.col(width).cast("double").alias("width_m"),
            F.lit(source).alias("source"),
        ),
    )


def pick_dims(sources: Iterable[str] = ("graphic", "estimated"), positive: bool = False) -> Column:
    """First complete length/width pair as one struct, so values of two sources never mix.

    ``sources`` is the order of preference: graphic then estimated for reports and (with
    ``positive=True``) for clusters; human, graphic, estimated for ground truth.
    """
    return F.coalesce(*[_pair(f"{s}_length_m", f"{s}_width_m", s, positive) for s in sources])


def second_hull_dims() -> Column:
    return _pair("graphic_length_m_hull2", "graphic_width_m_hull2", "graphic", False)


def aspect_ratio(length: Column | str, width: Column | str) -> Column:
    """Longer over shorter side; null unless both are positive."""
    a, b = col(length), col(width)
    short = F.least(a, b)
    return F.when((a > 0) & (b > 0) & (short >= 1e-6), F.greatest(a, b) / short)


def hull_aspect() -> Column:
    """Aspect ratio and its source: marked hull first, else the footprint estimate."""
    graphic = aspect_ratio("graphic_length_m", "graphic_width_m")
    footprint = aspect_ratio("estimated_length_m", "estimated_width_m")
    return F.coalesce(
        F.when(graphic.isNotNull(), F.struct(graphic.alias("ratio"), F.lit("graphic_hull").alias("source"))),
        F.when(
            footprint.isNotNull(),
            F.struct(footprint.alias("ratio"), F.lit("footprint_estimate").alias("source")),
        ),
    )


def dim_plus_minus(value: Column | str) -> Column:
    """Report error of a size in metres: 12 m or 12 %; null for a missing or non-positive size."""
    v = col(value)
    return F.when(v > 0, F.greatest(F.lit(12.0), 0.12 * v))


def dim_plus_minus_gsd(value: Column | str, gsd: Column | str) -> Column:
    """Report error from half a pixel diagonal, 6 % of the size and a 4 m floor."""
    v, g = col(value), F.greatest(col(gsd), F.lit(1e-6))
    return F.when(v > 0, F.greatest(F.lit(4.0), 0.5 * g * (2.0**0.5), 0.06 * v))


def whole_number_text(value: Column | str) -> Column:
    """Half-even whole number as text, as reports print sizes."""
    return F.format_string("%.0f", F.bround(col(value), 0))


def day_key(stamp: Column | str) -> Column:
    """Calendar day of an ISO string; unreadable text is cut to 16 characters."""
    s = F.trim(col(stamp))
    looks_iso = (F.length(s) >= 10) & (F.substring(s, 5, 1) == "-") & (F.substring(s, 8, 1) == "-")
    parsed = F.date_format(F.try_to_timestamp(s), "yyyy-MM-dd")
    return (
        F.when(s.isNull(), "")
        .when(looks_iso, F.substring(s, 1, 10))
        .otherwise(F.coalesce(parsed, F.substring(s, 1, 16)))
    )


def marker_bits(markers: Column | str) -> Column:
    """One 0/1 value per marker role; port or starboard counts as a side."""
    m = F.coalesce(col(markers), F.array())
    def bit(role):
        names = ("side", "port", "starboard") if role == "side" else (role,)
        return F.exists(m, lambda x: x["role"].isin(*names)).cast("double")
    return F.array(*[F.coalesce(bit(r), F.lit(0.0)) for r in MARKER_ROLES])


def run_fingerprint(paths_and_times: Column | str) -> Column:
    """16 hex digits over the ordered ``path:mtime`` lines of ``array<struct<path,mtime>>``."""
    lines = F.transform(
        col(paths_and_times), lambda s: F.concat_ws(":", s["path"], s["mtime"].cast("string"))
    )
    return F.when(
        F.size(lines) > 0, F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 16)
    )
