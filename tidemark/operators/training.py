"""Training tables: samples with targets and masks, priorities, draws, expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.functions.labels import col
from tidemark.operators import hulls as H
from tidemark.operators import labels as LB
from tidemark.session import cut_lineage

# Heading sources that leave the bow open, and class numbers of the material head.
AMBIGUOUS_HEADINGS = ("ambiguous_end_end", "keel_quad_ambiguous")
MATERIAL_CLASS = {"vessel": 0, "water": 1, "not_vessel": 1, "not_a_ship": 1, "cloud": 2}
SIZE_NORM_M = 500.0
CHROMA_MIN_PNR = 2.8


def _add(*terms: Column) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + F.coalesce(t, F.lit(0.0))
    return out


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def coastal_hint() -> Column:
    yes = F.coalesce("coastal_or_land_adjacent", F.lit(False)) | F.coalesce("near_coast_proxy", F.lit(False))
    return F.when(yes, 1.0).otherwise(0.0)


def small_vessel_hint(length="length_m") -> Column:
    """1 below 45 m, falling ramp to 90 m, 0 beyond or unknown."""
    v = col(length)
    return F.when(v < 45.0, 1.0).when(v < 90.0, _clip((90.0 - v) / 90.0, 0.0, 1.0)).otherwise(0.0)


def review_uncertainty() -> Column:
    """How doubtful a reviewed row looked, 0 to 1, from what the reviewer saw."""
    c = F.col("confidence")
    u = _add(
        F.when(c.between(0.36, 0.64), 0.34), F.when(F.col("partial_cloud_obscuration"), 0.2),
        F.when(F.col("manual_locator"), 0.12), F.when(F.col("heading_trust") < 0.38, 0.16),
        F.when(F.col("length_m") < 62.0, 0.14), F.when(coastal_hint() > 0, 0.08),
        F.when(F.col("spectral_quality") < 0.35, 0.18), F.when(F.col("fp_spectral_flag"), 0.22),
        F.when(F.col("spectral_consistency") > 0.5, 0.10),
    )
    return _clip(u, 0.0, 1.0)


def priority(heading_labelled: Column, category: Column) -> Column:
    """Sampling priority of a row, 0.45 to 5: a stored boost, then what makes the row hard or rare."""
    boost = F.when(F.col("training_priority") > 0, _clip(F.col("training_priority"), 0.5, 3.0)).otherwise(1.0)
    ln, q = F.col("length_m"), F.col("spectral_quality")
    p = boost + _add(
        F.when(F.col("confidence").between(0.38, 0.62), 1.15),
        F.when(ln < 45.0, 1.25), F.when(ln < 85.0, 0.95), F.when(ln < 55.0, 0.55), F.when(ln < 38.0, 0.4),
        F.when(F.col("heading_trust") < 0.42, 0.55), F.when(F.col("partial_cloud_obscuration"), 0.45),
        F.when(F.col("manual_locator"), 0.3), F.when(coastal_hint() > 0, 0.92),
        F.when(category == "land", 0.35), F.when(category == "ambiguous", 1.85), F.when(heading_labelled, 0.15),
        F.when(F.col("fp_spectral_flag"), 1.35), F.when(q < 0.3, 0.85).when(q < 0.45, 0.4),
    )
    return _clip(p * (1.0 + 0.26 * review_uncertainty()), 0.45, 5.0)


def samples(labels: DataFrame, scenes: DataFrame, preds: DataFrame) -> DataFrame:
    """Supervised samples from the log: size rows and vessels (1), water, cloud and land (0).

    ``preds`` are the stored prediction fields per id. Headings whose source leaves the bow open are
    dropped. Rows without a scene or a position make no sample.
    """
    have = set(labels.columns)
    extra = [c for c in preds.columns if c == "id" or c not in have]
    rows = LB.resolve_assets(labels, scenes).filter(
        F.col("resolved_path").isNotNull() & F.col("cx_full").isNotNull() & F.col("cy_full").isNotNull()
    ).join(preds.select(*extra), "id", "left")
    size = F.coalesce(F.col("record_type") == L.SIZE_FEEDBACK, F.lit(False))
    cat = F.when(size, F.lit(None).cast("string")).otherwise(L.current_category("review_category"))
    rows = rows.withColumns({"_size": size, "_cat": cat})
    neg = ~F.col("_size") & F.col("_cat").isin("water", "cloud", "land")
    ves = ~F.col("_size") & (F.col("_cat") == "vessel")
    rows = rows.filter(F.col("_size") | F.coalesce(neg, F.lit(False)) | F.coalesce(ves, F.lit(False)))
    neg, ves = F.coalesce(neg, F.lit(False)), F.coalesce(ves, F.lit(False))
    heading = F.when(
        ~neg & ~F.coalesce(F.col("heading_source").isin(*AMBIGUOUS_HEADINGS), F.lit(False)),
        F.pmod(F.col("heading_deg_from_north"), F.lit(360.0)),
    )
    class_of = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in MATERIAL_CLASS.items()])
    human = class_of(F.col("human_material_category"))
    material = F.when(F.col("_size"), 0).when(neg, F.coalesce(human, class_of(F.col("_cat")), F.lit(-1))).otherwise(
        F.coalesce(human, F.lit(0)))
    prio = F.when(neg, 0.5).otherwise(priority(heading.isNotNull(), F.col("_cat")))
    keep = lambda c: F.when(ves, c)
    return rows.select(
        "id", "image_name", "resolved_path", F.col("cx_full").alias("cx"), F.col("cy_full").alias("cy"),
        F.when(neg, 0.0).otherwise(1.0).alias("cls"), heading.alias("heading_deg"), prio.alias("al_priority"),
        F.when(neg, 0.0).otherwise(review_uncertainty()).alias("review_uncertainty"),
        coastal_hint().alias("coastal_hint"), F.when(neg, 0.0).otherwise(small_vessel_hint()).alias("small_vessel_hint"),
        keep(F.col("wake_present").cast("double")).alias("wake_visible"),
        keep(F.col("estimated_length_m")).alias("dim_length_m"), keep(F.col("estimated_width_m")).alias("dim_width_m"),
        keep(F.col("chroma_heading_deg")).alias("chroma_heading_deg"), keep(F.col("chroma_pnr")).alias("chroma_pnr"),
        material.alias("mat_cat_idx"),
    )


def sampling_weight() -> Column:
    return (
        F.greatest(F.col("al_priority"), F.lit(0.25)) * (1.0 + 0.13 * F.least(F.lit(1.0), F.col("review_uncertainty")))
        * (1.0 + 0.22 * F.col("coastal_hint")) * (1.0 + 0.18 * F.col("small_vessel_hint"))
    )


def weighted_draws(df: DataFrame, seed: int, key: str = "id", weight: str = "weight", buckets: int = 1024) -> DataFrame:
    """As many draws with replacement as there are rows, in proportion to ``weight``: key and times drawn.

    Rows are dealt to ``buckets`` by the hash of their key. The number of draws per bucket follows from the
    bucket weights, a table of that many numbers; the draws themselves are made and matched bucket by
    bucket, so neither running sums nor draws pass through one task. The same seed repeats the same draw:
    bucket weights are summed as decimals, whatever the order of rows. Rows never drawn are absent.
    """
    import numpy as np

    spark = df.sparkSession
    rows = cut_lineage(df.select(key, F.col(weight).cast("double").alias("_w")).withColumn(
        "_b", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets)).cast("int")))
    sums = rows.groupBy("_b").agg(F.sum(F.col("_w").cast("decimal(28,12)")).cast("double").alias("_s"), F.count("*").alias("_n")).orderBy("_b").collect()
    size = np.array([r["_s"] for r in sums], dtype=float)
    if size.sum() <= 0:
        return df.select(key).withColumn("times", F.lit(0).cast("bigint")).filter(F.lit(False))
    times = np.random.default_rng(seed).multinomial(sum(r["_n"] for r in sums), size / size.sum())
    table = [(int(r["_b"]), int(k), float(r["_s"])) for r, k in zip(sums, times) if k > 0]
    part = 10000
    draw = spark.createDataFrame(table, "_b int, _k bigint, _s double")
    draw = draw.withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((F.col("_k") - 1) / part))))
    draw = draw.repartition("_b", "_i").withColumn(
        "_j", F.explode(F.sequence(F.lit(1), F.least(F.lit(part), F.col("_k") - F.col("_i") * part))))
    # A hash of (bucket, part, number) is a repeatable uniform value.
    unit = F.pmod(F.xxhash64(F.lit(seed), "_b", "_i", "_j"), F.lit(2**52)) / float(2**52)
    draw = draw.select("_b", (unit * F.col("_s")).alias("_u"))
    w = W.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 1), key), key)
    line = rows.withColumn("_hi", F.sum("_w").over(w.rowsBetween(W.unboundedPreceding, 0)))
    both = line.select("_b", F.col("_hi").alias("_at"), F.lit(1).alias("_row"), key).unionByName(
        draw.select("_b", F.col("_u").alias("_at"), F.lit(0).alias("_row"), F.lit(None).cast(df.schema[key].dataType).alias(key))
    )
    # A draw belongs to the first row whose running sum passes it; the bucket's last row takes the rest.
    # Read from the far end, that row is the latest one seen, so the frame only ever grows.
    back = W.partitionBy("_b").orderBy(F.col("_at").desc(), F.col("_row").desc()).rowsBetween(W.unboundedPreceding, 0)
    nxt = F.last(F.when(F.col("_row") == 1, F.col(key)), ignorenulls=True).over(back)
    last = F.max_by(key, F.struct("_row", "_at")).over(W.partitionBy("_b"))
    hit = both.withColumn(key, F.when(F.col("_row") == 0, F.coalesce(nxt, last)).otherwise(F.col(key))).filter("_row = 0")
    return hit.groupBy(key).agg(F.count("*").alias("times"))


def model_uncertainty(logit="logit", heading_conf="hconf", keypoint_entropy: str | None = None) -> Column:
    """Doubt of a model's own outputs, 0 to 1: margin of the score, entropy of the heading and the keypoints."""
    from tidemark.operators.detect import sigmoid

    p, c = sigmoid(logit), sigmoid(heading_conf)
    u_cls, u_conf = 1.0 - F.abs(2.0 * p - 1.0), 4.0 * c * (1.0 - c)
    if keypoint_entropy is None:
        return _clip(0.52 * u_cls + 0.48 * u_conf, 0.0, 1.0)
    return _clip(0.34 * u_cls + 0.33 * u_conf + 0.33 * col(keypoint_entropy), 0.0, 1.0)


def heatmap_entropy(planes) -> Column:
    """Mean binary entropy of heatmap logits as a share of its maximum; null planes do not count."""
    from tidemark.operators.detect import sigmoid

    flat = F.flatten(F.filter(col(planes), lambda p: p.isNotNull()))
    p = F.transform(flat, lambda x: F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), sigmoid(x))))
    total = F.aggregate(p, F.lit(0.0), lambda s, q: s - (q * F.ln(q) + (1 - q) * F.ln(1 - q)))
    return F.try_divide(total, F.size(flat)) / 0.69314718056


def merged_priority(base="al_priority", doubt="model_u") -> Column:
    return _clip(col(base) * (1.0 + 0.72 * _clip(col(doubt), 0.0, 1.0)), 0.45, 5.8)


def self_training_trust(prob="prob", doubt="model_u", export="export_uncertainty") -> Column:
    """Trust in an unlabelled chip from a sure score and little doubt; a curator's hint lowers it."""
    u, p, e = (_clip(col(c), 0.0, 1.0) for c in (doubt, prob, export))
    base = _clip(F.pow(1.0 - u, F.lit(1.08)) * F.pow(p, F.lit(1.05)), 0.06, 1.0)
    return base * F.greatest(F.lit(0.42), 1.0 - 0.35 * e)


def self_training_batch(chips: DataFrame, min_prob: float = 0.7, max_doubt: float = 0.62, scan: int | None = None,
                        take: int | None = None, seed: int | None = None, key: str = "id") -> DataFrame:
    """Chips for a self-training step: a seeded scan, two gates, then the most trusted ones.

    ``scan`` and ``take`` are the step's own sizes; ``None`` uses every chip.
    """
    pool = chips
    if scan is not None:
        pool = chips.orderBy(F.xxhash64(F.lit(seed or 0), key), key).limit(max(1, scan))
    ok = pool.filter((F.col("prob") >= min_prob) & (F.col("model_u") <= max_doubt))
    out = ok.withColumn("trust", self_training_trust())
    return out.orderBy(F.col("trust").desc(), key).limit(max(1, take)) if take is not None else out


def teacher_targets(df: DataFrame) -> DataFrame:
    """Heading target (sin, cos) by fused, keypoint, wake; wake target (cos, sin) by fused, keypoint."""
    h = F.radians(F.coalesce("heading_fused_deg", "heading_keypoint_deg", "heading_wake_deg"))
    w = F.radians(F.coalesce("heading_fused_deg", "heading_keypoint_deg"))
    return df.withColumns({
        "teacher_sin": F.sin(h), "teacher_cos": F.cos(h), "teacher_valid": F.when(h.isNotNull(), 1.0).otherwise(0.0),
        "wake_cos": F.cos(w), "wake_sin": F.sin(w),
    })


def shift_markers(df: DataFrame, chip_half: int, markers: str = "markers") -> DataFrame:
    """Markers moved from the crop they were placed in to the training chip's corner (over half a pixel)."""
    dx = F.col("marker_origin_col") - (F.rint("cx").cast("int") - chip_half)
    dy = F.col("marker_origin_row") - (F.rint("cy").cast("int") - chip_half)
    move = F.coalesce((F.abs(dx) > 0.5) | (F.abs(dy) > 0.5), F.lit(False))
    moved = F.transform(col(markers), lambda m: m.withField("x", m["x"] + dx).withField("y", m["y"] + dy))
    return df.withColumn(markers, F.when(move, moved).otherwise(col(markers)))


def marker_landmarks(df: DataFrame, w, h, markers: str = "markers") -> DataFrame:
    """Add ``landmarks``: eight (x, y, visible) in [0, 1] — bow, stern, bridge, stack, two sides, two ends."""
    from tidemark.functions.columns import pin

    ww, hh = col(w), col(h)
    d = pin(df.withColumn("_m", H.for_hull(markers, 1)), "_m")
    d = d.withColumns({"_s": H.side_pair("_m"), "_e": H.end_pair("_m")})
    spots = [H.last_of("_m", r) for r in ("bow", "stern", "bridge", "stack")]
    spots += [F.get("_s", 0), F.get("_s", 1), F.get("_e", 0), F.get("_e", 1)]
    big = (ww > 1) & (hh > 1)
    d = d.withColumn("_k", F.array(*[F.struct(s["x"].alias("x"), s["y"].alias("y")) for s in spots]))
    out = F.transform("_k", lambda s: F.when(
        big & s["x"].isNotNull() & s["y"].isNotNull(),
        F.struct(_clip(s["x"] / ww, 0.0, 1.0).alias("x"), _clip(s["y"] / hh, 0.0, 1.0).alias("y"), F.lit(1.0).alias("visible")),
    ).otherwise(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("visible"))))
    return d.withColumn("landmarks", out).drop("_m", "_s", "_e", "_k")


def batch_columns(df: DataFrame) -> DataFrame:
    """Targets with their masks as plain numbers: nulls become neutral values a mask switches off."""
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    chroma = F.col("chroma_heading_deg").isNotNull() & F.coalesce(F.col("chroma_pnr") >= CHROMA_MIN_PNR, F.lit(False))
    rad = F.radians("chroma_heading_deg")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return df.select(
        "id", "cls", z(F.col("heading_deg")).alias("hdg_deg"), on(F.col("heading_deg").isNotNull()).alias("hdg_valid"),
        z(F.col("wake_visible")).alias("wake_visible"), on(F.col("wake_visible").isNotNull()).alias("wake_mask"),
        z(F.col("dim_length_m") / SIZE_NORM_M).alias("dim_length"), z(F.col("dim_width_m") / SIZE_NORM_M).alias("dim_width"),
        on(F.col("dim_length_m").isNotNull() & F.col("dim_width_m").isNotNull()).alias("dim_mask"),
        F.when(chroma, F.cos(rad)).otherwise(1.0).alias("chroma_cos"), F.when(chroma, F.sin(rad)).otherwise(0.0).alias("chroma_sin"),
        on(chroma).alias("chroma_valid"), "mat_cat_idx", on(F.col("mat_cat_idx") >= 0).alias("mat_cat_mask"),
    )


def turned_variants(df: DataFrame, seed: int | None = None, key: str = "id") -> DataFrame:
    """Flipped and turned copies: all sixteen, or with a seed one per row.

    Adds ``hflip``, ``vflip`` and ``quarter_turns``; :func:`turn_heading`, :func:`turn_point` and
    :func:`turn_pixel` apply them in the order flip sideways, flip upright, turn clockwise.
    """
    every = [F.struct(F.lit(bool(a)).alias("hflip"), F.lit(bool(b)).alias("vflip"), F.lit(k).alias("quarter_turns"))
             for a in (0, 1) for b in (0, 1) for k in range(4)]
    table = F.array(*every)
    if seed is None:
        out = df.withColumn("_v", F.explode(table))
    else:
        out = df.withColumn("_v", F.get(table, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(16)).cast("int")))
    return out.withColumns({c: F.col(f"_v.{c}") for c in ("hflip", "vflip", "quarter_turns")}).drop("_v")


def turn_heading(heading="heading_deg") -> Column:
    full = F.lit(360.0)
    h = F.when(F.col("hflip"), F.pmod(360.0 - col(heading), full)).otherwise(col(heading))
    h = F.when(F.col("vflip"), F.pmod(180.0 - h, full)).otherwise(h)
    return F.when(F.col("quarter_turns") > 0, F.pmod(h + 90.0 * F.col("quarter_turns"), full)).otherwise(h)


def turn_point(x="x", y="y", size: Column | None = None) -> Column:
    """struct(x, y) of a point in [0, size] after the row's variant; ``size`` 1 by default."""
    s = F.lit(1.0) if size is None else size
    a = F.when(F.col("hflip"), s - col(x)).otherwise(col(x))
    b = F.when(F.col("vflip"), s - col(y)).otherwise(col(y))
    k = F.col("quarter_turns")
    return F.struct(
        F.when(k == 0, a).when(k == 1, s - b).when(k == 2, s - a).otherwise(b).alias("x"),
        F.when(k == 0, b).when(k == 1, a).when(k == 2, s - b).otherwise(s - a).alias("y"),
    )


def turn_pixel(size: int, r="r", c="c") -> Column:
    """struct(x, y) as column and row of a chip pixel after the row's variant."""
    return turn_point(c, r, F.lit(size - 1))


def top_by_priority(df: DataFrame, n: int, key: str = "id", score: str = "al_priority") -> DataFrame:
    """The ``n`` rows of highest priority, each id once with its best row."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(score)).alias("_r"))
    return best.select(key, "_r.*").orderBy(F.col(score).desc(), key).limit(n)


def feature_matrix(
    labels: DataFrame, scenes: DataFrame, wide: DataFrame, half: float = 16.0, n: int = 32, block: int = 256
) -> DataFrame:
    """Six colour features and the binary label per usable row of a known scene."""
    from tidemark.operators.pixels import crop_features

    rows = LB.resolve_assets(LB.with_binary_label(labels).filter("y is not null"), scenes)
    rows = rows.filter(F.col("resolved_path").isNotNull()).select(
        "id", "y", F.col("image_name").alias("scene"), F.col("cx_full").alias("cx"), F.col("cy_full").alias("cy"))
    return crop_features(rows, wide, "scene", "id", half, n, block).drop("scene", "cx", "cy")


def chip_vector(values) -> Column:
    """Flat chip values on [0, 1]."""
    return F.transform(col(values), lambda x: x / 255.0)
