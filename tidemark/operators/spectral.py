"""Spectra inside hull masks, material matching, and the flags built on them.

Channel order: 0 red, 1 green, 2 blue, 3 NIR, 4–6 red edge, 7 narrow NIR, 8–9 SWIR, 10 aerosol, 11 vapour.
Spectra are ``array<double>`` columns. The spectral library is a table (material, category, spec) given by
the caller; its size is checked before it is folded into the expression or broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.labels import col

EPS = 1e-6
MASK = 0.3
MAX_LIBRARY_ROWS = 20000

# Fixed material names used by the index rules.
RUST = "rust (hematite-type)"
DARK = "dark material (rubber/carbon)"


def band(spec, i: int) -> Column:
    return F.get(col(spec), i)


def indices(spec) -> Column:
    """Seven band indices; null below ten bands."""
    s = col(spec)
    b = lambda i: F.get(s, i)
    nd = lambda x, y: (x - y) / (x + y + EPS)
    return F.when(
        F.size(s) >= 10,
        F.struct(
            nd(b(1), b(3)).alias("ndwi"), nd(b(1), b(8)).alias("mndwi"), nd(b(3), b(0)).alias("ndvi"),
            (b(0) / (b(2) + EPS)).alias("iron_oxide"), (b(3) / (b(8) + EPS)).alias("nir_swir"),
            (b(7) / (b(3) + EPS)).alias("b8a_b08"), nd(b(6), b(4)).alias("ndre"),
        ),
    )


def _norm(s: Column) -> Column:
    total = F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x)
    return F.greatest(F.sqrt(total), F.lit(1e-9))


def spectral_angle(a, b) -> Column:
    """Angle between two spectra in radians; the shorter one sets the bands of the product."""
    x, y = col(a), col(b)
    n = F.least(F.size(x), F.size(y))
    dot = F.aggregate(
        F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v
    )
    cos = dot / (_norm(x) * _norm(y))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def _with_references(df: DataFrame, library: DataFrame) -> DataFrame:
    """Add the whole library as one array column ``_refs``, in the order of ``pos``; null bands count as 0.

    The library becomes one row in the plan, which meets every row of ``df`` by a join on a constant. Its size is checked where it is made:
    more than ``MAX_LIBRARY_ROWS`` rows end the job.
    """
    spec = F.transform("spec", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    refs = F.array_sort(F.collect_list(F.struct(
        F.col("pos").cast("int").alias("pos"), "material", "category", spec.alias("ref"), _norm(spec).alias("norm")
    )))
    checked = F.when(F.count("*") <= MAX_LIBRARY_ROWS, refs).otherwise(
        F.raise_error(F.lit(f"spectral library has more than {MAX_LIBRARY_ROWS} rows"))
    )
    one = library.agg(checked.alias("_refs")).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def _angles(df: DataFrame, library: DataFrame, s: Column) -> DataFrame:
    """Add ``_angles``: one struct (angle, pos, material, category) per library row."""
    out = _with_references(df, library).withColumn("_norm", _norm(s))

    def angle(r):
        n = F.least(F.size(s), F.size(r["ref"]))
        dot = F.aggregate(
            F.zip_with(F.slice(s, F.lit(1), n), F.slice(r["ref"], F.lit(1), n), lambda p, q: p * q),
            F.lit(0.0), lambda t, v: t + v,
        )
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (F.col("_norm") * r["norm"])))
        return F.struct(
            F.acos(cos).alias("angle"), r["pos"].alias("pos"), r["material"].alias("material"), r["category"].alias("category")
        )

    return out.withColumn("_angles", F.when(F.size(s) >= 3, F.transform("_refs", angle))).drop("_refs", "_norm")


def match_angles(df: DataFrame, library: DataFrame, key: str, spec: str = "spec") -> DataFrame:
    """Every spectrum against every library row: key, pos, material, category, angle."""
    return _angles(df, library, F.col(spec)).select(key, F.explode("_angles").alias("_a")).select(
        key, "_a.pos", "_a.material", "_a.category", "_a.angle"
    )


def best_two(df: DataFrame, library: DataFrame, spec: Column | str = "spec", name: str = "match") -> DataFrame:
    """Add the best library match as struct ``name``: material, category, angle, second, confidence.

    All angles are one map-side expression, so there is no shuffle. Ties go to the earlier library row.
    """
    out = _angles(df, library, col(spec)).withColumn("_sorted", F.slice(F.array_sort("_angles"), 1, 2))
    first, second = F.get("_sorted", 0), F.get("_sorted", 1)
    a1 = first["angle"]
    a2 = F.coalesce(second["angle"], a1 + 0.1)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - a1 / F.greatest(a2, F.lit(1e-9))))
    m = F.when(first.isNotNull(), F.struct(
        first["material"].alias("material"), first["category"].alias("category"), a1.alias("angle"),
        second["material"].alias("second"), conf.alias("confidence"),
    ))
    return out.withColumn(name, m).drop("_angles", "_sorted")


def _index_rules(material: Column, confidence: Column, spec: Column) -> Column:
    """Rust and dark-material rules that correct an uncertain hull match."""
    ix = indices(spec)
    rust = (ix["iron_oxide"] > 2.5) & (ix["b8a_b08"] < 0.85) & (confidence < 0.5)
    m1 = F.when(rust, RUST).otherwise(material)
    c1 = F.when(rust, F.greatest(confidence, F.lit(0.6))).otherwise(confidence)
    bright = (F.get(spec, 0) + F.get(spec, 1) + F.get(spec, 2)) / 3.0
    dark = (ix["ndwi"] > 0.3) & (bright < 0.08)
    return F.struct(
        F.when(dark, DARK).otherwise(m1).alias("label"),
        F.when(dark, F.greatest(c1, F.lit(0.5))).otherwise(c1).alias("confidence"),
    )


def material_hint(df: DataFrame, library: DataFrame, measured: str = "spec", predicted: str | None = None) -> DataFrame:
    """Add ``material_hint`` and ``material_confidence``; the predicted spectrum stands in for a missing one.

    A match outside the vessel category is prefixed with its category; index rules apply to vessels only.
    """
    s = _source(measured, predicted)
    out = best_two(df.withColumn("_src", s), library, "_src", "_m")
    m = F.col("_m")
    rules = _index_rules(m["material"], m["confidence"], F.col("_src"))
    foreign = m["category"].isin("water", "cloud", "oil")
    return out.withColumns({
        "material_hint": F.when(m.isNull(), "unknown").when(
            foreign, F.concat(m["category"], F.lit(": "), m["material"])
        ).otherwise(rules["label"]),
        "material_confidence": F.when(m.isNull(), 0.0).when(foreign, m["confidence"]).otherwise(rules["confidence"]),
    }).drop("_src", "_m")


def vessel_material(df: DataFrame, library: DataFrame, measured: str = "spec", predicted: str | None = None) -> DataFrame:
    """Add ``vessel_material`` and its confidence from the vessel rows of the library only."""
    s = _source(measured, predicted)
    out = best_two(df.withColumn("_src", s), library.filter("category = 'vessel'"), "_src", "_m")
    m = F.col("_m")
    rules = _index_rules(m["material"], m["confidence"], F.col("_src"))
    return out.withColumns({
        "vessel_material": F.when(m.isNull(), "unknown").otherwise(rules["label"]),
        "vessel_material_confidence": F.when(m.isNull(), 0.0).otherwise(rules["confidence"]),
    }).drop("_src", "_m")


def _source(measured: str, predicted: str | None) -> Column:
    ok = F.col(measured).isNotNull() & (F.size(measured) >= 3)
    return F.when(ok, F.col(measured)).otherwise(F.col(predicted)) if predicted else F.col(measured)


def simple_hint(spec) -> Column:
    """Rule-based hint without a library."""
    s = col(spec)
    r, g, b, nir, sw1, sw2 = (F.get(s, i) for i in (0, 1, 2, 3, 8, 9))
    sw2 = F.coalesce(sw2, F.lit(0.0))
    bright = (r + g + b) / 3.0
    return (
        F.when(s.isNull() | (F.size(s) < 9), "unknown")
        .when(bright < 0.08, DARK)
        .when((bright > 0.60) & (nir > 0.65), "white fiberglass / gel coat")
        .when((r > g + 0.15) & (r > b + 0.15), "red antifouling paint")
        .when((nir > bright + 0.08) & (sw1 > 0.25), "light metal hull (steel/aluminium)")
        .when((sw1 > 0.28) & (sw2 < sw1 - 0.08), "painted metal")
        .when((sw1 < 0.15) & (nir < 0.25), "dark weathered/fouled hull")
        .otherwise("mixed / indeterminate")
    )


def consistency(measured, predicted) -> Column:
    """Angle between measured and predicted spectrum as a share of a right angle; null below three bands."""
    m, p = col(measured), col(predicted)
    n = F.least(F.size(m), F.size(p))
    cut = lambda x: F.slice(x, F.lit(1), n)
    return F.when(n >= 3, F.bround(spectral_angle(cut(m), cut(p)) / (math.pi / 2), 4))


def chip_profile(wide: DataFrame, image: str = "chip_id", n_bands: int = 12) -> DataFrame:
    """Everything measured on a chip with its masks, in one aggregate.

    ``wide`` has b0…b11, ``n_bands``, ``seg`` (hull probability) and ``wake`` (wake probability). Results:
    the mean hull spectrum, and flags for sun glint, haze, vegetation and wake brightness. A value is null
    where too few pixels or bands support it.
    """
    hull, water = F.col("seg") >= MASK, F.col("seg") < MASK
    wake = F.col("wake") >= MASK
    calm = ~wake & ~hull
    mean = lambda i, m: F.avg(F.when(m, F.col(f"b{i}")))
    agg = {
        "_bands": F.max("n_bands"), "n_hull": F.count_if(hull), "n_water": F.count_if(water),
        "n_wake": F.count_if(wake), "n_calm": F.count_if(calm),
        **{f"_h{i}": mean(i, hull) for i in range(n_bands)},
        **{f"_w{i}": mean(i, water) for i in (0, 1, 2, 8, 9)},
        "_b01": F.avg("b10"), "_b09": F.avg("b11"), "_wk": mean(3, wake), "_cm": mean(3, calm),
    }
    a = wide.groupBy(image).agg(*[c.alias(n) for n, c in agg.items()])
    bands = F.col("_bands")
    vis, swir = (F.col("_w0") + F.col("_w1") + F.col("_w2")) / 3, (F.col("_w8") + F.col("_w9")) / 2
    glint = F.when(swir < 1e-4, vis > 0.15).otherwise((vis > 0.15) & (vis / (swir + 1e-6) > 4.0))
    nd = lambda x, y: (F.col(x) - F.col(y)) / (F.col(x) + F.col(y) + EPS)
    return a.select(
        image, bands.alias("n_bands"), "n_hull", "n_water", "n_wake",
        F.when(F.col("n_hull") >= 3, F.array(*[F.col(f"_h{i}") for i in range(n_bands)])).alias("spec"),
        F.when((bands >= 10) & (F.col("n_water") >= 20), glint).alias("sun_glint"),
        F.when(bands < 12, "unknown").when((F.col("_b01") > 0.15) | (F.col("_b09") > 0.12), "poor")
        .when((F.col("_b01") > 0.08) | (F.col("_b09") > 0.06), "moderate").otherwise("good").alias("atmosphere"),
        F.when((bands >= 4) & (F.col("n_wake") >= 3) & (F.col("n_calm") >= 10), F.bround(F.col("_wk") - F.col("_cm"), 5))
        .alias("wake_nir_excess"),
        F.when((bands >= 7) & (F.col("n_hull") >= 3), (nd("_h6", "_h4") > 0.12) & (nd("_h3", "_h0") > 0.15)).alias("vegetation"),
    )


def anomaly_score(wide: DataFrame, image: str = "chip_id", n_bands: int = 12) -> DataFrame:
    """Mahalanobis distance of the mean hull spectrum from the water around it.

    Water is ``seg`` below half the hull threshold; 20 water and 3 hull pixels are needed. Means and
    second moments come from one aggregate; only the small solve per chip runs in NumPy.
    """
    hull, water = F.col("seg") >= MASK, F.col("seg") < MASK * 0.5
    b = [F.col(f"b{i}") for i in range(n_bands)]
    pairs = [(i, j) for i in range(n_bands) for j in range(i, n_bands)]
    a = wide.groupBy(image).agg(
        F.count_if(hull).alias("_nh"), F.count_if(water).alias("_nw"), F.min("n_bands").alias("_k"),
        F.array(*[F.avg(F.when(hull, x)) for x in b]).alias("_h"),
        F.array(*[F.sum(F.when(water, x)) for x in b]).alias("_s"),
        F.array(*[F.sum(F.when(water, b[i] * b[j])) for i, j in pairs]).alias("_q"),
    )
    enough = (F.col("_nh") >= 3) & (F.col("_nw") >= 20)
    solve = _mahalanobis_udf(n_bands)
    return a.select(
        image, F.when(enough, F.bround(solve("_nw", "_k", "_h", "_s", "_q"), 3)).alias("anomaly")
    )


def _mahalanobis_udf(n_bands: int):
    import pandas as pd

    def batch(nw: pd.Series, k: pd.Series, h: pd.Series, s: pd.Series, q: pd.Series) -> pd.Series:
        import numpy as np

        upper = np.triu_indices(n_bands)
        out = []
        for n, m, hull, total, moments in zip(nw, k, h, s, q):
            if n < 2 or any(x is None for x in (hull, total, moments)):
                out.append(None)
                continue
            hull, total, moments = (np.asarray(x, dtype=float) for x in (hull, total, moments))
            if not np.isfinite(hull).all() or not np.isfinite(total).all():
                out.append(None)
                continue
            full = np.zeros((n_bands, n_bands))
            full[upper] = moments
            full = full + np.triu(full, 1).T
            cov = (full - np.outer(total, total) / n) / (n - 1)
            d = (hull - total / n)[: int(m)]
            cov = cov[: int(m), : int(m)] + np.eye(int(m)) * 1e-6
            out.append(float(np.sqrt(max(d @ np.linalg.solve(cov, d), 0.0))))
        return pd.Series(out, dtype="float64")

    batch.__annotations__ = {c: pd.Series for c in ("nw", "k", "h", "s", "q", "return")}
    return F.pandas_udf(batch, T.DoubleType())


def quality_score(hint="material_hint", confidence="material_confidence", anomaly="anomaly", agreement="consistency",
                  glint="sun_glint", atmosphere="atmosphere", vegetation="vegetation", index=None) -> Column:
    """struct(quality, fp_flag): spectral support for a vessel in [0, 1] and a strong-doubt flag.

    Missing signals count neither way. ``index`` is an index struct or null.
    """
    h = F.lower(col(hint))
    prefix = F.when(h.contains(":"), F.trim(F.substring_index(h, ":", 1))).otherwise("")
    conf = F.when(h != "", col(confidence))
    z = F.lit(0.0)
    part = lambda c: F.coalesce(c, z)
    an, ag, at = col(anomaly), col(agreement), col(atmosphere)
    foreign = prefix.isin("water", "cloud")
    q = F.lit(0.5)
    q = q + part(F.when(foreign, -0.4 * conf).when(prefix == "oil", -0.15 * conf).otherwise(0.25 * conf))
    q = q + part(F.when(an > 5.0, 0.25).when(an > 2.0, 0.12).when(an < 1.0, -0.2))
    q = q + part(F.when(ag < 0.15, 0.1).when(ag > 0.6, -0.15))
    q = q + part(F.when(col(glint), -0.1))
    q = q + part(F.when(at == "poor", -0.12).when(at == "moderate", -0.04))
    q = q + part(F.when(col(vegetation), -0.3))
    if index is not None:
        ix = col(index)
        q = q + part(F.when(ix["ndwi"] > 0.5, -0.15)) + part(F.when(ix["ndvi"] > 0.4, -0.2))
    flag = F.coalesce(foreign & (conf > 0.35), F.lit(False)) | F.coalesce(col(vegetation), F.lit(False))
    return F.struct(F.bround(F.greatest(z, F.least(F.lit(1.0), q)), 3).alias("quality"), flag.alias("fp_flag"))


def learned_category(logits, hint) -> Column:
    """struct(category, probability, hint): three logits override the matched text when sure and opposed."""
    l, h = col(logits), col(hint)
    top = F.array_max(l)
    e = F.transform(l, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    p = F.array_max(e) / total
    cat = F.get(F.array(F.lit("vessel"), F.lit("water"), F.lit("cloud")), (F.array_position(l, top) - 1).cast("int"))
    text = F.coalesce(h, F.lit(""))
    matched = F.when(text.contains(":"), F.trim(F.substring_index(text, ":", 1))).otherwise("vessel")
    sure = (cat != matched) & (p > 0.6)
    new = (
        F.when(sure & (cat == "vessel") & matched.isin("water", "cloud", "oil"),
               F.replace(text, F.concat(matched, F.lit(": ")), F.lit("vessel (override): ")))
        .when(sure & cat.isin("water", "cloud") & (matched == "vessel"),
              F.concat(cat, F.lit(": "), F.coalesce(h, F.lit("unknown")), F.lit(" (SAM disagrees)")))
        .otherwise(h)
    )
    return F.when(F.size(l) == 3, F.struct(cat.alias("category"), F.bround(p, 3).alias("probability"), new.alias("hint")))


def refine_outline(wide: DataFrame, outlines: DataFrame, image: str = "chip_id", n_bands: int = 12) -> DataFrame:
    """Outline corners moved by the vessel share of the nearest edge pixels.

    ``outlines`` has (image, polygon). Edge pixels are where a 3×3 dilation and erosion of the hull mask
    differ; each is split between mean hull and mean water. A corner moves along its ray from the centre by
    the mean share of its nearest tenth of the edge (three at least), less one half. Result: one row per
    corner (image, i, x, y), absent when the masks do not allow it.
    """
    b = [F.col(f"b{i}") for i in range(n_bands)]
    hull, water = F.col("seg") >= MASK, F.col("seg") < MASK * 0.3
    ends = wide.groupBy(image).agg(
        F.count_if(hull).alias("_nh"), F.count_if(water).alias("_nw"), F.max("r").alias("_rm"), F.max("c").alias("_cm"),
        F.array(*[F.avg(F.when(hull, x)) for x in b]).alias("_ve"), F.array(*[F.avg(F.when(water, x)) for x in b]).alias("_we"),
    ).filter("_nh >= 4 and _nw >= 10").withColumn("_d", F.zip_with("_ve", "_we", lambda p, q: p - q))
    ends = ends.withColumn("_d2", F.aggregate("_d", F.lit(0.0), lambda s, x: s + x * x)).filter("_d2 >= 0.0001")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    votes = wide.filter(hull).select(image, "r", "c", F.explode(steps).alias("s")).groupBy(
        image, (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c")
    ).agg(F.count("*").alias("_v"))
    px = wide.select(image, "r", "c", F.array(*b).alias("_p")).join(votes, [image, "r", "c"]).join(
        ends.select(image, "_we", "_d", "_d2", "_rm", "_cm"), image
    )
    span = lambda v, m: F.least(F.col(v) + 1, F.col(m)) - F.greatest(F.col(v) - 1, F.lit(0)) + 1
    edge = px.filter(F.col("_v") < span("r", "_rm") * span("c", "_cm"))
    num = F.aggregate(
        F.zip_with(F.zip_with("_p", "_we", lambda p, w: p - w), "_d", lambda x, d: x * d), F.lit(0.0), lambda s, x: s + x
    )
    edge = edge.select(image, "r", "c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / F.col("_d2"))).alias("_f"))
    n_edge = edge.groupBy(image).agg(F.count("*").alias("_n")).filter("_n >= 3")
    mean = lambda f: F.aggregate("polygon", F.lit(0.0), lambda s, p: s + p[f]) / F.size("polygon")
    corners = outlines.filter(F.size("polygon") >= 3).select(
        image, mean("x").alias("_mx"), mean("y").alias("_my"), F.posexplode("polygon").alias("i", "q")
    ).join(n_edge, image)
    near = corners.join(edge, image).withColumn("_e", F.struct(
        ((F.col("c") - F.col("q.x")) * (F.col("c") - F.col("q.x")) + (F.col("r") - F.col("q.y")) * (F.col("r") - F.col("q.y"))).alias("d"),
        F.col("r").alias("r"), F.col("c").alias("c"),
    ))
    from pyspark.sql import Window as W

    w = W.partitionBy(image, "i").orderBy("_e")
    k = F.greatest(F.lit(3), F.floor(F.col("_n") / 10))
    share = near.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).groupBy(
        image, "i", "_mx", "_my", F.col("q.x").alias("_qx"), F.col("q.y").alias("_qy")
    ).agg(F.avg("_f").alias("_s"))
    dx, dy = F.col("_qx") - F.col("_mx"), F.col("_qy") - F.col("_my")
    rad = F.greatest(F.hypot(dx, dy), F.lit(1e-6))
    scale = F.when(rad > 1.0, 1.0 + (F.col("_s") - 0.5) / rad).otherwise(1.0)
    return share.select(image, "i", (F.col("_mx") + dx * scale).alias("x"), (F.col("_my") + dy * scale).alias("y"))


def spectral_fields(wide: DataFrame, library: DataFrame, preds: DataFrame | None = None, image: str = "chip_id") -> DataFrame:
    """All spectral outputs per chip: spectrum, indices, materials, flags, quality.

    ``preds`` may give a predicted spectrum ``pred`` and category ``logits`` per chip.
    """
    out = chip_profile(wide, image).join(anomaly_score(wide, image), image)
    if preds is not None:
        out = out.join(preds, image, "left")
    for name, kind in (("pred", "array<double>"), ("logits", "array<double>")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    out = vessel_material(material_hint(out, library, "spec", "pred"), library, "spec", "pred")
    out = out.withColumn("consistency", consistency("spec", "pred"))
    out = out.withColumn("index", indices(F.coalesce("spec", "pred")))
    learned = learned_category("logits", "material_hint")
    out = out.withColumn("learned", learned).withColumn(
        "material_hint", F.coalesce(F.col("learned.hint"), F.col("material_hint"))
    )
    return out.withColumn("_q", quality_score(index="index")).withColumns(
        {"spectral_quality": F.col("_q.quality"), "fp_flag": F.col("_q.fp_flag")}
    ).drop("_q")


def hull_spectrum(wide: DataFrame, outlines: DataFrame, size: int, image: str = "chip_id", min_bands: int = 3) -> DataFrame:
    """Mean spectrum inside the ellipse of each chip's outline box, or in the chip's middle without one.

    ``outlines`` has (image, cx, cy, half_a, half_b, angle_deg) in chip pixels. Chips with fewer than ``min_bands``
    bands, the three visible ones as given, have no spectrum; in the others a missing band reads 0.
    """
    from tidemark.operators.pixels import in_centre_box, in_ellipse

    j = wide.drop("seg").join(outlines, image, "left")
    inside = F.when(
        F.col("half_a").isNotNull(), in_ellipse("c", "r", "cx", "cy", "half_a", "half_b", "angle_deg")
    ).otherwise(in_centre_box("r", "c", size))
    b = [F.avg(F.when(inside, F.col(f"b{i}"))) for i in range(12)]
    return j.groupBy(image).agg(
        F.when((F.count_if(inside) >= 3) & (F.min("n_bands") >= min_bands), F.array(*b)).alias("spec")
    )


def backfill(labels: DataFrame, fields: DataFrame, key: str = "id") -> DataFrame:
    """Store recomputed spectral fields on point and size rows; ``status`` tells what happened to each.

    Grid tiles and witnesses are skipped; rows without a measured chip keep their values as errors.
    """
    names = [c for c in fields.columns if c != key]
    f = fields.select(key, *[F.col(c).alias(f"_new_{c}") for c in names], F.lit(True).alias("_hit"))
    skip = F.coalesce(F.col("record_type").isin("overview_grid_tile", "static_sea_witness"), F.lit(False))
    out = labels.join(f, key, "left")
    for c in names:
        old = F.col(c) if c in labels.columns else F.lit(None)
        out = out.withColumn(c, F.when(~skip, F.coalesce(F.col(f"_new_{c}"), old)).otherwise(old))
    status = F.when(skip, "skipped").when(F.col("_hit"), "updated").otherwise("errors")
    return out.withColumn("status", status).drop("_hit", *[f"_new_{c}" for c in names])
