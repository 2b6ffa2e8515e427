"""Tiles, windows, masks and statistics over pixel tables.

Two shapes are used. *Long* rows are ``(image, band, r, c, v)``; *wide* rows are ``(image, r, c, b0, b1, …)``
with one row per pixel. Chips stored as arrays open into wide rows without a shuffle
(:func:`explode_chips`), and aggregates per chip then combine inside the task before anything moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import col

# Fixed class codes of the scene classification raster.
CLOUD_SHADOW, WATER, UNCLASSIFIED, CLOUD_MEDIUM, CLOUD_HIGH, CIRRUS, SNOW = 3, 6, 7, 8, 9, 10, 11
CLOUD_CLASSES = (3, 8, 9, 10)
# Fixed thresholds of the tile skips and of the surface-water source.
CLOUD_BRIGHTNESS, CLOUD_VARIANCE = 235.0, 400.0
WATER_OCCURRENCE = 50
LAND_TILE_MAX_WATER, WATER_TILE_MIN_WATER = 0.05, 0.20
N_BANDS = 12


# ---------------------------------------------------------------- tiles and windows

def tile_starts(length, tile: int, stride: int) -> Column:
    """Start offsets of full tiles along one axis; the last one ends at the edge."""
    n = col(length)
    last = F.greatest(n - tile, F.lit(0)).cast("int")
    steps = F.sequence(F.lit(0), last, F.lit(max(1, int(stride))))
    return F.array_union(steps, F.array(last))


def tiling(chip_half: int, overlap: float) -> tuple[int, int]:
    """Tile side and stride for a chip half size and an overlap share."""
    tile = max(16, 2 * chip_half)
    return tile, max(8, round(tile * (1.0 - min(0.95, max(0.0, overlap)))))


def scene_tiles(scenes: DataFrame, tile: int, stride: int) -> DataFrame:
    """One row per tile to scan: scene, row0, col0."""
    return (
        scenes.withColumn("row0", F.explode(tile_starts("height", tile, stride)))
        .withColumn("col0", F.explode(tile_starts("width", tile, stride)))
    )


def window_pixels(windows: DataFrame, pixels: DataFrame, image: str, block: int = 256) -> DataFrame:
    """Pixels inside each window (col0, row0, w, h), met by block so that windows share no big key.

    A window is repeated once per block it touches; the equality on (image, block) carries the join and
    the exact bounds only trim it.
    """
    edge = lambda start, size, f: F.sequence(F.floor(F.col(start) / block), F.floor((F.col(start) + F.col(size) - 1) / block))
    w = windows.withColumn("_br", F.explode(edge("row0", "h", 0))).withColumn("_bc", F.explode(edge("col0", "w", 0)))
    p = pixels.withColumns({"_br": F.floor(F.col("r") / block), "_bc": F.floor(F.col("c") / block)})
    inside = (
        (F.col("r") >= F.col("row0")) & (F.col("r") < F.col("row0") + F.col("h"))
        & (F.col("c") >= F.col("col0")) & (F.col("c") < F.col("col0") + F.col("w"))
    )
    return w.join(p, [image, "_br", "_bc"]).filter(inside).drop("_br", "_bc")


def window_statistics(
    windows: DataFrame, pixels: DataFrame, image: str, key: str, aggs: dict[str, Column], block: int = 256
) -> DataFrame:
    """Aggregates over the pixels of each window. Equal windows are measured once and joined back."""
    shape = [image, "col0", "row0", "w", "h"]
    unique = windows.select(*shape).distinct()
    hit = window_pixels(unique, pixels, image, block)
    stats = hit.groupBy(*shape).agg(*[a.alias(n) for n, a in aggs.items()])
    return windows.join(stats, shape, "left")


def padded_window(windows: DataFrame, pixels: DataFrame, image: str, key: str, size: int, block: int = 256) -> DataFrame:
    """Every pixel of a ``size``-square chip at each window's corner; outside the scene it reads 0.

    Windows with fewer than eight scene pixels along a side are dropped. Needs the scene's width and
    height on the window row. The padding is made from the window alone, so only scene pixels are joined.
    """
    w = windows.withColumns({
        "w": F.least(F.lit(size), F.col("width") - F.col("col0")), "h": F.least(F.lit(size), F.col("height") - F.col("row0")),
    }).filter("w >= 8 and h >= 8")
    seen = window_pixels(w, pixels, image, block).select(
        key, (F.col("r") - F.col("row0")).alias("pr"), (F.col("c") - F.col("col0")).alias("pc"), "v"
    )
    index = F.sequence(F.lit(0), F.lit(size - 1))
    pad = (
        w.filter((F.col("w") < size) | (F.col("h") < size)).select(key, "w", "h")
        .withColumn("pr", F.explode(index)).withColumn("pc", F.explode(index))
        .filter((F.col("pc") >= F.col("w")) | (F.col("pr") >= F.col("h"))).select(key, "pr", "pc", F.lit(0.0).alias("v"))
    )
    return seen.unionByName(pad)


# ---------------------------------------------------------------- band stacks

def wide_pixels(pixels: DataFrame, image: str = "chip_id", n_bands: int = N_BANDS) -> DataFrame:
    """Long to wide; a missing band reads 0 and ``n_bands`` tells how many exist at the pixel."""
    bands = [F.coalesce(F.max(F.when(F.col("band") == i, F.col("v"))), F.lit(0.0)).alias(f"b{i}") for i in range(n_bands)]
    return pixels.groupBy(image, "r", "c").agg(*bands, F.count_if(F.col("v").isNotNull()).alias("n_bands"))


def stack_bands(pixels: DataFrame, image: str = "chip_id", n_bands: int = N_BANDS, fill: bool = True) -> DataFrame:
    """Long to stored chips: ``bands`` holds one row-major array per channel, zeros (null without ``fill``) where one is missing.

    Meant for chips of bounded size; scenes stay in long form.
    """
    per_band = pixels.groupBy(image, "band").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "v"))), lambda p: p["v"]).alias("values"),
        (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"),
    )
    chips = per_band.groupBy(image).agg(
        F.map_from_entries(F.collect_list(F.struct("band", "values"))).alias("m"),
        F.max("h").alias("h"), F.max("w").alias("w"), F.count("*").alias("n_bands"),
    )
    zeros = F.array_repeat(F.lit(0.0), (F.col("h") * F.col("w")).cast("int"))
    band = lambda i: F.try_element_at("m", F.lit(i))
    bands = F.array(*[F.coalesce(band(i), zeros) if fill else band(i) for i in range(n_bands)])
    return chips.select(image, "h", "w", "n_bands", bands.alias("bands"))


def explode_chips(chips: DataFrame, image: str = "chip_id", n_bands: int = N_BANDS) -> DataFrame:
    """Stored chips to wide rows, row by row of the chip table and without a shuffle."""
    zipped = F.arrays_zip(*[F.get("bands", i).alias(f"b{i}") for i in range(n_bands)])
    out = chips.select(image, "w", "n_bands", F.posexplode(zipped).alias("pos", "px"))
    return out.select(
        image, F.floor(F.col("pos") / F.col("w")).cast("int").alias("r"), (F.col("pos") % F.col("w")).alias("c"),
        *[F.col(f"px.b{i}").alias(f"b{i}") for i in range(n_bands)], "n_bands",
    )


def reflectance(dn) -> Column:
    """Stored number to surface reflectance in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(dn) / 10000.0))


def native_window(cx, cy, half: int, native_m: int) -> Column:
    """Window of a band with another pixel size around a 10 m pixel: struct(col0, row0, side)."""
    scale = 10.0 / native_m
    half_b = max(1, round(half * scale))
    at = lambda v: F.rint(col(v) * scale - half_b).cast("int")
    return F.struct(at(cx).alias("col0"), at(cy).alias("row0"), F.lit(2 * half_b).alias("side"))


def max_normalise(wide: DataFrame, image: str, bands=("b0", "b1", "b2")) -> DataFrame:
    """Three bands to 0–255 by their common maximum per window (truncated, as an image cast does)."""
    top = wide.groupBy(image).agg(F.greatest(*[F.max(b) for b in bands], F.lit(1e-6)).alias("_mx"))
    scaled = {b: F.least(F.greatest(F.col(b) / F.col("_mx") * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int") for b in bands}
    return wide.join(top, image).withColumns(scaled).drop("_mx")


def minmax_normalise(pixels: DataFrame, image: str, v: str = "v") -> DataFrame:
    """One band to 0–255 by its range per window."""
    s = pixels.groupBy(image).agg(F.min(v).alias("_mn"), F.max(v).alias("_m"))
    mx = F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_m"))
    g = (F.col(v) - F.col("_mn")) / (mx - F.col("_mn") + 1e-9) * 255.0
    return pixels.join(s, image).withColumn(v, F.least(F.greatest(g, F.lit(0.0)), F.lit(255.0)).cast("int")).drop("_mn", "_m")


def block_mean(pixels: DataFrame, image: str, k: int, v: str = "v") -> DataFrame:
    """Overview by the mean of k×k blocks; partial blocks at the edge average what they have."""
    cell = lambda c: F.floor(F.col(c) / k).cast("int")
    return pixels.groupBy(image, cell("r").alias("r"), cell("c").alias("c")).agg(F.avg(v).alias(v))


def fitted_size(width, height, longest: int) -> Column:
    """struct(out_w, out_h): the size whose longer side is at most ``longest``; never larger than the image, at least one pixel.
    Halves round to even."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(col(width), col(height)))
    fit = lambda side: F.greatest(F.lit(1), F.rint(col(side) * scale).cast("int"))
    return F.struct(fit(width).alias("out_w"), fit(height).alias("out_h"))


def area_resize(pixels: DataFrame, sizes: DataFrame, image: str, bands=("v",)) -> DataFrame:
    """Resize by area: a target pixel is the mean of the source pixels it covers, each weighted by the share it covers.

    ``sizes`` has one row an image: width, height, out_w, out_h. Factors need not divide, and a larger target repeats its
    source. Rows and columns weigh separately, so a source pixel sends its value to the few targets it meets (four at
    most when shrinking) and one aggregate with map-side sums adds them up. Pixels that are missing are left out of the
    mean; targets that cover none have no row.
    """
    def shares(at: Column, full: str, out: str) -> Column:
        step = F.col(full) / F.col(out)
        targets = F.sequence(F.floor(at / step).cast("int"), (F.ceil((at + 1) / step) - 1).cast("int"))
        share = lambda i: F.least(at + 1.0, (i + 1) * step) - F.greatest(at + 0.0, i * step)
        pieces = F.transform(targets, lambda i: F.struct(i.alias("i"), share(i).alias("s")))
        # Bounds on a pixel border can differ in the last bit.
        return F.filter(pieces, lambda p: (p["s"] > 1e-9) & (p["i"] < F.col(out)))

    d = pixels.select(image, "r", "c", *bands).join(sizes.select(image, "width", "height", "out_w", "out_h"), image)
    d = d.withColumn("_r", F.explode(shares(F.col("r"), "height", "out_h")))
    d = d.withColumn("_c", F.explode(shares(F.col("c"), "width", "out_w")))
    weight = F.col("_r.s") * F.col("_c.s")
    return d.groupBy(image, F.col("_r.i").alias("r"), F.col("_c.i").alias("c")).agg(
        *[(F.sum(F.col(b) * weight) / F.sum(F.when(F.col(b).isNotNull(), weight))).alias(b) for b in bands]
    )


def pixel_blocks(pixels: DataFrame, image: str, bands=("b0", "b1", "b2"), block: int = 256) -> DataFrame:
    """Pixels as blocks: image, br, bc, ``top`` (largest value of all bands), ``px`` (array of r, c, bands).

    Made once and stored, blocks let a wide window read one number from each block that lies inside it.
    """
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    return pixels.groupBy(image, at("r").alias("br"), at("c").alias("bc")).agg(
        F.max(F.greatest(*bands) if len(bands) > 1 else F.col(bands[0])).alias("top"), F.collect_list(F.struct("r", "c", *bands)).alias("px")
    )


def _in_window(p: Column, row0, col0, h, w) -> Column:
    return (p["r"] >= col(row0)) & (p["r"] < col(row0) + col(h)) & (p["c"] >= col(col0)) & (p["c"] < col(col0) + col(w))


def _touched(windows: DataFrame, row0: str, col0: str, h: str, w: str, block: int) -> DataFrame:
    span = lambda start, size: F.sequence(F.floor(F.col(start) / block).cast("int"), F.floor((F.col(start) + F.col(size) - 1) / block).cast("int"))
    return windows.withColumn("br", F.explode(span(row0, h))).withColumn("bc", F.explode(span(col0, w)))


def closeup_normalise(windows: DataFrame, blocks: DataFrame, image: str, bands=("b0", "b1", "b2"), block: int = 256) -> DataFrame:
    """Close-ups at 0-255 by the largest value of their wider window, so that both look alike: pixel rows of each close-up.

    ``windows`` has image, row0, col0, h, w of the close-up and wide_row0, wide_col0, wide_h, wide_w around it; equal
    windows are measured once, and windows of no size give no rows. Of the blocks of :func:`pixel_blocks` those inside the
    wider window give their stored largest value, only those on its rim open their pixels, as arrays inside the row.
    Pixels outside the image do not count.
    """
    wide = ["wide_row0", "wide_col0", "wide_h", "wide_w"]
    near = ["row0", "col0", "h", "w"]
    windows = windows.select(image, *near, *wide).filter("h > 0 AND w > 0 AND wide_h > 0 AND wide_w > 0").distinct()
    met = _touched(windows.select(image, *wide).distinct(), *wide, block)
    inside = (
        (F.col("br") * block >= F.col("wide_row0")) & ((F.col("br") + 1) * block <= F.col("wide_row0") + F.col("wide_h"))
        & (F.col("bc") * block >= F.col("wide_col0")) & ((F.col("bc") + 1) * block <= F.col("wide_col0") + F.col("wide_w"))
    )
    full = met.filter(inside).join(blocks.select(image, "br", "bc", "top"), [image, "br", "bc"]).select(image, *wide, "top")
    most = (lambda p: F.greatest(*[p[b] for b in bands])) if len(bands) > 1 else (lambda p: p[bands[0]])
    rim = met.filter(~inside).join(blocks.select(image, "br", "bc", "px"), [image, "br", "bc"])
    rim = rim.select(image, *wide, F.array_max(F.transform(F.filter("px", lambda p: _in_window(p, *wide)), most)).alias("top"))
    tops = full.unionByName(rim).groupBy(image, *wide).agg(F.greatest(F.max("top"), F.lit(1e-6)).alias("_mx"))
    spots = _touched(windows.join(tops, [image, *wide]), *near, block).join(blocks.select(image, "br", "bc", "px"), [image, "br", "bc"])
    px = spots.select(image, *near, *wide, "_mx", F.inline(F.filter("px", lambda p: _in_window(p, *near))))
    scaled = {b: F.least(F.greatest(F.col(b) / F.col("_mx") * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int") for b in bands}
    return px.withColumns(scaled).drop("_mx")


def align_nearest(classes: DataFrame, targets: DataFrame, image: str) -> DataFrame:
    """Class of the source pixel under each target pixel centre, both rasters on one map grid.

    ``targets`` carries (r, c) and both affines: ``ta, te, tx0, ty0`` and ``sa, se, sx0, sy0``. Pixels
    outside the source read 0, as an unfilled warp does.
    """
    mx = F.col("tx0") + (F.col("c") + 0.5) * F.col("ta")
    my = F.col("ty0") + (F.col("r") + 0.5) * F.col("te")
    t = targets.withColumns({
        "_sc": F.floor((mx - F.col("sx0")) / F.col("sa")).cast("int"),
        "_sr": F.floor((my - F.col("sy0")) / F.col("se")).cast("int"),
    })
    s = classes.select(image, F.col("r").alias("_sr"), F.col("c").alias("_sc"), "cls")
    return t.join(s, [image, "_sr", "_sc"], "left").withColumn("cls", F.coalesce("cls", F.lit(0))).drop("_sr", "_sc")


# ---------------------------------------------------------------- masks

def clear_water(cls, shadow: bool = True, cirrus: bool = True) -> Column:
    """Open water: class 6 and none of the cloud-like classes."""
    c = col(cls)
    bad = [CLOUD_MEDIUM, CLOUD_HIGH, UNCLASSIFIED, SNOW] + ([CLOUD_SHADOW] if shadow else []) + ([CIRRUS] if cirrus else [])
    return (c == WATER) & ~c.isin(*bad)


def is_land(occurrence) -> Column:
    """1 land, 0 water from a surface-water occurrence in percent; no data counts as land."""
    o = col(occurrence)
    return F.when((o >= WATER_OCCURRENCE) & (o <= 100), 0).otherwise(1)


def usable_land_mask(mask: DataFrame, image: str) -> DataFrame:
    """Mask pixels of images that are not all land; an all-land mask is an artefact."""
    good = mask.groupBy(image).agg(F.min("land").alias("_m")).filter("_m < 1").select(image)
    return mask.join(good, image, "left_semi")


def erode(mask: DataFrame, image: str, flag: str = "water") -> DataFrame:
    """Binary erosion by one pixel: a pixel stays when it and its four neighbours are set.

    Every set pixel votes for itself and its neighbours; a pixel with five votes stays, so the border
    cannot. One aggregate instead of four self joins.
    """
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    votes = (
        mask.filter(F.col(flag)).withColumn("_s", F.explode(steps))
        .groupBy(image, (F.col("r") + F.col("_s.dr")).alias("r"), (F.col("c") + F.col("_s.dc")).alias("c"))
        .agg(F.count("*").alias("_n")).filter("_n = 5").drop("_n").withColumn("_keep", F.lit(True))
    )
    return mask.join(votes, [image, "r", "c"], "left").withColumn(flag, F.coalesce("_keep", F.lit(False))).drop("_keep")


def in_convex_polygon(x, y, polygon) -> Column:
    """Is a point inside or on a convex polygon (array of x, y) of either orientation?"""
    p = col(polygon)
    n = F.size(p)
    nxt = F.concat(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), F.slice(p, 1, 1))
    side = F.zip_with(p, nxt, lambda a, b: (b["x"] - a["x"]) * (col(y) - a["y"]) - (b["y"] - a["y"]) * (col(x) - a["x"]))
    return (n >= 3) & (F.forall(side, lambda s: s >= 0) | F.forall(side, lambda s: s <= 0))


def in_ellipse(x, y, cx, cy, half_a, half_b, angle_deg) -> Column:
    """Is a point inside the ellipse with these half axes, turned by ``angle_deg``?"""
    t = F.radians(col(angle_deg))
    dx, dy = col(x) - col(cx), col(y) - col(cy)
    u, v = dx * F.cos(t) + dy * F.sin(t), dy * F.cos(t) - dx * F.sin(t)
    return (u / col(half_a)) * (u / col(half_a)) + (v / col(half_b)) * (v / col(half_b)) <= 1


def in_centre_box(r, c, size: int) -> Column:
    """The middle 40 % of a chip, used when no outline is known."""
    pad = int(size * 0.30)
    inside = lambda v: (col(v) >= pad) & (col(v) < size - pad)
    return inside(r) & inside(c)


# ---------------------------------------------------------------- statistics

def rgb_statistics(wide: DataFrame, image: str) -> DataFrame:
    """Chip colour statistics on a 0–255 scale: means, deviations, BT.709 brightness, contrast, red excess."""
    r, g, b = (F.col(f"b{i}") for i in range(3))
    grey = 0.2126 * r + 0.7152 * g + 0.0722 * b
    one = lambda x: F.bround(x, 1)
    return wide.groupBy(image).agg(
        *[one(F.avg(x)).alias(f"mean_{n}") for n, x in zip("rgb", (r, g, b))],
        *[one(F.stddev_pop(x)).alias(f"std_{n}") for n, x in zip("rgb", (r, g, b))],
        one(F.avg(grey)).alias("brightness_mean"), one(F.stddev_pop(grey)).alias("brightness_std"),
        one(F.stddev_pop(grey)).alias("contrast_rms"),
        F.bround((F.avg(r) - F.avg(b)) / F.greatest(F.avg(b), F.lit(1.0)), 4).alias("nir_proxy"),
    )


def cloud_tile_stats(wide: DataFrame, image: str, brightness=CLOUD_BRIGHTNESS, variance=CLOUD_VARIANCE) -> DataFrame:
    """Luma mean and variance per tile, whether it would be skipped as cloud, and the margins."""
    grey = 0.299 * F.col("b0") + 0.587 * F.col("b1") + 0.114 * F.col("b2")
    s = wide.groupBy(image).agg(F.avg(grey).alias("_m"), F.var_pop(grey).alias("_v"))
    return s.select(
        image, F.bround("_m", 1).alias("brightness_mean"), F.bround("_v", 1).alias("pixel_variance"),
        ((F.col("_m") > brightness) & (F.col("_v") < variance)).alias("would_skip"),
        F.bround(F.col("_m") - brightness, 1).alias("margin_brightness"),
        F.bround(variance - F.col("_v"), 1).alias("margin_variance"),
    )


def drop_cloud_tiles_rgb(tiles: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Tiles that are not a uniform bright cloud deck; tiles without statistics stay."""
    bad = stats.filter("would_skip").select(key)
    return tiles.join(bad, key, "left_anti")


def scl_fractions(classes: DataFrame, key) -> DataFrame:
    """Shares of cloud, cirrus, shadow and clear water per chip."""
    keys = [key] if isinstance(key, str) else list(key)
    share = lambda *codes: F.bround(F.avg(F.col("cls").isin(*codes).cast("int")), 4)
    return classes.groupBy(*keys).agg(
        share(CLOUD_MEDIUM, CLOUD_HIGH).alias("cloud_fraction"), share(CIRRUS).alias("cirrus_fraction"),
        share(CLOUD_SHADOW).alias("shadow_fraction"), share(WATER).alias("clear_water_fraction"),
    )


def drop_land_tiles(tiles: DataFrame, mask: DataFrame, image: str, key: str, block: int = 256) -> DataFrame:
    """Tiles (col0, row0, w, h) with at least one water pixel; tiles the mask does not cover stay."""
    s = window_statistics(tiles, mask, image, key, {"_land": F.avg("land")}, block)
    return s.filter(F.col("_land").isNull() | (F.col("_land") < 1.0)).drop("_land")


def drop_cloud_tiles_scl(tiles: DataFrame, classes: DataFrame, image: str, key: str, block: int = 256) -> DataFrame:
    """Tiles with at least one pixel that is no cloud class; uncovered tiles stay."""
    s = window_statistics(tiles, classes, image, key, {"_all": F.bool_and(F.col("cls").isin(*CLOUD_CLASSES))}, block)
    return s.filter(~F.coalesce("_all", F.lit(False))).drop("_all")


def land_fraction(windows: DataFrame, mask: DataFrame, image: str, key: str, block: int = 256) -> DataFrame:
    """Share of land pixels under each window; null off the mask."""
    return window_statistics(windows, mask, image, key, {"land_fraction": F.bround(F.avg("land"), 4)}, block)


def ocean_score(wide: DataFrame, image: str) -> DataFrame:
    """How much a colour preview looks like ocean, 0 to 1."""
    total = F.col("b0") + F.col("b1") + F.col("b2") + 1e-6
    red, green, blue = (F.avg(F.col(f"b{i}") / total) for i in range(3))
    score = 1.15 * blue - 0.35 * green - 0.2 * red + 0.1
    return wide.groupBy(image).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("ocean_score"))


def ocean_score_grey(pixels: DataFrame, image: str, v: str = "v") -> DataFrame:
    """Single-band fallback, never above 0.35."""
    s = F.avg(v) / 255.0
    return pixels.groupBy(image).agg(F.greatest(F.lit(0.0), F.least(F.lit(0.35), s)).alias("ocean_score"))


def crop_features(
    points: DataFrame, wide: DataFrame, image: str, key: str, half: float = 16.0, n: int = 32, block: int = 256
) -> DataFrame:
    """Mean and deviation of three bands on an n×n sample grid around each point.

    Sample positions run from -half to +half; off-image samples read 0. The grid is separable: a pixel
    counts as often as samples fall into its column times those in its row. So pixels meet points by block
    once, and each block is summed up before anything is shuffled again.
    """
    spots = points.select(image, "cx", "cy").distinct()
    step = [i * (2.0 * half / (n - 1)) - half for i in range(n)]
    cells = lambda v: F.transform(F.array(*[F.lit(d) for d in step]), lambda d: F.floor(F.col(v) + d).cast("int"))
    w = spots.withColumns({"_xs": cells("cx"), "_ys": cells("cy")})
    w = w.withColumns({"col0": F.get("_xs", 0), "row0": F.get("_ys", 0)})
    w = w.withColumns({"w": F.get("_xs", n - 1) - F.col("col0") + 1, "h": F.get("_ys", n - 1) - F.col("row0") + 1})
    times = lambda start, size, seq: F.transform(
        F.sequence(F.col(start), F.col(start) + F.col(size) - 1), lambda c: F.array_size(F.filter(seq, lambda x: x == c))
    )
    w = w.withColumns({"_kx": times("col0", "w", "_xs"), "_ky": times("row0", "h", "_ys")}).drop("_xs", "_ys")
    hit = window_pixels(w, wide.select(image, "r", "c", "b0", "b1", "b2"), image, block)
    k = F.get("_kx", F.col("c") - F.col("col0")) * F.get("_ky", F.col("r") - F.col("row0"))
    hit = hit.withColumn("_k", k)
    bands, total = ("b0", "b1", "b2"), float(n * n)
    sums = hit.groupBy(image, "cx", "cy").agg(
        *[F.sum(F.col("_k") * F.col(b)).alias(f"_s{b}") for b in bands],
        *[F.sum(F.col("_k") * F.col(b) * F.col(b)).alias(f"_q{b}") for b in bands],
    )
    mean = {b: F.coalesce(F.col(f"_s{b}"), F.lit(0.0)) / total for b in bands}
    spread = {b: F.sqrt(F.greatest(F.coalesce(F.col(f"_q{b}"), F.lit(0.0)) / total - mean[b] * mean[b], F.lit(0.0))) for b in bands}
    out = points.join(sums, [image, "cx", "cy"], "left")
    return out.select(
        *points.columns, *[mean[b].alias(f"mean_{x}") for b, x in zip(bands, "rgb")],
        *[spread[b].alias(f"std_{x}") for b, x in zip(bands, "rgb")],
    )


# ---------------------------------------------------------------- overview grid

def grid_cell(x, y, divisions: int = 10) -> Column:
    """Overview cell of a full-scene pixel: struct(grid_row, grid_col); needs width and height."""
    g = max(1, divisions)
    def one(v, size):
        return F.least(F.lit(g - 1), F.greatest(F.lit(0), (col(v) / F.greatest(F.col(size), F.lit(1)) * g).cast("int")))
    return F.struct(one(y, "height").alias("grid_row"), one(x, "width").alias("grid_col"))


def detections_per_cell(dets: DataFrame, image: str, divisions: int = 10) -> DataFrame:
    """Detections with their overview cell."""
    return dets.withColumn("_c", grid_cell("cx", "cy", divisions)).withColumns(
        {"grid_row": F.col("_c.grid_row"), "grid_col": F.col("_c.grid_col")}
    ).drop("_c")


def overview_grid(mask: DataFrame, dets: DataFrame, image: str, divisions: int = 10) -> DataFrame:
    """Per cell of each image with a mask: share of water pixels and number of detections.

    Cell edges are whole pixels, ``i * size // divisions``; a cell without pixels has share 0.
    """
    g = max(1, divisions)
    size = mask.groupBy(image).agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    # A pixel at r lies in the cell whose whole-pixel edges enclose it: the last i with i*size//g <= r.
    cell = lambda v, n: F.floor(((F.col(v) + 1) * g - 1) / F.col(n)).cast("int")
    water = (
        mask.join(size, image)
        .groupBy(image, cell("r", "_h").alias("grid_row"), cell("c", "_w").alias("grid_col"))
        .agg(F.avg(F.col("water").cast("int")).alias("water_fraction"))
    )
    hits = detections_per_cell(dets, image, g).groupBy(image, "grid_row", "grid_col").agg(F.count("*").alias("n_detections"))
    index = F.sequence(F.lit(0), F.lit(g - 1))
    frame = size.select(image).withColumn("grid_row", F.explode(index)).withColumn("grid_col", F.explode(index))
    keys = [image, "grid_row", "grid_col"]
    return frame.join(water, keys, "left").join(hits, keys, "left").fillna({"water_fraction": 0.0, "n_detections": 0})


def tile_feedback(grid: DataFrame) -> DataFrame:
    """Suggested feedback per overview cell from its water share and detections; null for mixed cells."""
    land, wet = F.col("water_fraction") <= LAND_TILE_MAX_WATER, F.col("water_fraction") >= WATER_TILE_MIN_WATER
    return grid.withColumn(
        "feedback",
        F.when(land & (F.col("n_detections") == 0), "land_empty").when(land, "land_false_detections")
        .when(wet, "mostly_water"),
    )


def auto_land_labels(grid: DataFrame, dets: DataFrame, labels: DataFrame, image: str, divisions: int = 10, tol: float = 3.0) -> DataFrame:
    """Detections on land cells that no label covers yet; these may become land labels."""
    from tidemark.operators.candidates import unlabelled

    bad = tile_feedback(grid).filter("feedback = 'land_false_detections'").select(image, "grid_row", "grid_col")
    on_land = detections_per_cell(dets, image, divisions).join(bad, [image, "grid_row", "grid_col"], "left_semi")
    return unlabelled(on_land, labels, tol, image=image).withColumn("review_category", F.lit("land"))
