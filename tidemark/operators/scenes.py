"""Scene catalog: search, lookup, metadata, companion files, and repeated finds at one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geo as G
from tidemark.functions import labels as L
from tidemark.functions import names as N
from tidemark.operators import labels as LB

MIN_OCEAN_SCORE = 0.18


def catalog_search(
    items: DataFrame, bbox: tuple[float, float, float, float], start: str, end: str,
    max_cloud: float | None = 30.0, limit: int | None = None, collection: str = "sentinel-2-l2a",
) -> DataFrame:
    """Items of a collection whose box meets ``bbox`` (west, south, east, north) within a time range."""
    w, s, e, n = bbox
    hits = items.filter(
        (F.col("collection") == collection)
        & (F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s)
        & (F.col("datetime") >= F.lit(start).cast("timestamp")) & (F.col("datetime") <= F.lit(end).cast("timestamp"))
    )
    if max_cloud is not None:
        hits = hits.filter(F.col("cloud_cover") <= max_cloud)
    return hits.orderBy(F.col("datetime").desc(), "id").limit(limit) if limit is not None else hits


def catalog_get(items: DataFrame, ids: DataFrame | str) -> DataFrame:
    """One item by id, or many by a table of ids."""
    if isinstance(ids, str):
        return items.filter(F.col("id") == ids)
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def first_ocean_item(items: DataFrame, group: str, min_score: float = MIN_OCEAN_SCORE, max_try: int | None = None) -> DataFrame:
    """Per search, the first item whose preview looks like ocean among all results or the first ``max_try``.

    ``rank`` numbers the results of a search; items without a preview use up a try but never win.
    """
    good = items.filter(F.col("has_thumbnail") & (F.col("ocean_score") >= min_score))
    if max_try is not None:
        good = good.filter(F.col("rank") <= max_try)
    return good.groupBy(group).agg(F.min_by("id", "rank").alias("id"), F.min("rank").alias("rank"))


def item_centroid(geometry):
    """struct(lon, lat) of a GeoJSON geometry given as ``struct<type, coordinates: string JSON>``."""
    g = L.col(geometry)
    ring_type = "array<array<double>>"
    ring = (
        F.when(g["type"] == "Polygon", F.get(F.from_json(g["coordinates"], f"array<{ring_type}>"), 0))
        .when(g["type"] == "MultiPolygon", F.get(F.get(F.from_json(g["coordinates"], f"array<array<{ring_type}>>"), 0), 0))
        .when(g["type"] == "Point", F.array(F.from_json(g["coordinates"], "array<double>")))
    )
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda s, p: s + F.get(p, i)) / F.size(ring)
    return F.when(F.size(ring) > 0, F.struct(mean(0).alias("lon"), mean(1).alias("lat")))


def item_label(item_id, when, cloud):
    """Chooser line of an item: id, day, cloud share."""
    day = F.coalesce(F.substring(L.col(when).cast("string"), 1, 10), F.lit("?"))
    pct = F.concat(L.whole_number_text(cloud), F.lit("% cloud"))
    return F.concat_ws("  ·  ", L.col(item_id), day, pct)


def scene_files(scenes: DataFrame, files: DataFrame) -> DataFrame:
    """Per scene and extra band: expected file name and whether it is present."""
    bands = F.array(*[F.struct(F.lit(b[1]).alias("band"), F.lit(b[2]).alias("suffix")) for b in N.EXTRA_BANDS])
    want = scenes.select("scene", F.explode(bands).alias("b")).select("scene", "b.*")
    want = want.withColumn("file", N.band_path("scene", F.col("suffix")))
    have = files.select("file").distinct().withColumn("present", F.lit(True))
    return want.join(have, "file", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def band_availability(scenes: DataFrame, files: DataFrame) -> DataFrame:
    """Number of extra bands per scene and one line naming each with a tick or a cross."""
    order = F.array(*[F.lit(b[1]) for b in N.EXTRA_BANDS])
    marks = F.array_sort(F.collect_list(F.struct(
        F.array_position(order, F.col("band")).alias("i"),
        F.concat_ws(" ", "band", F.when(F.col("present"), "✓").otherwise("✗")).alias("t"),
    )))
    return scene_files(scenes, files).groupBy("scene").agg(
        F.count_if("present").alias("n_bands"),
        F.array_join(F.transform(marks, lambda m: m["t"]), "  ").alias("summary"),
    )


def missing_files(scenes: DataFrame, files: DataFrame, suffixes=N.VELOCITY_SUFFIXES) -> DataFrame:
    """Wanted band files no listing has."""
    want = scenes.select("scene", F.explode(F.array(*[F.lit(s) for s in suffixes])).alias("suffix"))
    want = want.withColumn("file", N.band_path("scene", F.col("suffix")))
    return want.join(files.select("file").distinct(), "file", "left_anti")


def class_raster_for_scene(scenes: DataFrame, files: DataFrame) -> DataFrame:
    """Class-raster file of each scene by naming rules; the first rule with a file wins.

    1 the same name with the class tag; 2 the same prefix; 3 the product id and the tag; 4 the product id,
    anything, the tag; 5 the short-name forms. Each rule is an equality join on a derived key.
    """
    name = F.col("scene")
    long_form = name.contains("TCI_10m")
    prefix = F.substring_index(name, "_TCI_10m", 1)
    pid = N.product_id("scene")
    short = name.contains("_TCI.jp2")
    bare = name.endswith("TCI.jp2") & ~long_form
    stem = F.regexp_replace(name, r"_*TCI\.jp2$", "")
    keys = [
        (1, "file", F.when(long_form, F.replace(name, F.lit("TCI_10m"), F.lit("SCL_20m")))),
        (2, "before_tag", F.when(long_form, prefix)),
        (3, "before_tag", F.when(long_form, pid)),
        (4, "product", F.when(long_form, pid)),
        (5, "file", F.when(short, F.replace(name, F.lit("_TCI.jp2"), F.lit("_SCL_20m.jp2")))),
        (6, "file", F.when(short, F.replace(name, F.lit("_TCI.jp2"), F.lit("_SCL.jp2")))),
        (7, "file", F.when(bare, F.concat(stem, F.lit("SCL_20m.jp2")))),
        (8, "file", F.when(bare, F.concat(stem, F.lit("SCL.jp2")))),
    ]
    rules = scenes.select("scene", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(k).alias("kind"), key.alias("key")) for r, k, key in keys
    ])).alias("q")).select("scene", "q.*").filter("key is not null")
    f = files.select("file").distinct().filter(F.col("file").contains("SCL"))
    tagged = F.col("file").contains("_SCL_20m") & F.col("file").endswith(".jp2")
    listing = f.select("file", F.explode(F.array(
        F.struct(F.lit("file").alias("kind"), F.col("file").alias("key")),
        F.struct(F.lit("before_tag").alias("kind"), F.when(tagged, F.substring_index("file", "_SCL_20m", 1)).alias("key")),
        F.struct(F.lit("product").alias("kind"), F.when(tagged, F.nullif(F.regexp_extract("file", N.PRODUCT_PATTERN + "_", 1), F.lit(""))).alias("key")),
    )).alias("q")).select("file", "q.*").filter("key is not null")
    best = rules.join(listing, ["kind", "key"]).groupBy("scene").agg(F.min_by("file", F.struct("rule", "file")).alias("class_file"))
    return scenes.select("scene").join(best, "scene", "left")


def with_georeference(points: DataFrame, scenes: DataFrame, image: str = "image_name") -> DataFrame:
    """Attach the scene's size and affine; the catalog is one row per scene."""
    s = scenes.select(F.col("scene").alias(image), "epsg", "a", "e", "x0", "y0", "width", "height")
    return points.join(s, image, "left")


def with_lonlat(points: DataFrame, scenes: DataFrame, *, image="image_name", x="cx_full", y="cy_full") -> DataFrame:
    """Add the position of each point; null where the scene is unknown or has no CRS."""
    out = G.add_lonlat(with_georeference(points, scenes, image), x, y)
    return out.drop("epsg", "a", "e", "x0", "y0", "width", "height")


def static_cells(witness: DataFrame, decimals: int = 4) -> DataFrame:
    """Sightings per lon/lat cell; the key is recomputed from the position."""
    return (
        witness.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .withColumn("_c", G.cell_key("lon", "lat", decimals))
        .groupBy(F.col("_c.cell_lon").alias("cell_lon"), F.col("_c.cell_lat").alias("cell_lat"))
        .agg(F.count("*").alias("hits"))
    )


def witness_summary(witness: DataFrame, min_hits: int = 2, decimals: int = 4) -> DataFrame:
    """One row: cells with at least ``min_hits`` sightings and all sightings with a position."""
    return static_cells(witness, decimals).agg(
        F.count_if(F.col("hits") >= min_hits).alias("n_hot_cells"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("n_rows"),
    )


def drop_static_sea(
    cands: DataFrame, scenes: DataFrame, cells: DataFrame, min_hits: int = 3, *, image="scene", x="cx", y="cy",
    decimals: int = 4,
) -> DataFrame:
    """Candidates outside cells seen at least ``min_hits`` times; rows without a position stay."""
    if min_hits <= 0:
        return cands
    hot = cells.filter(F.col("hits") >= min_hits).select("cell_lon", "cell_lat")
    pos = with_lonlat(cands, scenes, image=image, x=x, y=y).withColumn("_c", G.cell_key("lon", "lat", decimals))
    pos = pos.withColumns({"cell_lon": F.col("_c.cell_lon"), "cell_lat": F.col("_c.cell_lat")})
    return pos.join(hot, ["cell_lon", "cell_lat"], "left_anti").select(*cands.columns)


def size_bucket(length, width, tol: float = 0.28):
    """Bucket of both sides in units of ``tol`` times the longer side, hence a bucket of shape."""
    l, w = L.col(length), L.col(width)
    q = F.greatest(l, w, F.lit(1.0)) * tol
    return F.struct(F.bround(l / q).cast("int").alias("length_bucket"), F.bround(w / q).cast("int").alias("width_bucket"))


def static_vessel_clusters(
    labels: DataFrame, scenes: DataFrame, min_rows: int = 5, decimals: int = 4, tol: float = 0.28
) -> DataFrame:
    """Places where vessels of one shape were labelled again and again on at least two days."""
    rows = labels.filter(
        (F.col("record_type").isNull() | (F.col("record_type") == "")) & (F.col("review_category") == "vessel")
    )
    rows = LB.resolve_assets(rows, scenes).filter(F.col("resolved_path").isNotNull())
    d = L.pick_dims(positive=True)
    rows = with_lonlat(rows.drop("lon", "lat"), scenes).withColumn("_d", d)
    rows = rows.filter(F.col("lon").isNotNull() & F.col("_d").isNotNull())
    scale = 10.0**decimals
    # Rounding happens on the scaled value, not on the decimal text.
    rows = rows.withColumns({
        "cell_lon": F.rint(F.col("lon") * scale) / scale, "cell_lat": F.rint(F.col("lat") * scale) / scale,
        "_b": size_bucket("_d.length_m", "_d.width_m", tol), "_day": F.nullif(L.day_key("reviewed_at"), F.lit("")),
    })
    return (
        rows.groupBy("cell_lon", "cell_lat", F.col("_b.length_bucket").alias("length_bucket"),
                     F.col("_b.width_bucket").alias("width_bucket"))
        .agg(F.count("*").alias("n_rows"), F.count_distinct("_day").alias("n_days"),
             F.count_distinct("tci_path").alias("n_images"))
        .filter((F.col("n_rows") >= min_rows) & (F.col("n_days") >= 2))
        .orderBy(F.col("n_rows").desc(), F.col("n_images").desc(), "cell_lon", "cell_lat")
    )


def water_tiles(boxes: DataFrame, key: str) -> DataFrame:
    """Ten-degree source tiles that cover each box (west, south, east, north)."""
    steps = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / 10.0) * 10, F.floor(F.col(hi) / 10.0) * 10, F.lit(10)))
    return (
        boxes.select(key, "west", "south", "east", "north")
        .withColumn("_x", steps("west", "east")).withColumn("_y", steps("south", "north"))
        .select(key, G.water_tile_key(F.col("_x") + 0.5, F.col("_y") + 0.5).alias("tile"))
        .distinct()
    )


def stale_scenes(scenes: DataFrame, results: DataFrame, settings: dict) -> DataFrame:
    """Scenes with no result stored under the fingerprint of their inputs and these settings."""
    import json

    text = json.dumps(settings, sort_keys=True)
    finger = F.substring(F.sha2(F.concat_ws("|", "scene", F.col("version").cast("string"), F.lit(text)), 256), 1, 16)
    return scenes.withColumn("fingerprint", finger).join(
        results.select("scene", "fingerprint"), ["scene", "fingerprint"], "left_anti"
    )


def window_overlap(spots: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """Where a spot window (c0, r0, w, h) lies inside a wider window of the same key.

    Inclusive pixel corners relative to the wider window; pairs without a common pixel are left out.
    """
    r = wide.select(key, *[F.col(c).alias(f"_{c}") for c in ("c0", "r0", "w", "h")])
    j = spots.join(r, key)
    left, top = F.greatest("c0", "_c0"), F.greatest("r0", "_r0")
    right = F.least(F.col("c0") + F.col("w"), F.col("_c0") + F.col("_w"))
    bottom = F.least(F.col("r0") + F.col("h"), F.col("_r0") + F.col("_h"))
    return j.filter((left < right) & (top < bottom)).select(
        key, (left - F.col("_c0")).alias("px0"), (top - F.col("_r0")).alias("py0"),
        (right - F.col("_c0") - 1).alias("px1"), (bottom - F.col("_r0") - 1).alias("py1"),
    )


def rank_items(items: DataFrame, group: str) -> DataFrame:
    """Number the results of each search, newest first."""
    w = W.partitionBy(group).orderBy(F.col("datetime").desc(), "id")
    return items.withColumn("rank", F.row_number().over(w))
