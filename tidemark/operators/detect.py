"""Raw head outputs to detections: decoding, suppression, heading fusion and the scene pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import angles as A
from tidemark.functions import geo as G
from tidemark.functions.labels import col
from tidemark.functions.columns import pin
from tidemark.operators import candidates as C
from tidemark.operators import hulls as H
from tidemark.operators import pixels as P
from tidemark.operators import spatial as S
from tidemark.settings import DetectSettings

N_LANDMARKS = 8


def sigmoid(x, limit: float = 500.0) -> Column:
    v = F.greatest(F.lit(-limit), F.least(F.lit(limit), col(x)))
    return F.when(v >= 0, 1.0 / (1.0 + F.exp(-v))).otherwise(F.exp(v) / (1.0 + F.exp(v)))


def decode_heads(heads: DataFrame, threshold: float = 0.05, proposal_floor: float | None = None) -> DataFrame:
    """Scores, headings, wake vector and sizes from raw outputs (logit, hs, hc, hconf, wx, wy, wconf, …).

    With a proposal floor, rows below it are dropped. Without one, rows below the threshold keep their
    score and nothing else.
    """
    norm = lambda a, b: F.greatest(F.lit(1e-6), F.hypot(a, b))
    hn, wn = norm("hs", "hc"), norm("wx", "wy")
    heading = F.pmod(F.degrees(F.atan2(F.col("hs") / hn, F.col("hc") / hn)) + 360.0, F.lit(360.0))
    out = heads.withColumn("confidence", sigmoid("logit"))
    fields = {
        "heading_direct_deg": heading, "heading_direct_conf": sigmoid("hconf"),
        "wake_dx": F.col("wx") / wn, "wake_dy": F.col("wy") / wn, "wake_conf": sigmoid("wconf"),
        "length_norm": F.col("len_norm"), "width_norm": F.col("wid_norm"),
    }
    if proposal_floor is not None:
        out = out.filter(F.col("confidence") >= proposal_floor)
    else:
        ok = F.col("confidence") >= threshold
        zero = {"heading_direct_conf", "wake_conf"}
        fields = {n: F.when(ok, c).otherwise(F.lit(0.0 if n in zero else None).cast("double")) for n, c in fields.items()}
    return out.withColumns(fields).drop("hs", "hc", "hconf", "wx", "wy", "wconf", "len_norm", "wid_norm", "logit")


def landmarks_from_heatmaps(planes, h, w) -> Column:
    """Landmarks at the peaks of row-major heatmap planes: array of (x, y, conf) in scene pixels.

    Needs col0, row0, tile_w and tile_h on the row; the first peak in row order wins. A null plane gives a null landmark.
    """
    hh, ww = col(h), col(w)

    def one(plane):
        peak = F.array_max(plane)
        at = F.array_position(plane, peak) - 1
        nx = (at % ww) / F.greatest(ww - 1, F.lit(1))
        ny = F.floor(at / ww) / F.greatest(hh - 1, F.lit(1))
        return F.when(plane.isNotNull(), F.struct(
            (F.col("col0") + nx * F.col("tile_w")).alias("x"), (F.col("row0") + ny * F.col("tile_h")).alias("y"),
            sigmoid(peak, 32.0).alias("conf"),
        ))

    ok = (F.size(col(planes)) >= N_LANDMARKS) & (hh >= 2) & (ww >= 2)
    return F.when(ok, F.transform(F.slice(col(planes), 1, N_LANDMARKS), one))


def landmarks_from_points(points) -> Column:
    """Landmarks from normalised (x, y, visibility) logits."""
    return F.transform(F.slice(col(points), 1, N_LANDMARKS), lambda p: F.struct(
        (F.col("col0") + sigmoid(p["x"]) * F.col("tile_w")).alias("x"),
        (F.col("row0") + sigmoid(p["y"]) * F.col("tile_h")).alias("y"), sigmoid(p["v"]).alias("conf"),
    ))


def landmark_pair(landmarks) -> tuple[Column, Column]:
    """Bow and stern of a landmark array; null where the array is shorter."""
    return F.get(col(landmarks), 0), F.get(col(landmarks), 1)


def with_boxes(dets: DataFrame, polygon: str | None = "polygon") -> DataFrame:
    """Add x1, y1, x2, y2: bounds of the hull polygon, else the tile's rectangle."""
    chip = F.struct(
        F.col("col0").cast("double").alias("x1"), F.col("row0").cast("double").alias("y1"),
        (F.col("col0") + F.col("tile_w")).cast("double").alias("x2"), (F.col("row0") + F.col("tile_h")).cast("double").alias("y2"),
    )
    box = chip
    if polygon is not None:
        box = F.when(F.size(polygon) >= 3, G.polygon_box(polygon)).otherwise(chip)
    d = dets.withColumn("_b", box)
    return d.withColumns({c: F.col(f"_b.{c}") for c in ("x1", "y1", "x2", "y2")}).drop("_b")


def suppress(dets: DataFrame, iou: float = 0.45, *, image: str = "scene", score: str = "score", key: str = "det_id") -> DataFrame:
    """Greedy non-maximum suppression per scene on boxes x1, y1, x2, y2; equal scores go by ``key``."""
    return S.greedy_keep(
        dets, image=image, order=[-F.col(score), F.col(key)], boxes=("x1", "y1", "x2", "y2"), iou=iou
    )


def finalise(dets: DataFrame, land: DataFrame | None = None, *, cap: int | None = None, threshold: float = 0.05, image: str = "scene",
             key: str = "det_id", polygon: str | None = None) -> DataFrame:
    """Detections above the threshold with their rank in the scene, at their hull centre, off land.

    ``cap`` keeps the best so many of each scene, if the caller asks for it. ``land`` has (image, r, c, land).
    """
    w = W.partitionBy(image).orderBy(F.col("score").desc(), key)
    top = dets.withColumn("rank", F.row_number().over(w)).filter(F.col("score") >= threshold)
    if cap is not None:
        top = top.filter(F.col("rank") <= cap)
    if polygon is not None:
        at = G.polygon_centroid(polygon)
        has = F.coalesce(F.size(polygon) >= 3, F.lit(False))
    else:
        at, has = F.lit(None), F.lit(False)
    chip = F.struct((F.col("x1") + F.col("x2")).alias("sx"), (F.col("y1") + F.col("y2")).alias("sy"))
    cx = chip["sx"] / 2 if polygon is None else F.when(has, at["x"]).otherwise(F.col("col0") + F.col("tile_w") * 0.5)
    cy = chip["sy"] / 2 if polygon is None else F.when(has, at["y"]).otherwise(F.col("row0") + F.col("tile_h") * 0.5)
    top = top.withColumns({"cx": cx, "cy": cy})
    if land is None:
        return top
    spot = land.filter("land = 1").select(image, F.col("r").alias("_r"), F.col("c").alias("_c"))
    d = top.withColumns({"_r": F.rint("cy").cast("int"), "_c": F.rint("cx").cast("int")})
    return d.join(spot, [image, "_r", "_c"], "left_anti").drop("_r", "_c")


def _closest(a: Column, b: Column, target: Column) -> Column:
    d = lambda x: F.least(F.abs(x - target), 360.0 - F.abs(x - target))
    return F.when(d(a) <= d(b), a).otherwise(b)


def fuse_heading(keypoint="heading_keypoint_deg", axis="hull_axis_deg", wake="wake_side_deg", chroma="chroma_heading_deg",
                 chroma_pnr="chroma_pnr", direct="heading_direct_deg", direct_conf="heading_direct_conf") -> Column:
    """struct(heading_deg, source) by level: structures; hull with wake; hull with velocity; hull with model; hull.

    ``wake`` points from the hull to the wake and may be null; only then can the velocity decide. A hull
    axis alone is ambiguous by half a turn.
    """
    k, a, w, c, p, m, mc = (col(x) for x in (keypoint, axis, wake, chroma, chroma_pnr, direct, direct_conf))
    b = F.pmod(a + 180.0, F.lit(360.0))
    bow = F.pmod(w + 180.0, F.lit(360.0))
    pick = lambda h, s: F.struct(h.alias("heading_deg"), F.lit(s).alias("source"))
    return (
        F.when(k.isNotNull(), pick(k, "structures"))
        .when(a.isNotNull() & w.isNotNull(), pick(_closest(a, b, bow), "hull_wake_disambiguated"))
        .when(a.isNotNull() & (p >= 4.0) & c.isNotNull(), pick(_closest(a, b, c), "hull_chroma_disambiguated"))
        .when(a.isNotNull() & m.isNotNull() & (mc >= 0.6), pick(_closest(a, b, m), "hull_model_disambiguated"))
        .when(a.isNotNull(), pick(a, "hull_axis_ambiguous"))
        .otherwise(pick(F.lit(None).cast("double"), "none"))
    )


def shown_heading(fused="fused_deg", source="fused_source", axis="hull_axis_deg", chroma="chroma_heading_deg",
                  chroma_pnr="chroma_pnr", marker="heading_deg_from_north") -> Column:
    """Heading to display: the fused one, an ambiguous axis settled by velocity within 45°, else the markers'."""
    a, c = col(axis), col(chroma)
    b = F.pmod(a + 180.0, F.lit(360.0))
    da, db = A.angular_error(a, c), A.angular_error(b, c)
    ok = F.col(chroma_pnr) >= 2.0
    settled = F.when(ok & (da <= 45.0) & (da < db), a).when(ok & (db <= 45.0) & (db < da), b)
    finite = lambda h: F.when(~F.isnan(h) & (F.abs(h) < float("inf")), h)
    first = F.when(col(source) == "hull_axis_ambiguous", settled).otherwise(finite(col(fused)))
    return F.coalesce(first, finite(col(marker)))


def tiles_to_scan(scenes: DataFrame, land: DataFrame | None, classes: DataFrame | None, settings: DetectSettings,
                  luma: DataFrame | None = None) -> DataFrame:
    """Tiles worth scoring, with the reason for each that is not: scene, row0, col0, w, h, skipped.

    The cheap tests come before the model on purpose; Spark cannot move a filter across a Python function.
    ``luma`` gives tile brightness statistics (scene, row0, col0, would_skip).
    """
    tile, stride = P.tiling(settings.chip_half, settings.overlap)
    t = P.scene_tiles(scenes.select("scene", "width", "height"), tile, stride).withColumns({"w": F.lit(tile), "h": F.lit(tile)})
    t = t.withColumn("skipped", F.lit(None).cast("string"))
    if land is not None:
        t = P.window_statistics(t, land, "scene", "scene", {"_l": F.avg("land")}, settings.block).withColumn(
            "skipped", F.when(F.col("_l") >= 1.0, "land")).drop("_l")
    if luma is not None:
        bad = luma.filter("would_skip").select("scene", "row0", "col0", F.lit(True).alias("_y"))
        t = t.join(bad, ["scene", "row0", "col0"], "left").withColumn(
            "skipped", F.coalesce("skipped", F.when(F.col("_y"), "cloud"))).drop("_y")
    if classes is not None:
        t = P.window_statistics(
            t, classes, "scene", "scene", {"_a": F.bool_and(F.col("cls").isin(*P.CLOUD_CLASSES))}, settings.block
        ).withColumn("skipped", F.coalesce("skipped", F.when(F.col("_a"), "cloud"))).drop("_a")
    return t


def scene_candidates(heads: DataFrame, settings: DetectSettings, land: DataFrame | None = None, *, key: str = "tile_id",
                     polygon: str | None = None) -> DataFrame:
    """Head outputs per tile to final detections: decode, suppress, cap, centre, drop those on land."""
    d = decode_heads(heads, proposal_floor=settings.proposal_floor).withColumnRenamed("confidence", "score")
    d = with_boxes(d, polygon)
    kept = suppress(d, settings.nms_iou, key=key)
    return finalise(kept, land, cap=settings.max_detections, threshold=settings.threshold, key=key, polygon=polygon)


def scene_queue(heads: DataFrame, labels: DataFrame, settings: DetectSettings, land: DataFrame | None = None,
                pending: DataFrame | None = None, *, key: str = "tile_id", k: int = 15) -> DataFrame:
    """The whole path from head outputs to the review queue of each scene."""
    found = scene_candidates(heads, settings, land, key=key)
    clear = C.drop_reviewed_land(found, labels, settings.land_review_radius)
    return C.review_queue(clear, labels, pending, k=k, id_col=key)


def scene_counters(tiles: DataFrame, candidates: DataFrame, clear: DataFrame) -> DataFrame:
    """Per scene: tiles, tiles skipped by land and by cloud, detections, and those dropped as reviewed land."""
    t = tiles.groupBy("scene").agg(
        F.count("*").alias("tiles"), F.count_if(F.col("skipped") == "land").alias("land_skipped"),
        F.count_if(F.col("skipped") == "cloud").alias("cloud_skipped"),
    )
    a = candidates.groupBy("scene").agg(F.count("*").alias("detections"))
    b = clear.groupBy("scene").agg(F.count("*").alias("_clear"))
    out = t.join(a, "scene", "left").join(b, "scene", "left").fillna({"detections": 0, "_clear": 0})
    return out.withColumn("land_review_rejected", F.col("detections") - F.col("_clear")).drop("_clear")


def spot_records(spots: DataFrame, parts: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """One wide row per spot with fused and shown heading, agreement and every part's fields as ``det_*``.

    ``parts`` are tables with one row per spot: geometry, landmarks, velocity, spectral fields, classes.
    """
    out = spots
    for table in parts.values():
        clash = [c for c in table.columns if c != key and c in out.columns]
        out = out.join(table.drop(*clash), key, "left")
    need = {
        "heading_keypoint_deg": "double", "hull_axis_deg": "double", "wake_side_deg": "double", "chroma_heading_deg": "double",
        "chroma_pnr": "double", "heading_direct_deg": "double", "heading_direct_conf": "double", "heading_deg_from_north": "double",
    }
    for c, t in need.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    out = out.withColumn("_f", fuse_heading()).withColumns({"fused_deg": F.col("_f.heading_deg"), "fused_source": F.col("_f.source")}).drop("_f")
    out = out.withColumns({
        "shown_deg": shown_heading(),
        "chroma_agrees": F.when(
            F.col("chroma_heading_deg").isNotNull() & F.col("fused_deg").isNotNull(),
            A.headings_agree("chroma_heading_deg", "fused_deg"),
        ),
        "hull_axis_alt_deg": F.pmod(F.col("hull_axis_deg") + 180.0, F.lit(360.0)),
    })
    return out.select(*spots.columns, *[F.col(c).alias(f"det_{c}") for c in out.columns if c not in spots.columns])
