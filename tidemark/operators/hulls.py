"""Hull geometry: markers to outlines, sizes and headings; outlines to centres and overlaps.

Markers are ``array<struct<role, x, y, hull>>`` in crop pixels, in the order they were placed; the crop's
origin is (col_off, row_off). Ground lengths and bearings need the scene's affine on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import geo as G
from tidemark.functions.columns import pin
from tidemark.functions.labels import col

CHIP_SIDE_M, MAX_SIDE_M = 1000.0, 600.0


# ---------------------------------------------------------------- markers

def for_hull(markers, hull: int = 1) -> Column:
    """Markers of one hull; anything but 2 is the first hull."""
    return F.filter(col(markers), lambda m: F.when(m["hull"] == 2, 2).otherwise(1) == hull)


def of_role(markers, *roles: str) -> Column:
    return F.filter(col(markers), lambda m: m["role"].isin(*roles))


def last_of(markers, role: str) -> Column:
    """The marker of a role placed last."""
    return F.try_element_at(of_role(markers, role), F.lit(-1))


def _last_two(markers, role: str) -> Column:
    m = of_role(markers, role)
    return F.when(F.size(m) >= 2, F.slice(m, -2, 2))


def side_pair(markers) -> Column:
    """Last two side markers, else port with starboard, as an array of two."""
    port, star = last_of(markers, "port"), last_of(markers, "starboard")
    return F.coalesce(_last_two(markers, "side"), F.when(port.isNotNull() & star.isNotNull(), F.array(port, star)))


def end_pair(markers) -> Column:
    return _last_two(markers, "end")


def wake_line(markers) -> Column:
    """All wake markers in order; null below two."""
    m = of_role(markers, "wake")
    return F.when(F.size(m) >= 2, m)


def _xy(m: Column) -> Column:
    return F.struct(m["x"].alias("x"), m["y"].alias("y"))


def add_hull_quad(df: DataFrame, markers: str = "markers", hull: int = 1, name: str = "quad") -> DataFrame:
    """Add the hull outline drawn by the markers, four corners by angle, or null.

    Keel ends (bow and stern, else two ends) with two side points give a keel-aligned rectangle whose edges
    pass through them. Two points give a thin box. Three or more give the smallest rectangle, padded. Wake
    markers never count. The choice of markers is columnar; only the rectangle is built in Arrow batches.
    """
    d = pin(df.withColumn("_qm", for_hull(markers, hull)), "_qm")
    m = F.col("_qm")
    bow, stern, ends = last_of(m, "bow"), last_of(m, "stern"), end_pair(m)
    keel = F.when(bow.isNotNull() & stern.isNotNull(), F.array(_xy(bow), _xy(stern))).otherwise(F.transform(ends, _xy))
    placed = F.filter(m, lambda q: (q["role"] != "wake") & q["x"].isNotNull() & q["y"].isNotNull())
    args = [xy for p in (placed, keel, side_pair(m)) for xy in _coordinates(p)]
    d = pin(d.withColumn("_qxy", _quad_udf()(*args)).drop("_qm"), "_qxy")
    return d.withColumn(name, _points("_qxy")).drop("_qxy")


def _coordinates(points: Column) -> tuple[Column, Column]:
    """Both coordinates of a point array as number arrays, which cross to Arrow batches without boxing."""
    return F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])


def _points(column: str) -> Column:
    """Point array from a struct of coordinate arrays; null for an empty one."""
    both = F.zip_with(F.col(f"{column}.x"), F.col(f"{column}.y"), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.when(F.size(F.col(f"{column}.x")) > 0, both)


_COORDINATES = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("x", "y")])


def _quads_frame(quads):
    """Coordinate arrays of a batch of outlines (or None) as the frame an Arrow function returns."""
    import pandas as pd

    xs = [None if q is None else [float(v[0]) for v in q] for q in quads]
    ys = [None if q is None else [float(v[1]) for v in q] for q in quads]
    return pd.DataFrame({"x": pd.Series(xs, dtype=object), "y": pd.Series(ys, dtype=object)})


def _quad_udf():
    import pandas as pd

    def batch(px: pd.Series, py: pd.Series, kx: pd.Series, ky: pd.Series, sx: pd.Series, sy: pd.Series) -> pd.DataFrame:
        from tidemark.functions import shapes as S

        pair = lambda x, y: None if x is None or y is None else list(zip(x, y))
        return _quads_frame([
            S.hull_quad(pair(a, b) or [], pair(c, d), pair(e, f)) for a, b, c, d, e, f in zip(px, py, kx, ky, sx, sy)
        ])

    batch.__annotations__ = {c: pd.Series for c in ("px", "py", "kx", "ky", "sx", "sy")} | {"return": pd.DataFrame}
    return F.pandas_udf(batch, _COORDINATES)


def _measure(fn, fields: list[str], *polygons) -> Column:
    """Numbers measured on one or two polygons per row by ``fn(points, …)``, a tuple or None, as a struct."""
    import pandas as pd

    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in fields])
    empty = (None,) * len(fields)

    def run(columns):
        rows = []
        for flat in zip(*columns):
            if any(c is None for c in flat):
                rows.append(empty)
                continue
            got = fn(*[list(zip(flat[i], flat[i + 1])) for i in range(0, len(flat), 2)])
            rows.append(empty if got is None else got)
        return pd.DataFrame(rows, columns=fields, dtype="float64")

    def one(ax: pd.Series, ay: pd.Series) -> pd.DataFrame:
        return run([ax, ay])

    def two(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
        return run([ax, ay, bx, by])

    batch = one if len(polygons) == 1 else two
    batch.__annotations__ = {c: pd.Series for c in ("ax", "ay", "bx", "by")[: 2 * len(polygons)]} | {"return": pd.DataFrame}
    return F.pandas_udf(batch, schema)(*[xy for p in polygons for xy in _coordinates(col(p))])


def _sides(points):
    from tidemark.functions import shapes as S

    found = S.smallest_rectangle(points) if len(points) >= 3 else None
    return None if found is None else found[1:]


def _axes(points):
    from tidemark.functions import shapes as S

    return S.longest_hull_edge_deg(points), S.principal_axis_deg(points)


def _iou(a, b):
    from tidemark.functions import shapes as S

    got = S.convex_iou(a, b)
    return None if got is None else (got,)


def add_oriented_size(df: DataFrame, polygon: str = "polygon") -> DataFrame:
    """Add ground length, width and aspect of the smallest rectangle around a polygon (scene pixels)."""
    p = col(polygon)
    mean = lambda f: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[f]) / F.size(p)
    d = df.withColumns({"_cx": mean("x"), "_cy": mean("y"), "_r": _measure(_sides, ["long_px", "short_px"], polygon)})
    gx, gy = G.ground_metres_per_pixel("_cx", "_cy")
    d = d.withColumn("_g", (gx + gy) / 2)
    ok = (F.col("_r.long_px") >= 1e-6) & (F.col("_g") > 0)
    length, width = F.col("_r.long_px") * F.col("_g"), F.col("_r.short_px") * F.col("_g")
    return d.withColumns({
        "length_m": F.when(ok, length), "width_m": F.when(ok, width),
        "aspect": F.when(ok, length / F.greatest(width, F.lit(1e-9))),
    }).drop("_cx", "_cy", "_r", "_g")


def add_axes(df: DataFrame, polygon: str = "polygon") -> DataFrame:
    """Add the directions of the longest hull edge and of the first principal axis, in degrees."""
    return df.withColumn("_a", _measure(_axes, ["edge_deg", "axis_deg"], polygon)).withColumns(
        {"edge_deg": F.col("_a.edge_deg"), "axis_deg": F.col("_a.axis_deg")}
    ).drop("_a")


def add_polygon_iou(df: DataFrame, a: str, b: str, name: str = "iou") -> DataFrame:
    """Add the overlap of two convex outlines."""
    return df.withColumn("_i", _measure(_iou, ["iou"], a, b)).withColumn(name, F.col("_i.iou")).drop("_i")


# ---------------------------------------------------------------- sizes and headings

def _corner(quad: str, i: int, f: str, off: str) -> Column:
    return F.get(quad, i % 4)[f] + F.col(off)


def add_quad_sides(df: DataFrame, quad: str = "quad") -> DataFrame:
    """Add the shorter and longer ground side of a four-corner outline, opposite sides averaged.

    ``_e0 … _e3`` stay on the row for callers that need the sides themselves.
    """
    e = {
        f"_e{i}": G.ground_distance(_corner(quad, i, "x", "col_off"), _corner(quad, i, "y", "row_off"),
                                    _corner(quad, i + 1, "x", "col_off"), _corner(quad, i + 1, "y", "row_off"))
        for i in range(4)
    }
    d = pin(df.withColumns(e), *e)
    a, b = (F.col("_e0") + F.col("_e2")) / 2, (F.col("_e1") + F.col("_e3")) / 2
    return d.withColumns({"shorter_m": F.least(a, b), "longer_m": F.greatest(a, b)})


def add_keel_heading(df: DataFrame, quad: str = "quad", markers: str = "markers", hull: int = 1) -> DataFrame:
    """Add keel heading, its opposite and its source from an outline (corners by angle).

    The keel joins the middles of the two shorter sides. Bow and stern markers only decide which way it
    points; without them both bearings are equally good.
    """
    d = pin(add_quad_sides(df, quad).withColumn("_m", for_hull(markers, hull)), "_m")
    mid = lambda i, j, f, off: (_corner(quad, i, f, off) + _corner(quad, j, f, off)) / 2
    first = (F.col("_e0") + F.col("_e2")) <= (F.col("_e1") + F.col("_e3"))
    pts = {}
    for n, (i, j), (k, l) in (("a", (0, 1), (1, 2)), ("b", (2, 3), (3, 4))):
        for f, off in (("x", "col_off"), ("y", "row_off")):
            pts[f"_{n}{f}"] = F.when(first, mid(i, j, f, off)).otherwise(mid(k, l, f, off))
    bow, stern = last_of("_m", "bow"), last_of("_m", "stern")
    d = pin(d.withColumns({**pts, "_bow": bow, "_stern": stern}), *pts, "_bow", "_stern")
    known = F.col("_bow").isNotNull() & F.col("_stern").isNotNull()
    dot = (F.col("_bx") - F.col("_ax")) * (F.col("_bow.x") - F.col("_stern.x")) + (F.col("_by") - F.col("_ay")) * (
        F.col("_bow.y") - F.col("_stern.y"))
    turn = F.coalesce(known & (dot < 0), F.lit(False))
    swap = lambda p, q: F.when(turn, F.col(q)).otherwise(F.col(p))
    d = d.withColumns({"_x1": swap("_ax", "_bx"), "_y1": swap("_ay", "_by"), "_x2": swap("_bx", "_ax"), "_y2": swap("_by", "_ay")})
    d = G.add_bearing(d, "_x1", "_y1", "_x2", "_y2", "_h")
    full = F.col(quad).isNotNull() & (F.size(quad) == 4) & F.col("_h").isNotNull()
    return d.withColumns({
        "heading_deg": F.when(full, F.bround("_h", 6)),
        "heading_alt_deg": F.when(full, F.bround(F.pmod(F.col("_h") + 180.0, F.lit(360.0)), 6)),
        "heading_source": F.when(full, F.when(known, "keel_quad_bow_stern").otherwise("keel_quad_ambiguous")),
    }).select(*df.columns, "shorter_m", "longer_m", "heading_deg", "heading_alt_deg", "heading_source")


def add_marker_metrics(df: DataFrame, markers: str = "markers", hull: int = 1) -> DataFrame:
    """Add length, width and heading (with source and opposite) measured between markers.

    Heading sources in order: bow and stern, two ends (ambiguous), stern and wake point, wake line, bridge
    and bow. Length comes from bow–stern, else the ends; width from port–starboard, else two sides.
    """
    d = pin(df.withColumn("_m", for_hull(markers, hull)), "_m")
    found = {f"_{r}": last_of("_m", r) for r in ("bow", "stern", "port", "starboard", "wake", "bridge")}
    found |= {"_ends": end_pair("_m"), "_line": wake_line("_m"), "_sides": side_pair("_m")}
    d = pin(d.withColumns(found), *found)
    c = lambda n: F.col(f"_{n}")
    seg = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    has = lambda *ns: _all_set([c(n) for n in ns])
    e0, e1 = F.get("_ends", 0), F.get("_ends", 1)
    w0, w1 = F.get("_line", 0), F.try_element_at("_line", F.lit(-1))
    d = d.withColumns({
        "_len": F.when(has("bow", "stern"), seg(c("stern"), c("bow"))).when(c("ends").isNotNull(), seg(e0, e1)),
        "_wid": F.when(has("port", "starboard"), seg(c("port"), c("starboard"))).when(
            c("sides").isNotNull(), seg(F.get("_sides", 0), F.get("_sides", 1))),
        "_src": F.when(has("bow", "stern"), "bow_stern").when(c("ends").isNotNull(), "ambiguous_end_end")
        .when(has("wake", "stern"), "wake_stern").when(c("line").isNotNull(), "wake_polyline")
        .when(has("bridge", "bow"), "bridge_bow"),
    })
    s = c("src")
    d = d.withColumn("_dir", F.when(s.isin("bow_stern", "ambiguous_end_end"), c("len")).when(
        s == "wake_stern", seg(c("stern"), c("wake"))).when(s == "wake_polyline", seg(w0, w1)).when(
        s == "bridge_bow", seg(c("bridge"), c("bow"))))
    d = pin(d, "_len", "_wid", "_src", "_dir")
    full = lambda n: [F.col(f"_{n}.{f}") + F.col(o) for f, o in (("x1", "col_off"), ("y1", "row_off"), ("x2", "col_off"), ("y2", "row_off"))]
    d = d.withColumns({"length_m": F.when(c("len").isNotNull(), G.ground_distance(*full("len"))),
                       "width_m": F.when(c("wid").isNotNull(), G.ground_distance(*full("wid")))})
    d = G.add_bearing(d, *full("dir"), "_h")
    d = d.withColumn("_wl", F.when(c("line").isNotNull(), seg(w0, w1)))
    d = G.add_bearing(d, *full("wl"), "_hw")
    back = lambda h: F.pmod(h + 180.0, F.lit(360.0))
    heading = F.when(s.isin("wake_stern", "wake_polyline"), back(F.col("_h"))).otherwise(F.col("_h"))
    return d.withColumns({
        "heading_deg": heading, "heading_alt_deg": F.when(s == "ambiguous_end_end", back(F.col("_h"))),
        "heading_source": F.when(F.col("_h").isNotNull(), s), "wake_direction_deg": F.bround(back(F.col("_hw")), 1),
    }).select(*df.columns, "length_m", "width_m", "heading_deg", "heading_alt_deg", "heading_source", "wake_direction_deg")


def _all_set(cols: list[Column]) -> Column:
    out = cols[0].isNotNull()
    for x in cols[1:]:
        out = out & x.isNotNull()
    return out


def add_heading_truth(df: DataFrame, markers: str = "markers", chip_half: int | None = None) -> DataFrame:
    """Add heading truth with its source and the labelled outline in scene pixels.

    The stored heading wins, else the bearing from stern to bow. Markers are placed by the stored crop
    origin; ``chip_half`` places rows without one by the corner of a chip of that half size.
    """
    col0, row0 = F.col("marker_origin_col"), F.col("marker_origin_row")
    if chip_half is not None:
        col0 = F.coalesce(col0, F.rint(F.col("cx_full") - chip_half).cast("int"))
        row0 = F.coalesce(row0, F.rint(F.col("cy_full") - chip_half).cast("int"))
    d = pin(df.withColumns({"col_off": col0, "row_off": row0, "_m": for_hull(markers, 1)}), "_m")
    d = pin(d.withColumns({"_bow": last_of("_m", "bow"), "_stern": last_of("_m", "stern")}), "_bow", "_stern")
    at = lambda n, f, o: F.col(f"_{n}.{f}") + F.col(o)
    d = G.add_bearing(d, at("stern", "x", "col_off"), at("stern", "y", "row_off"), at("bow", "x", "col_off"),
                      at("bow", "y", "row_off"), "_h")
    d = add_hull_quad(d, markers, 1, "_q")
    stored = F.col("heading_deg_from_north")
    return d.withColumns({
        "gt_heading_deg": F.coalesce(stored, F.col("_h")),
        "gt_heading_source": F.when(stored.isNotNull(), "heading_deg_from_north").when(
            F.col("_h").isNotNull(), "bow_stern_markers").otherwise("none"),
        "gt_outline": F.transform("_q", lambda p: F.struct(
            (p["x"] + F.col("col_off")).alias("x"), (p["y"] + F.col("row_off")).alias("y"))),
    }).select(*df.columns, "gt_heading_deg", "gt_heading_source", "gt_outline")


# ---------------------------------------------------------------- outlines from pixels

def outline_centres(df: DataFrame) -> DataFrame:
    """Centre of the outline box per row: markers, manual quad, bright blob, else a square box.

    Needs ``marker_quad, manual_quad, blob_quad`` (crop pixels, any may be null), ``px, py, h, w, gsd_m,
    col_off, row_off``. Adds ``outline``, ``outline_source``, ``cx_new`` and ``cy_new``.
    """
    half = F.least(
        F.greatest(F.lit(4), F.floor(F.least("h", "w") / 8)).cast("double"),
        MAX_SIDE_M / 2 / F.when(F.col("gsd_m") > 0, F.col("gsd_m")).otherwise(10.0),
    )
    edge = lambda v, size: F.greatest(F.lit(0.0), F.least(F.rint(v), (F.col(size) - 1).cast("double")))
    x0, x1 = edge(F.col("px") - half, "w"), edge(F.col("px") + half, "w")
    y0, y1 = edge(F.col("py") - half, "h"), edge(F.col("py") + half, "h")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1))
    four = lambda c: F.col(c).isNotNull() & (F.size(c) == 4)
    d = df.withColumns({
        "outline_source": F.when(four("marker_quad"), "markers").when(four("manual_quad"), "manual")
        .when(four("blob_quad"), "pca").otherwise("fallback"),
        "outline": F.when(four("marker_quad"), F.col("marker_quad")).when(four("manual_quad"), F.col("manual_quad"))
        .when(four("blob_quad"), F.col("blob_quad")).otherwise(box),
    })
    b = G.polygon_box("outline")
    return d.withColumn("_b", b).withColumns({
        "cx_new": (F.col("_b.x1") + F.col("_b.x2")) / 2 + F.col("col_off"),
        "cy_new": (F.col("_b.y1") + F.col("_b.y2")) / 2 + F.col("row_off"),
    }).drop("_b")


def recentre(labels: DataFrame, centres: DataFrame) -> DataFrame:
    """Move label centres to their outline centres; ``status`` says what happened to each row.

    ``centres`` has (id, cx_new, cy_new); ``labels`` carries ``resolved_path``. Identity fields of point
    rows must be refreshed from the new centre by the caller's projection.
    """
    c = centres.select("id", "cx_new", "cy_new", F.lit(True).alias("_hit"))
    d = labels.join(c, "id", "left")
    tile = F.coalesce(F.col("record_type") == "overview_grid_tile", F.lit(False))
    bad = F.col("cx_full").isNull() | F.col("cy_full").isNull() | (F.col("cx_full") < 0) | (F.col("cy_full") < 0)
    same = (F.abs(F.col("cx_new") - F.col("cx_full")) < 1e-4) & (F.abs(F.col("cy_new") - F.col("cy_full")) < 1e-4)
    status = (
        F.when(tile, "skipped_record_type").when(bad | (F.trim("tci_path") == ""), "skipped_invalid_xy")
        .when(F.col("resolved_path").isNull(), "missing_file").when(F.col("_hit").isNull(), "error")
        .when(same, "unchanged").otherwise("updated")
    )
    moved = F.col("status") == "updated"
    return d.withColumn("status", status).withColumns({
        "cx_full": F.when(moved, F.col("cx_new")).otherwise(F.col("cx_full")),
        "cy_full": F.when(moved, F.col("cy_new")).otherwise(F.col("cy_full")),
    }).drop("cx_new", "cy_new", "_hit")
