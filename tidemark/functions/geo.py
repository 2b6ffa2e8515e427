"""Pixel, map and ground geometry as column expressions.

Pixels count columns (x) to the right and rows (y) downward; a map position is taken at the pixel
centre. A scene row carries ``epsg, a, e, x0, y0, width, height``: pixel size, origin and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import pin
from tidemark.functions.labels import col

# WGS84 and the transverse Mercator constants of UTM.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EAST = 500000.0
UTM_FALSE_NORTH_SOUTH = 10000000.0
METRES_PER_DEGREE = 111320.0
BATCH_CELLS = 2_000_000  # numbers in one array of a batch of outlines

_N = WGS84_F / (2 - WGS84_F)
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def pixel_distance(x1, y1, x2, y2, metres_per_pixel) -> Column:
    """Ground distance at one fixed scale; a non-positive scale is an error."""
    m = col(metres_per_pixel) if not isinstance(metres_per_pixel, (int, float)) else F.lit(float(metres_per_pixel))
    d = F.hypot((col(x2) - col(x1)) * m, (col(y2) - col(y1)) * m)
    return F.when(m > 0, d).otherwise(F.raise_error(F.lit("metres_per_pixel must be positive")).cast("double"))


def map_x(x) -> Column:
    return F.col("x0") + (col(x) + 0.5) * F.col("a")


def map_y(y) -> Column:
    return F.col("y0") + (col(y) + 0.5) * F.col("e")


def is_geographic() -> Column:
    return F.col("epsg") == 4326


def is_utm() -> Column:
    return F.col("epsg").between(32601, 32660) | F.col("epsg").between(32701, 32760)


def add_map_lonlat(df: DataFrame, mx: Column, my: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add WGS84 columns for a map position: inverse UTM by the Krueger series of order four.

    The steps are separate projections. Each intermediate value is used several times, and Spark keeps
    such projections apart, so every series is evaluated once and the generated code stays small.
    """
    epsg = F.col("epsg")
    south = epsg >= 32700
    k = UTM_SCALE * _RECT
    out = df.withColumns({"_mx": mx, "_my": my}).withColumns({
        "_xi": (F.col("_my") - F.when(south, UTM_FALSE_NORTH_SOUTH).otherwise(0.0)) / k,
        "_eta": (F.col("_mx") - UTM_FALSE_EAST) / k,
    })
    xi, eta = F.col("_xi"), F.col("_eta")
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    out = out.withColumns({"_xi1": xi1, "_eta1": eta1})
    out = out.withColumn("_chi", F.asin(F.sin("_xi1") / F.cosh("_eta1")))
    chi = F.col("_chi")
    rad = chi
    for j, d in enumerate(_DELTA, start=1):
        rad = rad + d * F.sin(2 * j * chi)
    lon_utm = F.degrees(F.atan2(F.sinh("_eta1"), F.cos("_xi1"))) + central_meridian()
    return out.withColumns({
        lon: F.when(is_geographic(), F.col("_mx")).when(is_utm(), lon_utm),
        lat: F.when(is_geographic(), F.col("_my")).when(is_utm(), F.degrees(rad)),
    }).drop("_mx", "_my", "_xi", "_eta", "_xi1", "_eta1", "_chi")


def central_meridian() -> Column:
    epsg = F.col("epsg")
    return F.when(epsg >= 32700, epsg - 32700).otherwise(epsg - 32600) * 6.0 - 183.0


def add_lonlat(df: DataFrame, x, y, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add the position of a pixel centre; null where the scene has no usable CRS."""
    return add_map_lonlat(df, map_x(x), map_y(y), lon, lat)


def ground_metres_per_pixel(x, y) -> tuple[Column, Column]:
    """Ground sampling distance at the pixel nearest (x, y)."""
    lat = map_y(F.rint(col(y)))
    rx, ry = F.abs("a"), F.abs("e")
    geo = F.coalesce(is_geographic(), F.lit(False))
    return (
        F.when(geo, rx * (METRES_PER_DEGREE * F.cos(F.radians(lat)))).otherwise(rx),
        F.when(geo, ry * METRES_PER_DEGREE).otherwise(ry),
    )


def scene_metres_per_pixel() -> tuple[Column, Column]:
    """Ground sampling distance at the scene centre."""
    return ground_metres_per_pixel(F.floor(F.col("width") / 2), F.floor(F.col("height") / 2))


def window_side(metres: float | Column) -> Column:
    """Window side in pixels for a ground length, from the mean scene scale (10 m when unusable)."""
    gx, gy = scene_metres_per_pixel()
    g = (gx + gy) / 2
    g = F.when((g > 0) & ~F.isnan(g), g).otherwise(10.0)
    m = metres if isinstance(metres, Column) else F.lit(float(metres))
    return F.greatest(F.lit(1), F.rint(m / g).cast("int"))


def crop_window(cx, cy, side: Column | int) -> Column:
    """Square window around a point, shifted to stay inside the scene: struct(col0,row0,w,h)."""
    s = side if isinstance(side, Column) else F.lit(int(side))
    half = F.floor(s / 2).cast("int")

    def start(c, limit):
        raw = F.rint(col(c)).cast("int") - half
        return F.greatest(F.lit(0), F.least(raw, F.greatest(F.lit(0), limit - s)))

    c0, r0 = start(cx, F.col("width")), start(cy, F.col("height"))
    return F.struct(
        c0.alias("col0"), r0.alias("row0"),
        F.least(s, F.col("width") - c0).alias("w"), F.least(s, F.col("height") - r0).alias("h"),
    )


def to_downsampled(x, y, w, h) -> tuple[Column, Column]:
    """Full-scene pixel to overview pixel, clamped into the overview."""
    def one(v, size, full):
        return F.greatest(
            F.lit(0.0),
            F.least(col(v) / F.greatest(F.col(full), F.lit(1)) * size, F.greatest(size - 1, F.lit(0)).cast("double")),
        )
    return one(x, col(w), "width"), one(y, col(h), "height")


def from_downsampled(x, y, w, h) -> tuple[Column, Column]:
    return col(x) / col(w) * F.col("width"), col(y) / col(h) * F.col("height")


def shift_points(points, dx, dy) -> Column:
    """Move every point of ``array<struct<x,y,…>>``; other fields stay."""
    return F.transform(
        col(points), lambda p: p.withField("x", p["x"] + dx).withField("y", p["y"] + dy)
    )


def polygon_box(points) -> Column:
    p = col(points)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"),
        F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"),
    )


def polygon_centroid(points) -> Column:
    """Area centroid; the mean of the corners when there are fewer than three or no area."""
    p = col(points)
    n = F.size(p)
    mean = lambda f: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[f]) / n
    nxt = F.concat(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), F.slice(p, 1, 1))
    cross = F.zip_with(
        p, nxt,
        lambda q, r: F.struct(
            (q["x"] * r["y"] - r["x"] * q["y"]).alias("c"), (q["x"] + r["x"]).alias("sx"),
            (q["y"] + r["y"]).alias("sy"),
        ),
    )
    total = lambda f: F.aggregate(cross, F.lit(0.0), lambda s, q: s + f(q))
    area = 0.5 * total(lambda q: q["c"])
    flat = (n < 3) | (F.abs(area) < 1e-9)
    return F.when(
        flat, F.struct(mean("x").alias("x"), mean("y").alias("y"))
    ).otherwise(
        F.struct(
            F.try_divide(total(lambda q: q["sx"] * q["c"]), 6.0 * area).alias("x"),
            F.try_divide(total(lambda q: q["sy"] * q["c"]), 6.0 * area).alias("y"),
        )
    )


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two axis-aligned boxes given as x1,y1,x2,y2 columns."""
    zero = F.lit(0.0)
    iw = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    ih = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = iw * ih
    size = lambda q: F.greatest(zero, q["x2"] - q["x1"]) * F.greatest(zero, q["y2"] - q["y1"])
    union = size(a) + size(b) - inter
    return F.when((inter > 0) & (union > 1e-12), inter / union).otherwise(0.0)


def polygon_edges(polygon) -> Column:
    """array<struct(x, y, u, v)>: each edge of an outline from (x, y) to (u, v); the last one leads back to the first point."""
    p = col(polygon)
    ahead = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    return F.zip_with(p, ahead, lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("u"), b["y"].alias("v")))


def in_polygon(x, y, polygon) -> Column:
    """Is a point inside or on an outline of any simple shape? Even-odd rule over the edges; fewer than three points hold none."""
    px, py = col(x), col(y)
    edges = polygon_edges(polygon)
    side = lambda e: (e["u"] - e["x"]) * (py - e["y"]) - (e["v"] - e["y"]) * (px - e["x"])
    on = lambda e: (
        (side(e) == 0) & (px >= F.least(e["x"], e["u"])) & (px <= F.greatest(e["x"], e["u"]))
        & (py >= F.least(e["y"], e["v"])) & (py <= F.greatest(e["y"], e["v"]))
    )
    # The edge reaches the height of the point and passes it on its right.
    passed = lambda e: ((e["y"] > py) != (e["v"] > py)) & ((side(e) > 0) == (e["v"] > e["y"]))
    return (F.size(col(polygon)) >= 3) & (F.exists(edges, on) | (F.size(F.filter(edges, passed)) % 2 == 1))


def polygon_area(polygon) -> Column:
    """Area of a simple outline of any shape."""
    twice = F.transform(polygon_edges(polygon), lambda e: e["x"] * e["v"] - e["u"] * e["y"])
    return F.abs(F.aggregate(twice, F.lit(0.0), lambda s, x: s + x)) / 2


def _overlaps(a, b):
    """Common areas and summed areas of n pairs of outlines, arrays (n, corners, 2).

    The heights of all corners and crossings cut both outlines into slabs. Inside a slab no two edges change their order, so
    the common length grows linearly, and its middle times the slab's height is its area.
    """
    import numpy as np

    ends = lambda p: (p, np.roll(p, -1, axis=1))
    (p, q), (r, s) = ends(a), ends(b)
    area = lambda u, v: np.abs((u[..., 0] * v[..., 1] - v[..., 0] * u[..., 1]).sum(axis=1)) / 2
    # Crossings of every edge of one outline with every edge of the other.
    along, other, gap = (q - p)[:, :, None], (s - r)[:, None], r[:, None] - p[:, :, None]
    det = along[..., 0] * other[..., 1] - along[..., 1] * other[..., 0]
    t = (gap[..., 0] * other[..., 1] - gap[..., 1] * other[..., 0]) / det
    w = (gap[..., 0] * along[..., 1] - gap[..., 1] * along[..., 0]) / det
    met = (det != 0) & (t >= 0) & (t <= 1) & (w >= 0) & (w <= 1)
    heights = np.where(met, p[:, :, None, 1] + t * along[..., 1], np.nan).reshape(len(a), -1)
    ys = np.sort(np.concatenate([heights, a[..., 1], b[..., 1]], axis=1), axis=1)  # those that are not met come last
    ys = ys[:, : int((~np.isnan(ys)).sum(axis=1).max())]

    def spans(u, v, y):
        """Ends (n, slabs, k) of the stretches inside an outline at the heights (n, slabs); infinite where there are fewer."""
        u, v, y = u[:, None], v[:, None], y[..., None]
        cut = (u[..., 1] > y) != (v[..., 1] > y)
        x = u[..., 0] + (y - u[..., 1]) * (v[..., 0] - u[..., 0]) / np.where(cut, v[..., 1] - u[..., 1], 1.0)
        x = np.sort(np.where(cut, x, np.inf), axis=-1)[..., : 2 * (u.shape[2] // 2)]
        most = int(np.isfinite(x).sum(axis=-1).max(initial=0)) // 2 * 2
        return x[..., 0:most:2], x[..., 1:most:2]

    common = np.zeros(len(a))
    step = max(1, BATCH_CELLS // (len(a) * (a.shape[1] + b.shape[1] + (a.shape[1] * b.shape[1]) // 4)))
    for i in range(0, ys.shape[1] - 1, step):
        low, high = ys[:, i : i + step], ys[:, i + 1 : i + step + 1]
        low = low[:, : high.shape[1]]
        (al, ah), (bl, bh) = spans(p, q, (low + high) / 2), spans(r, s, (low + high) / 2)
        both = np.minimum(ah[..., :, None], bh[..., None, :]) - np.maximum(al[..., :, None], bl[..., None, :])
        both = np.where(np.isfinite(ah)[..., :, None] & np.isfinite(bh)[..., None, :], np.maximum(both, 0.0), 0.0)
        common += np.where(high > low, (high - low) * both.sum(axis=(2, 3)), 0.0).sum(axis=1)
    return common, area(p, q) + area(r, s)


def _outline_iou(ax, ay, bx, by):
    """Overlaps of a batch of outlines given as coordinate arrays (or None); outlines of equal sizes are measured together."""
    import numpy as np

    groups, out = {}, np.zeros(len(ax))
    for i, row in enumerate(zip(ax, ay, bx, by)):
        if all(c is not None for c in row) and len(row[0]) >= 3 and len(row[2]) >= 3:
            groups.setdefault((len(row[0]), len(row[2])), []).append(i)
    for (n, m), rows in groups.items():
        size = max(1, BATCH_CELLS // (n * m + n + m))
        for at in (rows[k : k + size] for k in range(0, len(rows), size)):
            points = lambda x, y: np.stack([np.stack([c[i] for i in at]) for c in (x, y)], axis=-1).astype(float)
            a, b = points(ax, ay), points(bx, by)
            whole = ~(np.isnan(a).any(axis=(1, 2)) | np.isnan(b).any(axis=(1, 2)))
            if not whole.any():
                continue
            with np.errstate(all="ignore"):
                common, both = _overlaps(a[whole], b[whole])
                union = both - common
                out[np.array(at)[whole]] = np.where((common > 0) & (union > 1e-12), common / union, 0.0)
    return out


def add_outline_iou(df: DataFrame, a: str, b: str, name: str = "iou") -> DataFrame:
    """Add the overlap of two simple outlines of any shape, concave ones included, as intersection over union.

    Outlines are measured in Arrow batches by slabs, see :func:`_overlaps`. An outline that is null, has fewer than three
    points, a point without a number or no area overlaps with nothing.
    """
    import pandas as pd

    def batch(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series(_outline_iou(ax, ay, bx, by))

    batch.__annotations__ = {c: pd.Series for c in ("ax", "ay", "bx", "by", "return")}
    axis = lambda p, f: F.transform(F.col(p), lambda q: q[f].cast("double"))
    return df.withColumn(name, F.pandas_udf(batch, "double")(*[axis(p, f) for p in (a, b) for f in ("x", "y")]))


def add_convergence(df: DataFrame, x, y, name: str = "convergence_deg") -> DataFrame:
    """Add the angle of grid north from true north in degrees; 0 outside UTM. Uses the pixel corner."""
    mx = F.col("x0") + col(x) * F.col("a")
    my = F.col("y0") + col(y) * F.col("e")
    gamma = F.degrees(F.atan(F.tan(F.radians(F.col("_lon") - central_meridian())) * F.sin(F.radians("_lat"))))
    return add_map_lonlat(df, mx, my, "_lon", "_lat").withColumn(
        name, F.when(F.coalesce(is_utm(), F.lit(False)), gamma).otherwise(0.0)
    ).drop("_lon", "_lat")


def _vincenty(lon1, lat1, lon2, lat2, rounds: int = 20):
    """Vincenty inverse on WGS84 over NumPy arrays: (distance m, forward azimuth deg)."""
    import numpy as np

    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(v, dtype=float)) for v in (lon1, lat1, lon2, lat2))
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    big_l = lon2 - lon1
    lam = big_l.copy()
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, cu1 * cu2 * sl / np.where(ss > 0, ss, 1.0), 0.0)
            ca2 = 1 - sa**2
            c2m = np.where(ca2 > 1e-15, cs - 2 * su1 * su2 / np.where(ca2 > 1e-15, ca2, 1.0), 0.0)
            cc = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            lam = big_l + (1 - cc) * f * sa * (
                sigma + cc * ss * (c2m + cc * cs * (-1 + 2 * c2m**2))
            )
        uu = ca2 * (a**2 - b**2) / b**2
        aa = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        bb = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        ds = bb * ss * (
            c2m + bb / 4 * (cs * (-1 + 2 * c2m**2) - bb / 6 * c2m * (-3 + 4 * ss**2) * (-3 + 4 * c2m**2))
        )
        dist = b * aa * (sigma - ds)
        az = np.degrees(np.arctan2(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam)))
    return dist, az % 360.0


def geodesic(lon1, lat1, lon2, lat2, steps: int = 6) -> Column:
    """struct(dist_m, bearing_deg): geodesic length and forward azimuth of position pairs, measured in Arrow batches.

    Vincenty's inverse solution on WGS84 with a fixed number of steps. Each step shrinks the error of the longitude on the
    sphere by a factor of about 300, so six reach the last bits for all lines but those between nearly opposite points of
    the globe, which no scene holds. Equal points give 0 and 0; a null position gives null.
    """
    import pandas as pd

    def batch(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        dist, bearing = _vincenty(a, b, c, d, steps)
        return pd.DataFrame({"dist_m": dist, "bearing_deg": bearing})

    batch.__annotations__ = {c: pd.Series for c in "abcd"} | {"return": pd.DataFrame}
    return F.pandas_udf(batch, "dist_m double, bearing_deg double")(*[col(c).cast("double") for c in (lon1, lat1, lon2, lat2)])


def ground_distance(x1, y1, x2, y2) -> Column:
    """Ground distance between two pixels: plane distance on projected scenes, else geodesic."""
    ax, ay, bx, by = map_x(x1), map_y(y1), map_x(x2), map_y(y2)
    geo = F.coalesce(is_geographic(), F.lit(False))
    # Only rows of geographic scenes reach the geodesic.
    return F.when(geo, geodesic(ax, ay, bx, by)["dist_m"]).otherwise(F.hypot(bx - ax, by - ay))


def add_bearing(df: DataFrame, x1, y1, x2, y2, name: str = "bearing_deg") -> DataFrame:
    """Add the geodesic bearing between two pixels, each first rounded to a quarter pixel."""
    q = lambda c: F.rint(col(c) * 4) / 4
    out = add_lonlat(df, q(x1), q(y1), "_lon1", "_lat1")
    out = add_lonlat(out, q(x2), q(y2), "_lon2", "_lat2")
    line = geodesic(F.col("_lon1"), F.col("_lat1"), F.col("_lon2"), F.col("_lat2"))
    return out.withColumn(name, line["bearing_deg"]).drop("_lon1", "_lat1", "_lon2", "_lat2")


def cell_key(lon, lat, decimals: int = 4) -> Column:
    """Cell of a position as two rounded numbers."""
    return F.struct(
        F.bround(col(lon), decimals).alias("cell_lon"), F.bround(col(lat), decimals).alias("cell_lat")
    )


def water_tile_key(lon, lat) -> Column:
    """Name of the ten-degree source tile holding a position, such as 100E_00N."""
    fx, fy = F.floor(col(lon) / 10.0) * 10, F.floor(col(lat) / 10.0) * 10
    return F.concat(
        F.lpad(F.abs(fx).cast("string"), 3, "0"), F.when(fx >= 0, "E").otherwise("W"), F.lit("_"),
        F.lpad(F.abs(fy).cast("string"), 2, "0"), F.when(fy >= 0, "N").otherwise("S"),
    )


def heading_of_shift(dx, dy, convergence=0.0) -> Column:
    """True-north heading of a pixel shift (right, down)."""
    conv = F.lit(float(convergence)) if isinstance(convergence, (int, float)) else col(convergence)
    grid = F.pmod(F.degrees(F.atan2(col(dx), -col(dy))), F.lit(360.0))
    return F.pmod(grid - conv, F.lit(360.0))

