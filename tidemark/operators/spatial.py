"""Distance joins, near-point groups and greedy suppression, cut by space so no key becomes one task.

Every builder works on cells of a grid instead of whole scenes, and first collapses equal positions:
a scene or a spot that holds a third of all rows is spread over many cells, or shrinks to one row.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _cell(x: str, y: str, side: float) -> list[Column]:
    return [
        F.floor(F.col(x) / side).alias("_gx"),
        F.floor(F.col(y) / side).alias("_gy"),
    ]


def _around(df: DataFrame, x: str, y: str, side: float, reach: int = 1) -> DataFrame:
    """One copy of each row per neighbouring cell."""
    steps = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    return (
        df.withColumn("_ix", F.explode(steps))
        .withColumn("_iy", F.explode(steps))
        .withColumn("_gx", F.floor(F.col(x) / side) + F.col("_ix"))
        .withColumn("_gy", F.floor(F.col(y) / side) + F.col("_iy"))
        .drop("_ix", "_iy")
    )


def _shuffled(df: DataFrame) -> DataFrame:
    """A join side that is never broadcast: its size is guessed from the files, before rows were computed and copied to cells."""
    return df.hint("merge")


def _near(radius: float) -> Column:
    dx, dy = F.col("_px") - F.col("_qx"), F.col("_py") - F.col("_qy")
    return dx * dx + dy * dy <= radius * radius


def _targets(points: DataFrame, image: str, x: str, y: str) -> DataFrame:
    return (
        points.select(
            F.col(image).alias("_image"), F.col(x).alias("_qx"), F.col(y).alias("_qy")
        )
        .dropna()
        .distinct()
    )


def without_near(
    df: DataFrame, points: DataFrame, radius: float, *, image: str = "image_name",
    x: str = "cx", y: str = "cy", point_image: str = "image_name", px: str = "x", py: str = "y",
) -> DataFrame:
    """Rows of ``df`` with no point of the same image within ``radius`` (inclusive).

    Two anti joins. The first drops rows that share a cell of diagonal ``radius`` with a point, an
    equality test on one row per cell, so piled-up spots never reach the second. The second tests the
    eight neighbouring cells of side ``radius`` with the exact distance.
    """
    if radius <= 0:
        return df
    t = _targets(points, point_image, px, py)
    small = radius / 2**0.5
    cells = t.select("_image", *_cell("_qx", "_qy", small)).distinct()
    work = df.withColumns({"_image": F.col(image), "_px": F.col(x), "_py": F.col(y)})
    work = work.select("*", *_cell("_px", "_py", small)).join(
        _shuffled(cells), ["_image", "_gx", "_gy"], "left_anti"
    )
    work = work.drop("_gx", "_gy").select("*", *_cell("_px", "_py", radius))
    spread = _around(t, "_qx", "_qy", radius).withColumnsRenamed(
        {"_image": "_timage", "_gx": "_tx", "_gy": "_ty"}
    )
    hit = (
        (F.col("_image") == F.col("_timage")) & (F.col("_gx") == F.col("_tx"))
        & (F.col("_gy") == F.col("_ty")) & _near(radius)
    )
    return work.join(_shuffled(spread), hit, "left_anti").drop("_image", "_px", "_py", "_gx", "_gy")


def with_near_flag(
    df: DataFrame, points: DataFrame, radius: float, flag: str = "matched", *,
    image: str = "image_name", x: str = "cx", y: str = "cy",
    point_image: str = "image_name", px: str = "x", py: str = "y",
) -> DataFrame:
    """All rows of ``df`` with a boolean: is a point of the same image within ``radius`` (inclusive)?

    Only existence is asked, so the exact test is a semi join over distinct positions and ends at the
    first hit; positions settled by a shared small cell skip it.
    """
    t = _targets(points, point_image, px, py)
    small = radius / 2**0.5
    cells = t.select("_image", *_cell("_qx", "_qy", small)).distinct().withColumn("_same", F.lit(True))
    spots = df.select(
        F.col(image).alias("_image"), F.col(x).alias("_px"), F.col(y).alias("_py")
    ).dropna().distinct()
    spots = spots.select("*", *_cell("_px", "_py", small)).join(
        _shuffled(cells), ["_image", "_gx", "_gy"], "left"
    ).drop("_gx", "_gy")
    open_spots = spots.filter(F.col("_same").isNull()).select("*", *_cell("_px", "_py", radius))
    spread = _around(t, "_qx", "_qy", radius).withColumnsRenamed(
        {"_image": "_timage", "_gx": "_tx", "_gy": "_ty"}
    )
    hit = (
        (F.col("_image") == F.col("_timage")) & (F.col("_gx") == F.col("_tx"))
        & (F.col("_gy") == F.col("_ty")) & _near(radius)
    )
    found = (
        open_spots.join(_shuffled(spread), hit, "left_semi").select("_image", "_px", "_py")
        .unionByName(spots.filter("_same").select("_image", "_px", "_py"))
        .withColumn("_hit", F.lit(True))
    )
    on = (F.col(image) == F.col("_image")) & (F.col(x) == F.col("_px")) & (F.col(y) == F.col("_py"))
    return (
        df.join(_shuffled(found), on, "left")
        .withColumn(flag, F.coalesce("_hit", F.lit(False)))
        .drop("_image", "_px", "_py", "_hit")
    )


def nearest_within(
    df: DataFrame, points: DataFrame, radius: float, *, image: str = "image_name",
    x: str = "cx", y: str = "cy", point_image: str = "image_name", px: str = "x", py: str = "y",
    order: str = "id",
) -> DataFrame:
    """Left join to the nearest point of the same image within ``radius`` (inclusive).

    The result carries the chosen point as struct ``near`` and its squared distance ``near_d2``. Of
    points at one position, and of equally near ones, the smallest ``order`` wins. Positions are
    matched once on each side, so copies of a spot cost one comparison.
    """
    best = (
        points.filter(F.col(px).isNotNull() & F.col(py).isNotNull())
        .groupBy(F.col(point_image).alias("_timage"), F.col(px).alias("_qx"), F.col(py).alias("_qy"))
        .agg(F.min_by(F.struct(*points.columns), F.col(order)).alias("_pt"))
    )
    spread = _around(best, "_qx", "_qy", radius).withColumnsRenamed({"_gx": "_tx", "_gy": "_ty"})
    spots = df.select(
        F.col(image).alias("_image"), F.col(x).alias("_px"), F.col(y).alias("_py")
    ).dropna().distinct().select("*", *_cell("_px", "_py", radius))
    hit = (
        (F.col("_image") == F.col("_timage")) & (F.col("_gx") == F.col("_tx"))
        & (F.col("_gy") == F.col("_ty")) & _near(radius)
    )
    dx, dy = F.col("_px") - F.col("_qx"), F.col("_py") - F.col("_qy")
    d2 = dx * dx + dy * dy
    chosen = (
        spots.join(_shuffled(spread), hit)
        .groupBy("_image", "_px", "_py")
        .agg(
            F.min_by("_pt", F.struct(d2, F.col(f"_pt.{order}"))).alias("near"),
            F.min(d2).alias("near_d2"),
        )
    )
    on = (F.col(image) == F.col("_image")) & (F.col(x) == F.col("_px")) & (F.col(y) == F.col("_py"))
    return df.join(_shuffled(chosen), on, "left").drop("_image", "_px", "_py")


def near_groups(
    df: DataFrame, radius: float, *, image: str = "image_key", x: str = "cx_full", y: str = "cy_full",
) -> DataFrame:
    """Connected groups of rows whose chain of neighbours is never further than ``radius`` apart.

    Adds ``group_key`` (one value per group of an image). Rows in one cell of diagonal ``radius`` are
    always together, so the graph has one node per occupied cell, not per row. Two cells are linked when
    any of their distinct positions are near; the link test keeps one row per cell pair. Labels then
    spread by minimum with pointer jumping, one written round at a time.
    """
    side = radius / 2**0.5
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pos = rows.select(
        F.col(image).alias("_image"), F.col(x).alias("_px"), F.col(y).alias("_py")
    ).distinct().select("*", *_cell("_px", "_py", side))
    nodes = pos.select("_image", "_gx", "_gy").distinct()

    # Half of the cells in reach, so each link is tested once; the far corners can never be near.
    half = [
        (i, j) for i in range(0, 3) for j in range(-2, 3)
        if (i > 0 or j > 0) and abs(i) + abs(j) < 4
    ]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half])
    left = (
        pos.withColumn("_s", F.explode(steps))
        .select(
            "_image", "_px", "_py", F.col("_gx").alias("_ax"), F.col("_gy").alias("_ay"),
            (F.col("_gx") + F.col("_s.i")).alias("_bx"), (F.col("_gy") + F.col("_s.j")).alias("_by"),
        )
    )
    right = pos.select(
        F.col("_image").alias("_timage"), F.col("_px").alias("_qx"), F.col("_py").alias("_qy"),
        F.col("_gx").alias("_tx"), F.col("_gy").alias("_ty"),
    )
    near = (
        (F.col("_image") == F.col("_timage")) & (F.col("_bx") == F.col("_tx"))
        & (F.col("_by") == F.col("_ty")) & _near(radius)
    )
    node = lambda gx, gy: F.concat_ws(":", "_image", F.col(gx).cast("string"), F.col(gy).cast("string"))
    links = (
        left.join(_shuffled(right), near)
        .select("_image", "_ax", "_ay", "_bx", "_by").distinct()
        .select(node("_ax", "_ay").alias("a"), node("_bx", "_by").alias("b"))
    )
    comp = connected_components(links)
    keyed = rows.withColumn("_node", F.concat_ws(
        ":", F.col(image), F.floor(F.col(x) / side).cast("string"), F.floor(F.col(y) / side).cast("string")
    ))
    return (
        keyed.join(comp.withColumnRenamed("node", "_node"), "_node", "left")
        .withColumn("group_key", F.coalesce("component", "_node"))
        .drop("_node", "component")
    )


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest reachable node per node of an undirected link table ``(a, b)``.

    Alternates two link rewrites per round: every node hands its larger neighbours the smallest node it
    knows, then its smaller ones. Long chains shrink by half a round, and a node with a huge number of
    links is only ever aggregated with ``min`` and never collected.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    def both(e):
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def signature(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    last = None
    while True:
        # Larger neighbours of a node are linked to the smallest node it sees.
        bi = both(edges)
        low = bi.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            bi.join(low, "a").filter("b > a").select(F.col("b").alias("n"), "m").distinct()
        )
        # Smaller neighbours, and the node itself, are linked to the smallest of them.
        low2 = large.groupBy("n").agg(F.min("m").alias("m2"))
        small = large.join(low2, "n").select(F.col("m").alias("x"), F.col("m2").alias("y")).unionByName(
            low2.select(F.col("n").alias("x"), F.col("m2").alias("y"))
        )
        edges = cut_lineage(
            small.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        now = signature(edges)
        if now == last:
            break
        last = now
    member = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    roots = member.select(F.col("component").alias("node"), "component").distinct()
    return member.unionByName(roots)


def greedy_keep(
    df: DataFrame, *, image: str, order: list[Column], boxes: tuple[str, str, str, str] | None = None,
    iou: float | None = None, point: tuple[str, str] | None = None, radius: float | None = None,
    block_rows: int = 4000,
) -> DataFrame:
    """Greedy suppression per image: best row first, each kept row removes the rows it conflicts with.

    Rows conflict when their boxes overlap by at least ``iou`` or their points lie within ``radius``.
    ``order`` must be total. The result equals the sequential rule, but is reached in rounds over square
    blocks of the image, so neither an image nor a spot has to fit in one task:

    1. equal geometries shrink to their best row (it stands or falls with its copies);
    2. each block takes its best ``block_rows`` open rows plus those just outside, and settles every row
       whose better neighbours are all in view; what it cannot settle waits for the next round;
    3. rows in conflict with a newly kept row are removed by a join on cells.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    if boxes:
        x1, y1, x2, y2 = boxes
        geom = {"_x1": F.col(x1), "_y1": F.col(y1), "_x2": F.col(x2), "_y2": F.col(y2)}
        conflict = ("iou", float(iou))
    else:
        x, y = point
        geom = {"_x1": F.col(x), "_y1": F.col(y), "_x2": F.col(x), "_y2": F.col(y)}
        conflict = ("radius", float(radius))
    rank = F.struct(*[o.alias(k) for o, k in zip(order, keys)])
    # Read twice below, so what led here is computed and stored once.
    work = cut_lineage(df.withColumns({**geom, "_img": F.col(image), "_rank": rank}))
    slim = work.select("_img", "_x1", "_y1", "_x2", "_y2", "_rank")
    flat = F.lit(False)
    if boxes:  # boxes without area conflict with nothing, not even with their copies
        size = (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1"))
        flat = (F.col("_x2") <= F.col("_x1")) | (F.col("_y2") <= F.col("_y1")) | (size <= 1e-12)
    copies = ["_img", "_x1", "_y1", "_x2", "_y2", F.when(flat, F.col("_rank")).alias("_self")]
    one = slim.groupBy(*copies).agg(F.min("_rank").alias("_rank")).drop("_self")
    kept = _greedy_rounds(one, conflict, block_rows)
    on = ["_img", "_x1", "_y1", "_x2", "_y2", "_rank"]
    return work.join(kept.select(*on), on, "left_semi").drop(*on)


def _greedy_rounds(one: DataFrame, conflict, block_rows: int) -> DataFrame:
    kind, limit = conflict
    # The id is stored with the rows, so later reads and retries see the same one.
    open_rows = cut_lineage(one.withColumn("_id", F.monotonically_increasing_id()))
    spark, schema = open_rows.sparkSession, open_rows.schema
    if kind == "radius":
        reach = max(limit, 1e-9)
    else:
        widest = F.greatest(F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1"))
        reach = max(float(open_rows.agg(F.max(widest)).first()[0] or 0.0), 1e-9)
    # Many times the reach, so few rows sit on a rim, and never so small that blocks outnumber rows.
    block = max(4 * reach, 256.0)
    kept_parts: list[DataFrame] = []
    # Every round keeps at least the best open row, so the loop ends.
    for round_no in itertools.count():
        if open_rows.isEmpty():
            break
        shift = (round_no % 2) * block / 2
        ids = _settle_blocks(open_rows, conflict, block, reach, shift, block_rows)
        new = cut_lineage(open_rows.join(ids, "_id", "left_semi").select(*schema.names))
        kept_parts.append(new)
        open_rows = cut_lineage(_remove_conflicts(open_rows, new, conflict, reach))
    if not kept_parts:
        return spark.createDataFrame([], schema)
    out = kept_parts[0]
    for part in kept_parts[1:]:
        out = out.unionByName(part)
    return out


def _settle_blocks(rows, conflict, block, reach, shift, block_rows):
    """Ids of rows certain to be kept, judged inside shifted blocks with a rim of width ``reach``."""
    mid_x, mid_y = (F.col("_x1") + F.col("_x2")) / 2 + shift, (F.col("_y1") + F.col("_y2")) / 2 + shift
    near = lambda m: F.sequence(F.floor((F.col(m) - reach) / block), F.floor((F.col(m) + reach) / block))
    home = lambda m, b: F.col(b) == F.floor(F.col(m) / block)
    spread = (
        rows.withColumns({"_mx": mid_x, "_my": mid_y})
        .withColumn("_bx", F.explode(near("_mx")))
        .withColumn("_by", F.explode(near("_my")))
        .withColumn("_home", home("_mx", "_bx") & home("_my", "_by"))
    )
    # The best rows of a block come first; Spark applies this limit before and after the shuffle.
    w = W.partitionBy("_img", "_bx", "_by").orderBy("_rank")
    top = spread.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= block_rows)
    top = top.select("_img", "_bx", "_by", "_id", "_x1", "_y1", "_x2", "_y2", "_home", "_pos")
    kind, limit = conflict

    def settle(table):
        import numpy as np
        import pyarrow as pa

        get = lambda c: table.column(c).to_numpy()
        at = np.argsort(get("_pos"), kind="stable")
        x1, y1, x2, y2, home, ids = (get(c)[at] for c in ("_x1", "_y1", "_x2", "_y2", "_home", "_id"))
        area = (x2 - x1) * (y2 - y1)
        state = np.zeros(len(at), dtype=np.int8)  # 0 unknown, 1 kept, 2 removed
        for i in range(len(at)):
            live = np.flatnonzero(state[:i] != 2)
            if kind == "iou":
                iw = np.minimum(x2[live], x2[i]) - np.maximum(x1[live], x1[i])
                ih = np.minimum(y2[live], y2[i]) - np.maximum(y1[live], y1[i])
                inter = np.clip(iw, 0, None) * np.clip(ih, 0, None)
                union = area[live] + area[i] - inter
                ok = (inter > 0) & (union > 1e-12)
                hit = np.where(ok, inter / np.where(ok, union, 1.0), 0.0) >= limit
            else:
                dx, dy = x1[live] - x1[i], y1[live] - y1[i]
                hit = dx * dx + dy * dy <= limit * limit
            near = state[live[hit]]
            if (near == 1).any():
                state[i] = 2
            elif home[i] and not len(near):
                state[i] = 1
        return pa.table({"_id": pa.array(ids[state == 1], pa.int64())})

    return top.groupBy("_img", "_bx", "_by").applyInArrow(settle, schema="_id long")


def _remove_conflicts(rows, kept, conflict, reach):
    """Open rows minus the kept ones and minus everything in conflict with a kept one."""
    kind, limit = conflict
    cell = 2 * reach
    k = kept.select(
        F.col("_img").alias("_kimg"), *[F.col(c).alias(f"_k{c[1:]}") for c in ("_x1", "_y1", "_x2", "_y2")],
        F.col("_id").alias("_kid"),
    )
    pad = limit if kind == "radius" else 0.0
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - pad) / cell), F.floor((F.col(b) + pad) / cell)))
    k = k.withColumn("_kcx", span("_kx1", "_kx2")).withColumn("_kcy", span("_ky1", "_ky2"))
    if kind == "radius":
        dx, dy = F.col("_x1") - F.col("_kx1"), F.col("_y1") - F.col("_ky1")
        hit = dx * dx + dy * dy <= limit * limit
        r = rows.withColumn("_cx", F.floor(F.col("_x1") / cell)).withColumn("_cy", F.floor(F.col("_y1") / cell))
        on = (F.col("_img") == F.col("_kimg")) & (F.col("_cx") == F.col("_kcx")) & (F.col("_cy") == F.col("_kcy"))
        return r.join(k, on & hit, "left_anti").select(*rows.columns)
    from tidemark.functions.geo import box_iou

    a = {c: F.col(f"_{c}") for c in ("x1", "y1", "x2", "y2")}
    b = {c: F.col(f"_k{c}") for c in ("x1", "y1", "x2", "y2")}
    same = F.col("_kid") == F.col("_id")
    spread = rows.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_x1") / cell), F.floor(F.col("_x2") / cell))))
    spread = spread.withColumn(
        "_cy", F.explode(F.sequence(F.floor(F.col("_y1") / cell), F.floor(F.col("_y2") / cell)))
    )
    on = (F.col("_img") == F.col("_kimg")) & (F.col("_cx") == F.col("_kcx")) & (F.col("_cy") == F.col("_kcy"))
    gone = (
        spread.join(k, on & (same | (box_iou(a, b) >= limit)), "left_semi").select("_id").distinct()
    )
    return rows.join(gone, "_id", "left_anti").select(*rows.columns)
