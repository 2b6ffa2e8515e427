"""NumPy helpers for one small shape or chip, called from Arrow batches."""

from __future__ import annotations

import math

import numpy as np


def convex_hull(points) -> list[tuple[float, float]]:
    """Corners of the convex hull in order; collinear points are left out."""
    p = sorted({(round(float(x), 9), round(float(y), 9)) for x, y in points})
    if len(p) < 3:
        return p

    def chain(seq):
        out: list[tuple[float, float]] = []
        for x, y in seq:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2:]
                if (bx - ax) * (y - by) - (by - ay) * (x - bx) > 0:
                    break
                out.pop()
            out.append((x, y))
        return out[:-1]

    return chain(p) + chain(p[::-1])


def smallest_rectangle(points):
    """Rectangle of least area around points: (corners 4×2, longer, shorter), or None without extent.

    One side of it lies along an edge of the hull, so trying each edge is enough. Hulls have a handful of
    corners, for which plain numbers beat array calls.
    """
    hull = convex_hull(points)
    if len(hull) < 2:
        return None
    best = None
    for (x0, y0), (x1, y1) in zip(hull, hull[1:] + hull[:1]):
        n = math.hypot(x1 - x0, y1 - y0)
        if n == 0:
            continue
        ux, uy = (x1 - x0) / n, (y1 - y0) / n
        a = [x * ux + y * uy for x, y in hull]
        b = [y * ux - x * uy for x, y in hull]
        a0, a1, b0, b1 = min(a), max(a), min(b), max(b)
        area = (a1 - a0) * (b1 - b0)
        if best is None or area < best[0]:
            best = (area, ux, uy, a0, a1, b0, b1)
    _, ux, uy, a0, a1, b0, b1 = best
    corners = np.array([(a * ux - b * uy, a * uy + b * ux) for a, b in ((a0, b0), (a1, b0), (a1, b1), (a0, b1))])
    return corners, max(a1 - a0, b1 - b0), min(a1 - a0, b1 - b0)


def grow(corners: np.ndarray, pad: float) -> np.ndarray:
    """Rectangle with both sides longer by twice ``pad``."""
    mid = corners.mean(axis=0)
    out = corners - mid
    for side in (corners[1] - corners[0], corners[3] - corners[0]):
        n = np.hypot(*side)
        d = side / n if n > 0 else np.zeros(2)
        out = out + np.sign(out @ d)[:, None] * d * pad
    return mid + out


def by_angle(corners: np.ndarray) -> np.ndarray:
    d = corners - corners.mean(axis=0)
    return corners[np.argsort(np.arctan2(d[:, 1], d[:, 0]), kind="stable")]


def hull_quad(points, keel=None, sides=None):
    """Outline of a hull from its marked points, corners by angle; None when they span nothing.

    ``keel`` are two ends of the length axis and ``sides`` two points on the flanks.
    """
    p = [(float(x), float(y)) for x, y in points]
    if len(p) < 2:
        return None
    xs, ys = [q[0] for q in p], [q[1] for q in p]
    pad = max(1.5, 0.02 * max(max(xs) - min(xs), max(ys) - min(ys), 1e-6))
    if keel is not None and sides is not None:
        (ax, ay), (bx, by) = keel
        (cx, cy), (dx, dy) = sides
        length = math.hypot(bx - ax, by - ay)
        if length >= 1e-9 and math.hypot(dx - cx, dy - cy) >= 1e-9:
            ux, uy = (bx - ax) / length, (by - ay) / length
            ends = (ax * ux + ay * uy, bx * ux + by * uy)
            flanks = (cy * ux - cx * uy, dy * ux - dx * uy)
            reach = math.hypot(ends[1] - ends[0], flanks[1] - flanks[0]) / 2
            return _box(
                (ends[0] + ends[1]) / 2, (flanks[0] + flanks[1]) / 2, abs(ends[1] - ends[0]) / 2,
                abs(flanks[1] - flanks[0]) / 2, ux, uy, min(1.0 + pad / reach, 1.2) if reach > 1e-9 else 1.0,
            )
    if len(p) == 2:
        (ax, ay), (bx, by) = p
        length = math.hypot(bx - ax, by - ay)
        if length < 1e-9:
            return None
        ux, uy = (bx - ax) / length, (by - ay) / length
        half = length / 2 + pad
        mx, my = (ax + bx) / 2, (ay + by) / 2
        return _box(mx * ux + my * uy, my * ux - mx * uy, half, max(1.5, 0.18 * half), ux, uy)
    found = smallest_rectangle(p)
    return None if found is None else by_angle(grow(found[0], pad))


def _box(along, across, half_a, half_c, ux, uy, scale: float = 1.0):
    """Corners by angle of a rectangle given in the axes (u, v) with u = (ux, uy)."""
    corners = [
        (along + i * scale * half_a, across + j * scale * half_c) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))
    ]
    xy = [(a * ux - c * uy, a * uy + c * ux) for a, c in corners]
    mx, my = along * ux - across * uy, along * uy + across * ux
    return sorted(xy, key=lambda q: math.atan2(q[1] - my, q[0] - mx))


def longest_hull_edge_deg(points) -> float:
    """Direction of the longest hull edge in degrees, y pointing down; 0 without extent."""
    hull = convex_hull(points)
    if len(hull) < 2:
        return 0.0
    edges = [(x1 - x0, y1 - y0) for (x0, y0), (x1, y1) in zip(hull, hull[1:] + hull[:1])]
    dx, dy = max(edges, key=lambda e: e[0] * e[0] + e[1] * e[1])
    return math.degrees(math.atan2(dy, dx))


def principal_axis_deg(points) -> float:
    """Direction of the largest spread in degrees, by the closed form for two dimensions."""
    p = [(float(x), float(y)) for x, y in points]
    if len(p) < 2:
        return 0.0
    mx, my = sum(x for x, _ in p) / len(p), sum(y for _, y in p) / len(p)
    sxx, syy = sum((x - mx) ** 2 for x, _ in p), sum((y - my) ** 2 for _, y in p)
    sxy = sum((x - mx) * (y - my) for x, y in p)
    if sxx + syy < 1e-18:
        return 0.0
    return math.degrees(0.5 * math.atan2(2 * sxy, sxx - syy))


def polygon_area(points) -> float:
    p = [tuple(q) for q in points]
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1])) / 2


def convex_iou(a, b) -> float | None:
    """Overlap of two convex polygons over their union; None for fewer than three corners or no area."""
    a, b = [(float(x), float(y)) for x, y in a], [(float(x), float(y)) for x, y in b]
    if len(a) < 3 or len(b) < 3:
        return None
    if polygon_area(b) < 0:
        b = b[::-1]
    part = a
    for (px, py), (qx, qy) in zip(b, b[1:] + b[:1]):
        ex, ey = qx - px, qy - py
        side = [ex * (y - py) - ey * (x - px) for x, y in part]
        cut = []
        for j, (x, y) in enumerate(part):
            if (side[j] >= 0) != (side[j - 1] >= 0):
                t = side[j - 1] / (side[j - 1] - side[j])
                ox, oy = part[j - 1]
                cut.append((ox + t * (x - ox), oy + t * (y - oy)))
            if side[j] >= 0:
                cut.append((x, y))
        part = cut
        if not part:
            break
    inter = abs(polygon_area(part)) if len(part) > 2 else 0.0
    union = abs(polygon_area(a)) + abs(polygon_area(b)) - inter
    return None if union < 1e-12 else inter / union
