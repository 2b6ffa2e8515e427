"""Circular measures, wake physics and error terms as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.labels import col

# Fixed physical values: gravity and the two knot factors in use (wake formula, band-shift speed).
GRAVITY = 9.8
KNOTS_PER_MS_WAKE = 1.94384
KNOTS_PER_MS = 1 / 0.514444


def angular_error(a, b) -> Column:
    """Smallest difference of two headings, 0 to 180 degrees."""
    d = F.pmod(col(a) - col(b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def wake_line_error(wake, truth) -> Column:
    """Error of an undirected wake axis: the better of both directions."""
    return F.least(angular_error(wake, truth), angular_error(F.pmod(col(wake) + 180.0, F.lit(360.0)), truth))


def rel_dim_error(pred, truth) -> Column:
    p, t = col(pred), col(truth)
    return F.when(t > 1e-6, F.abs(p - t) / t)


def heading_difference(a, b) -> Column:
    return F.abs(F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0)


def headings_agree(a, b, tolerance: float = 45.0) -> Column:
    """Do two headings agree, either way round?"""
    return F.least(heading_difference(a, b), heading_difference(F.pmod(col(a) + 180.0, F.lit(360.0)), b)) <= tolerance


def wake_speed(distance_m, crests) -> Column:
    """Kelvin wake: struct(lambda_m, v_ms, v_kn) from a wake length and its crest count."""
    d, n = col(distance_m), col(crests)
    lam = d / n
    v = F.sqrt(lam * GRAVITY / (2 * math.pi))
    ok = (d > 0) & (n > 0)
    return F.when(
        ok, F.struct(lam.alias("lambda_m"), v.alias("v_ms"), (v * KNOTS_PER_MS_WAKE).alias("v_kn"))
    )


def shift_error(pnr, displacement_px, dt_s, gsd_m=10.0, n_pairs=1, spread_deg=None, speed_spread_kn=None) -> Column:
    """One-sigma errors of a band-shift velocity: struct(speed_error_kn, heading_error_deg).

    The floor is the Cramer-Rao bound of a phase-correlation peak; an observed spread over several pairs
    replaces it where it is larger. ``speed_spread_kn`` is the weighted spread of the pair speeds.
    """
    n = F.greatest(F.lit(n_pairs) if isinstance(n_pairs, int) else col(n_pairs), F.lit(1)).cast("double")
    axis = 1.0 / (math.sqrt(2.0) * math.pi * F.greatest(col(pnr), F.lit(1.0)))
    g = F.lit(float(gsd_m)) if isinstance(gsd_m, (int, float)) else col(gsd_m)
    speed = axis * math.sqrt(2.0) * g / F.greatest(F.abs(col(dt_s)), F.lit(1e-6)) * KNOTS_PER_MS / F.sqrt(n)
    if speed_spread_kn is not None:
        speed = F.greatest(speed, F.when(n >= 2, col(speed_spread_kn) / F.sqrt(n)))
    speed = F.greatest(speed, F.lit(0.1))
    d = col(displacement_px)
    heading = F.degrees(F.try_divide(axis, d * F.sqrt(n)))
    if spread_deg is not None:
        heading = F.greatest(heading, F.when(n >= 2, col(spread_deg) / F.sqrt(n)))
    heading = F.greatest(F.lit(1.0), F.least(heading, F.lit(90.0)))
    return F.struct(
        F.bround(speed, 1).alias("speed_error_kn"),
        F.when(d >= 0.10, F.bround(heading, 0)).alias("heading_error_deg"),
    )


def circular_std(heading, weight) -> Column:
    """Weighted circular standard deviation in degrees (aggregate); null below two headings."""
    h, w = F.radians(col(heading)), col(weight)
    total = F.sum(F.when(h.isNotNull(), w))
    c, s = F.sum(w * F.cos(h)), F.sum(w * F.sin(h))
    r = F.least(F.hypot(F.try_divide(c, total), F.try_divide(s, total)), F.lit(1.0))
    spread = F.when(r < 1e-10, 180.0).otherwise(F.degrees(F.sqrt(F.greatest(-2.0 * F.ln(r), F.lit(0.0)))))
    return F.when((F.count(h) >= 2) & (total >= 1e-12), spread)
