"""Ship velocity from the shift between bands that a satellite records a moment apart.

The correlation of two chips runs in NumPy over Arrow batches; everything after it is plain columns.
Two conventions exist. ``sign="motion"`` (default) follows the motion from the earlier to the later band and
refines the peak by the vertex of a parabola. ``sign="as_coded"`` keeps the raw peak of the cross-power
spectrum (first, conjugate second), which points backwards, and refines it with the opposite sign, so that
values stored under that convention can be reproduced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import angles as A
from tidemark.functions.geo import heading_of_shift
from tidemark.functions.labels import col

# Seconds of each band after the blue one, pairs in order, and the gates.
BAND_SECONDS = {"B08": -0.503, "B02": 0.0, "B03": 0.503, "B04": 1.004}
PAIRS = (("B02", "B04"), ("B08", "B04"), ("B08", "B02"), ("B02", "B03"))
BAND_INDEX = {"B04": 0, "B03": 1, "B02": 2, "B08": 3}
MIN_PNR, PAIR_MIN_PNR, COMBINED_MIN_PNR, BACKGROUND_MIN_PNR = 2.8, 2.0, 2.5, 1.2
MAX_SPEED_MS, MIN_HEADING_PX, GSD_M = 26.0, 0.10, 10.0
UPSAMPLE = 16
TAPER = 0.15


def _taper(n: int):
    import numpy as np

    w = np.ones(n)
    k = int(TAPER * n / 2.0)
    if n > 1 and k >= 1:
        ramp = 0.5 - 0.5 * np.cos(np.pi * np.arange(k) / k)
        w[:k], w[n - k:] = ramp, ramp[::-1]
    return w


def _whitened(a, b):
    """Cross-power spectrum of two tapered chips with all amplitudes one."""
    import numpy as np

    window = np.outer(*map(_taper, a.shape))
    first, second = (np.fft.fft2((chip - chip.mean()) * window) for chip in (a, b))
    cross = first * second.conj()
    return cross / np.maximum(np.abs(cross), 1e-10)


def _correlation(spectrum, rows, cols):
    """The correlation surface at any fractional ``rows`` and ``cols``: two small matrix products with the waves there."""
    import numpy as np

    h, w = spectrum.shape
    down = np.exp(2j * np.pi * np.outer(rows, np.fft.fftfreq(h)))
    across = np.exp(2j * np.pi * np.outer(np.fft.fftfreq(w), cols))
    return (down @ spectrum @ across).real / (h * w)


def phase_shift(a, b, upsample: int = UPSAMPLE, sign: str = "motion"):
    """Shift between two equal chips and the peak-to-noise ratio of their correlation: (x, y, pnr).

    The surface is computed on whole and half pixels once and on a grid of 1/``upsample`` pixel only around its peak.
    """
    import numpy as np

    spectrum = _whitened(a, b)
    h, w = spectrum.shape
    coarse = np.fft.ifft2(spectrum).real
    top = np.array(np.unravel_index(coarse.argmax(), coarse.shape))
    gap = [np.minimum(d, n - d) for d, n in ((np.abs(np.arange(n) - t), n) for t, n in zip(top, (h, w)))]
    far = (gap[0][:, None] > 2) | (gap[1][None, :] > 2)
    # A chip no larger than the peak's own patch has no noise to compare with.
    pnr = coarse[tuple(top)] / ((np.abs(coarse[far]).mean() if far.any() else np.nan) + 1e-9)

    step = 1.0 / max(1, upsample)
    if upsample > 1:
        # Between whole pixels the surface can rise above its whole-pixel peak; half pixels show where.
        half = _correlation(spectrum, np.arange(2 * h) / 2, np.arange(2 * w) / 2)
        top = np.array(np.unravel_index(half.argmax(), half.shape)) / 2
    reach = np.arange(-max(1, upsample) - 1, max(1, upsample) + 2) * step
    fine = _correlation(spectrum, top[0] + reach, top[1] + reach)
    inner = fine[1:-1, 1:-1]
    r, c = np.array(np.unravel_index(inner.argmax(), inner.shape)) + 1

    def settled(line, k, start, size):
        bend = 2.0 * (2.0 * line[1] - line[0] - line[2])
        vertex = (line[2] - line[0]) / bend * step if abs(bend) >= 1e-12 else 0.0
        at = (start + reach[k]) % size + (-vertex if sign == "as_coded" else vertex)
        at = at if at <= size / 2 else at - size
        return at if sign == "as_coded" else -at

    return settled(fine[r, c - 1:c + 2], c, top[1], w), settled(fine[r - 1:r + 2, c], r, top[0], h), pnr


def measure_shifts(pairs: DataFrame, a: str = "a", b: str = "b", h: str = "h", w: str = "w", upsample: int = UPSAMPLE,
                   sign: str = "motion", name: str = "shift") -> DataFrame:
    """Add struct ``name`` (x, y, pnr) for two row-major chips per row."""
    import pandas as pd

    if sign not in ("motion", "as_coded"):
        raise ValueError("sign is 'motion' or 'as_coded'")
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "pnr")])

    def batch(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for p, q, rows, cols in zip(a, b, h, w):
            p, q = np.asarray(p, dtype=float), np.asarray(q, dtype=float)
            if p.shape != q.shape or p.size != rows * cols or p.size < 16:
                out.append((None, None, None))
                continue
            x, y, pnr = phase_shift(p.reshape(rows, cols), q.reshape(rows, cols), upsample, sign)
            out.append((x, y, pnr))
        return pd.DataFrame(out, columns=["x", "y", "pnr"], dtype="float64")

    batch.__annotations__ = {c: pd.Series for c in ("a", "b", "h", "w")} | {"return": pd.DataFrame}
    return pairs.withColumn(name, F.pandas_udf(batch, schema)(a, b, h, w))


def band_pairs(chips: DataFrame, image: str = "chip_id", pairs=PAIRS) -> DataFrame:
    """One row per chip and band pair with both chips and their time step."""
    rows = [
        F.struct(
            F.lit(i).alias("pair"), F.lit(x).alias("band_a"), F.lit(y).alias("band_b"),
            F.lit(round(BAND_SECONDS[y] - BAND_SECONDS[x], 4)).alias("dt_s"),
            F.get("bands", BAND_INDEX[x]).alias("a"), F.get("bands", BAND_INDEX[y]).alias("b"),
        )
        for i, (x, y) in enumerate(pairs)
    ]
    return chips.select(image, "h", "w", F.explode(F.array(*rows)).alias("p")).select(image, "h", "w", "p.*")


def remove_background(shifts: DataFrame, background: DataFrame | None, keys: list[str]) -> DataFrame:
    """Subtract the shift of a larger background chip where it is clear enough."""
    if background is None:
        return shifts
    bg = background.select(*keys, F.col("shift").alias("_bg"))
    ok = F.col("_bg.pnr") >= BACKGROUND_MIN_PNR
    sub = lambda c: F.col(f"shift.{c}") - F.when(ok, F.col(f"_bg.{c}")).otherwise(0.0)
    return shifts.join(bg, keys, "left").withColumn(
        "shift", F.struct(sub("x").alias("x"), sub("y").alias("y"), F.col("shift.pnr").alias("pnr"))
    ).drop("_bg")


def single_pair(shifts: DataFrame, convergence="convergence_deg", min_pnr: float = MIN_PNR, gsd_m: float = GSD_M) -> DataFrame:
    """Velocity per row from (shift, dt_s); rows below the peak ratio or beyond 26 m/s are dropped."""
    px = F.hypot("shift.x", "shift.y")
    speed = px * gsd_m / F.abs("dt_s")
    ok = (F.col("shift.pnr") >= min_pnr) & (F.abs("dt_s") >= 1e-6) & (speed <= MAX_SPEED_MS)
    err = A.shift_error("shift.pnr", px, "dt_s", gsd_m)
    heading = heading_of_shift("shift.x", "shift.y", convergence)
    return shifts.filter(ok).withColumns({
        "speed_ms": F.bround(speed, 3), "speed_kn": F.bround(speed * A.KNOTS_PER_MS, 2),
        "heading_deg": F.when(px >= MIN_HEADING_PX, F.bround(heading, 1)),
        "shift_x_px": F.bround("shift.x", 4), "shift_y_px": F.bround("shift.y", 4), "pnr": F.bround("shift.pnr", 2),
        "speed_error_kn": err["speed_error_kn"], "heading_error_deg": err["heading_error_deg"],
    })


def usable_pairs(shifts: DataFrame, convergence="convergence_deg", gsd_m: float = GSD_M) -> DataFrame:
    """Per-pair speed and heading of the pairs that pass their own gates, rounded as stored."""
    speed = F.hypot("shift.x", "shift.y") * gsd_m / F.abs("dt_s")
    ok = (F.col("shift.pnr") >= PAIR_MIN_PNR) & (F.abs("dt_s") >= 1e-6) & (speed <= MAX_SPEED_MS)
    return shifts.filter(ok).withColumns({
        "shift_x_px": F.bround("shift.x", 4), "shift_y_px": F.bround("shift.y", 4), "pnr": F.bround("shift.pnr", 2),
        "speed_ms": F.bround(speed, 3), "heading_deg": F.bround(heading_of_shift("shift.x", "shift.y", convergence), 1),
    })


def combine_pairs(pairs: DataFrame, image: str = "chip_id", gsd_m: float = GSD_M) -> DataFrame:
    """One velocity per chip from its usable pairs: ratio-weighted vector, harmonic mean ratio, errors.

    A lone pair is reported as it is. Shift, step and bands are those of the clearest pair.
    """
    p, v, rad = F.col("pnr"), F.col("speed_ms"), F.radians("heading_deg")
    px = F.hypot("shift_x_px", "shift_y_px")
    kn = v * A.KNOTS_PER_MS
    pick = F.struct("shift_x_px", "shift_y_px", "dt_s", "band_a", "band_b", "speed_ms", "heading_deg", "pnr")
    a = pairs.groupBy(image).agg(
        F.count("*").alias("n_pairs"), F.sum(p).alias("_w"),
        (F.sum(p * v * F.sin(rad)) / F.sum(p)).alias("_vx"), (F.sum(-p * v * F.cos(rad)) / F.sum(p)).alias("_vy"),
        (F.count("*") / F.sum(1.0 / F.greatest(p, F.lit(0.01)))).alias("_pnr"),
        A.circular_std("heading_deg", "pnr").alias("_spread"), F.avg(px).alias("_px"),
        F.sum(p * kn).alias("_k1"), F.sum(p * kn * kn).alias("_k2"),
        F.max_by(pick, F.struct(p, -F.col("pair"))).alias("best"),
    )
    lone = F.col("n_pairs") == 1
    speed = F.when(lone, F.col("best.speed_ms")).otherwise(F.hypot("_vx", "_vy"))
    a = a.withColumns({"_v": speed, "_kn": F.bround(speed * A.KNOTS_PER_MS, 2)})
    # Weighted spread of the pair speeds about the combined one, from their first two moments.
    m = F.col("_kn")
    var = (F.col("_k2") - 2 * m * F.col("_k1") + m * m * F.col("_w")) / F.col("_w")
    err = A.shift_error(
        F.when(lone, F.col("best.pnr")).otherwise(F.col("_pnr")), "_px", "best.dt_s", gsd_m, F.col("n_pairs"),
        "_spread", F.sqrt(F.greatest(var, F.lit(0.0))),
    )
    heading = F.pmod(F.degrees(F.atan2(F.col("_vx"), -F.col("_vy"))), F.lit(360.0))
    heading = F.when(lone, F.col("best.heading_deg")).otherwise(F.bround(heading, 1))
    ok = lone | ((F.col("_pnr") >= COMBINED_MIN_PNR) & (F.col("_v") <= MAX_SPEED_MS))
    return a.filter(ok).select(
        image, "n_pairs", F.bround("_v", 3).alias("speed_ms"), F.col("_kn").alias("speed_kn"),
        F.when(F.col("_px") >= MIN_HEADING_PX, heading).alias("heading_deg"),
        F.col("best.shift_x_px").alias("shift_x_px"), F.col("best.shift_y_px").alias("shift_y_px"),
        F.when(lone, F.col("best.pnr")).otherwise(F.bround("_pnr", 2)).alias("pnr"), F.col("best.dt_s").alias("dt_s"),
        F.col("best.band_a").alias("band_a"), F.col("best.band_b").alias("band_b"),
        F.bround("_spread", 1).alias("heading_spread_deg"), err["speed_error_kn"].alias("speed_error_kn"),
        err["heading_error_deg"].alias("heading_error_deg"),
    )


def band_velocity(chips: DataFrame, background: DataFrame | None = None, image: str = "chip_id",
                  convergence: DataFrame | None = None, sign: str = "motion") -> DataFrame:
    """Chips to one velocity each: four band pairs, their shifts, background removed, combined."""
    keys = [image, "pair"]
    shifts = measure_shifts(band_pairs(chips, image), sign=sign).drop("a", "b")
    if background is not None:
        bg = measure_shifts(band_pairs(background, image), upsample=1, sign=sign)
        shifts = remove_background(shifts, bg, keys)
    if convergence is not None:
        shifts = shifts.join(convergence.select(image, "convergence_deg"), image, "left").fillna({"convergence_deg": 0.0})
    else:
        shifts = shifts.withColumn("convergence_deg", F.lit(0.0))
    return combine_pairs(usable_pairs(shifts), image)


def backfill_errors(df: DataFrame, dt_s: float = 1.004, gsd_m: float = GSD_M) -> DataFrame:
    """Fill missing speed and heading errors of stored velocities, taken as one pair of known step."""
    speed, pnr = F.col("chroma_speed_kn"), F.col("chroma_pnr")
    px = speed / A.KNOTS_PER_MS * dt_s / gsd_m
    err = A.shift_error(pnr, px, F.lit(dt_s), gsd_m)
    todo = speed.isNotNull() & pnr.isNotNull() & F.col("speed_error_kn").isNull()
    fill = err["heading_error_deg"].isNotNull() & F.col("chroma_heading_deg").isNotNull()
    return df.withColumns({
        "speed_error_kn": F.when(todo, err["speed_error_kn"]).otherwise(F.col("speed_error_kn")),
        "heading_error_deg": F.when(todo & fill, err["heading_error_deg"]).otherwise(F.col("heading_error_deg")),
        "filled": todo,
    })


def wake_from_pixels(df: DataFrame) -> DataFrame:
    """Wake speed from both ends of a wake (pixels on a scene) and its crest count."""
    from tidemark.functions.geo import ground_distance

    d = df.withColumn("distance_m", ground_distance("x1", "y1", "x2", "y2"))
    return d.withColumn("_s", A.wake_speed("distance_m", col("crests"))).withColumns(
        {c: F.col(f"_s.{c}") for c in ("lambda_m", "v_ms", "v_kn")}
    ).drop("_s")
