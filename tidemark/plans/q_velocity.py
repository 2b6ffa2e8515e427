"""Registered queries: band shifts and velocity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import angles as A
from tidemark.operators import pixels as P
from tidemark.operators import velocity as V
from tidemark.plans.q_eval import rounded
from tidemark.plans.q_scenes import DET_BASE, lines_sql
from tidemark.plans.registry import query

KN = "(1 / 0.514444::double)"
AXIS = "1 / (sqrt(2.0::double) * pi() * greatest({p}, 1))"


def shifts(v):
    return v.pairs.withColumns({"shift": F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), "pnr"),
                                "convergence_deg": F.lit(0.0)}).drop("sx", "sy", "pnr")


@query("j1_measure_shifts")
def _(v):
    s = V.measure_shifts(V.band_pairs(P.stack_bands(v.pixels)))
    return rounded(s.select("chip_id", "band_a", "band_b", "shift.*"))


@query("j2_single_pair", f"""
WITH x AS (SELECT *, sqrt(sx * sx + sy * sy) AS px, ((degrees(atan2(sx, -sy)) % 360) + 360) % 360 AS hd FROM v_pairs),
y AS (SELECT *, px * 10 / dt_s AS v FROM x WHERE pnr >= 2.8 AND px * 10 / dt_s <= 26)
SELECT chip_id, pair, round_even(v, 3) AS speed_ms, round_even(v * {KN}, 2) AS speed_kn, CASE WHEN px >= 0.1 THEN round_even(hd, 1) END AS heading_deg,
 round_even(greatest({AXIS.format(p='pnr')} * sqrt(2.0::double) * 10 / dt_s * {KN}, 0.1), 1) AS speed_error_kn,
 CASE WHEN px >= 0.1 THEN round_even(greatest(1, least(90, degrees({AXIS.format(p='pnr')} / px))), 0) END AS heading_error_deg FROM y""")
def _(v):
    return V.single_pair(shifts(v)).select("chip_id", "pair", "speed_ms", "speed_kn", "heading_deg", "speed_error_kn", "heading_error_deg")


USABLE = """u AS (SELECT chip_id, pair, dt_s, band_a, band_b, round_even(sx, 4) AS sx, round_even(sy, 4) AS sy, round_even(pnr, 2) AS p,
  round_even(sqrt(sx * sx + sy * sy) * 10 / dt_s, 3) AS v, round_even(((degrees(atan2(sx, -sy)) % 360) + 360) % 360, 1) AS hd
  FROM v_pairs WHERE pnr >= 2.0 AND sqrt(sx * sx + sy * sy) * 10 / dt_s <= 26)"""
COMB = """a AS (SELECT chip_id, count(*) AS n, sum(p) AS w, sum(p * v * sin(radians(hd))) / sum(p) AS vx, sum(-p * v * cos(radians(hd))) / sum(p) AS vy,
  count(*) / sum(1 / greatest(p, 0.01)) AS hp, sum(p * cos(radians(hd))) / sum(p) AS mc, sum(p * sin(radians(hd))) / sum(p) AS ms, avg(sqrt(sx * sx + sy * sy)) AS px,
  arg_max(struct_pack(dt := dt_s, b := band_a, v := v, hd := hd, p := p), (p, -pair)) AS best FROM u GROUP BY chip_id),
c AS (SELECT *, CASE WHEN n = 1 THEN best.v ELSE sqrt(vx * vx + vy * vy) END AS sp, degrees(sqrt(greatest(0, -2 * ln(least(1, sqrt(mc * mc + ms * ms)))))) AS spread FROM a)"""


@query("j3_combine_pairs", f"""
WITH {USABLE}, {COMB}
SELECT chip_id, n AS n_pairs, round_even(sp, 3) AS speed_ms, round_even(sp * {KN}, 2) AS speed_kn,
 CASE WHEN px >= 0.1 THEN CASE WHEN n = 1 THEN best.hd ELSE round_even(((degrees(atan2(vx, -vy)) % 360) + 360) % 360, 1) END END AS heading_deg,
 CASE WHEN n = 1 THEN best.p ELSE round_even(hp, 2) END AS pnr, best.b AS band_a FROM c WHERE n = 1 OR (hp >= 2.5 AND sp <= 26)""")
def _(v):
    out = V.combine_pairs(V.usable_pairs(shifts(v)))
    return out.select("chip_id", "n_pairs", "speed_ms", "speed_kn", "heading_deg", "pnr", "band_a")


@query("j4_velocity_errors", f"""
WITH {USABLE}, {COMB},
sv AS (SELECT c.chip_id, sqrt(sum(u.p * pow(u.v * {KN} - round_even(c.sp * {KN}, 2), 2)) / sum(u.p)) AS emp FROM c JOIN u USING (chip_id) GROUP BY c.chip_id),
e AS (SELECT c.*, emp, {AXIS.format(p='CASE WHEN n = 1 THEN best.p ELSE hp END')} AS ax FROM c JOIN sv USING (chip_id) WHERE n = 1 OR (hp >= 2.5 AND sp <= 26))
SELECT chip_id, round_even(greatest(ax * sqrt(2.0::double) * 10 / best.dt * {KN} / sqrt(n), CASE WHEN n >= 2 THEN emp / sqrt(n) END, 0.1), 1) AS speed_error_kn,
 CASE WHEN px >= 0.1 THEN round_even(greatest(1, least(90, greatest(degrees(ax / (px * sqrt(n))), CASE WHEN n >= 2 THEN spread / sqrt(n) END))), 0) END AS heading_error_deg FROM e""")
def _(v):
    return V.combine_pairs(V.usable_pairs(shifts(v))).select("chip_id", "speed_error_kn", "heading_error_deg")


@query("e22_circular_std", f"""
WITH {USABLE}, {COMB} SELECT chip_id, round(CASE WHEN n >= 2 THEN spread END, 6) AS spread_deg FROM c""")
def _(v):
    u = V.usable_pairs(shifts(v))
    return rounded(u.groupBy("chip_id").agg(A.circular_std("heading_deg", "pnr").alias("spread_deg")))


@query("e23_weighted_vector", f"""
WITH {USABLE}, {COMB} SELECT chip_id, round(sqrt(vx * vx + vy * vy), 3) AS speed_ms, round(hp, 2) AS pnr FROM c WHERE n >= 2 AND hp >= 2.5 AND sqrt(vx * vx + vy * vy) <= 26""")
def _(v):
    return V.combine_pairs(V.usable_pairs(shifts(v))).filter("n_pairs >= 2").select("chip_id", "speed_ms", "pnr")


@query("j3_band_velocity")
def _(v):
    return V.band_velocity(P.stack_bands(v.pixels))


@query("j6_backfill_errors", f"""
WITH x AS (SELECT id, chroma_speed_ms / 2 AS kn, chroma_pnr AS p, chroma_heading_deg AS hd, CASE WHEN confidence > 0.7 THEN 1.5::double END AS old FROM v_preds),
y AS (SELECT *, kn * 0.514444 * 1.004 / 10 AS px, kn IS NOT NULL AND p IS NOT NULL AND old IS NULL AS todo FROM x)
SELECT id, CASE WHEN todo THEN round_even(greatest({AXIS.format(p='p')} * sqrt(2.0::double) * 10 / 1.004 * {KN}, 0.1), 1) ELSE old END AS speed_error_kn,
 CASE WHEN todo AND px >= 0.1 AND hd IS NOT NULL THEN round_even(greatest(1, least(90, degrees({AXIS.format(p='p')} / px))), 0) END AS heading_error_deg, todo AS filled FROM y""")
def _(v):
    d = v.preds.select("id", (F.col("chroma_speed_ms") / 2).alias("chroma_speed_kn"), "chroma_pnr", "chroma_heading_deg",
                       F.when(F.col("confidence") > 0.7, 1.5).alias("speed_error_kn"), F.lit(None).cast("double").alias("heading_error_deg"))
    return V.backfill_errors(d).select("id", "speed_error_kn", "heading_error_deg", "filled")


@query("j7_wake_from_pixels", f"""
WITH {DET_BASE}, {lines_sql('cx', 'cy', 'cx + w', 'cy - h')}
SELECT det_id, round(metres_ / (2 + det_id % 5), 3) AS lambda_m, round(sqrt(metres_ / (2 + det_id % 5) * 9.8 / (2 * pi())) * 1.94384, 3) AS v_kn FROM measured""")
def _(v):
    from tidemark.operators.scenes import with_georeference

    d = with_georeference(v.dets, v.scenes, "scene")
    d = d.withColumns({"x1": F.col("cx"), "y1": F.col("cy"), "x2": F.col("cx") + F.col("w"), "y2": F.col("cy") - F.col("h"),
                       "crests": 2 + F.col("det_id") % 5})
    return rounded(V.wake_from_pixels(d).select("det_id", "lambda_m", "v_kn"), 3)
