"""Derived views over the driver tables.

The tables hold no images or labels, so each view rewrites one of them row by row into the shape an
operator expects: events become label rows, orders become scored boxes, embeddings become pixels. A
third of the labels and of the boxes fall into one scene, and one label in ten sits on one spot, so
every query meets a hot key. The text is valid in Spark SQL and in DuckDB unless an override is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SQL: dict[str, str] = {}
SPARK_SQL: dict[str, str] = {}

_SCENE_NAME = """concat('S2', CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END, '_MSIL2A_2024',
    lpad(cast(k % 12 + 1 AS string), 2, '0'), lpad(cast(k % 28 + 1 AS string), 2, '0'), 'T03',
    lpad(cast(k AS string), 2, '0'), '31_N0510_R', lpad(cast(100 + k AS string), 3, '0'), '_T48NU',
    substr('ABCDEFGHJK', cast(k % 10 + 1 AS int), 1), '_20240613T061530_TCI_10m.jp2')"""

SQL["v_events"] = """
SELECT event_id AS n, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 40 END AS k, event_type AS kind,
       value, replace(cast(ts AS string), ' ', 'T') AS seen_at
FROM events
"""

SQL["v_scenes"] = f"""
SELECT k, {_SCENE_NAME} AS scene, 2000 AS width, 2000 AS height,
       CASE WHEN k % 8 = 5 THEN NULL WHEN k % 8 = 3 THEN 4326 WHEN k % 8 = 6 THEN 32748 ELSE 32648 END AS epsg,
       CASE WHEN k % 8 = 3 THEN 0.0001e0 ELSE 10e0 END AS a,
       CASE WHEN k % 8 = 3 THEN -0.0001e0 ELSE -10e0 END AS e,
       CASE WHEN k % 8 = 3 THEN 103e0 ELSE 300000e0 + 5000e0 * k END AS x0,
       CASE WHEN k % 8 = 3 THEN 1.5e0 WHEN k % 8 = 6 THEN 9800000e0 ELSE 200000e0 + 7000e0 * k END AS y0
FROM (SELECT DISTINCT o_custkey % 40 AS k FROM orders) s
"""

SQL["v_labels"] = f"""
SELECT n, concat('r', cast(n AS string)) AS id,
       CASE n % 20 WHEN 0 THEN 'overview_grid_tile' WHEN 1 THEN 'static_sea_witness'
            WHEN 2 THEN 'vessel_size_feedback' WHEN 3 THEN 'vessel_size_feedback' END AS record_type,
       CASE WHEN n % 23 = 5 THEN '/data/lost/unknown.jp2'
            WHEN n % 4 = 1 THEN concat('D:', chr(92), 'scenes', chr(92), {_SCENE_NAME})
            ELSE concat('/data/scenes/', {_SCENE_NAME}) END AS tci_path,
       CASE WHEN n % 20 = 0 THEN -1e0 WHEN n % 10 = 7 THEN 1000e0 + (n % 3) / 3e0
            ELSE ((n * 7919) % 6000) / 3e0 END AS cx_full,
       CASE WHEN n % 20 = 0 THEN -1e0 WHEN n % 10 = 7 THEN 500e0 + (n % 7) / 7e0
            ELSE ((n * 104729) % 14000) / 7e0 END AS cy_full,
       CASE WHEN n % 20 = 0 OR n % 13 = 4 THEN NULL WHEN kind IN ('purchase', 'view') THEN 'vessel'
            WHEN kind = 'click' THEN 'water'
            WHEN kind = 'error' THEN CASE WHEN n % 2 = 0 THEN 'cloud' ELSE 'land' END
            ELSE 'ambiguous' END AS review_category,
       CASE WHEN n % 20 = 0 OR n % 7 = 6 THEN NULL ELSE kind IN ('purchase', 'view') END AS is_vessel,
       seen_at AS reviewed_at,
       CASE n % 6 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' WHEN 2 THEN ' low' WHEN 3 THEN ''
            WHEN 4 THEN 'unsure' END AS label_confidence,
       CASE WHEN n % 4 < 2 THEN 10 + (n * 13) % 300 + 1 / 3e0 END AS graphic_length_m,
       CASE WHEN n % 5 < 3 THEN 4 + (n * 7) % 40 + 1 / 7e0 END AS graphic_width_m,
       CASE WHEN n % 9 < 8 THEN cast((n * 13) % 240 AS double) END AS estimated_length_m,
       CASE WHEN n % 9 < 7 THEN 3 + (n * 7) % 45 + 0.25e0 END AS estimated_width_m,
       CASE WHEN n % 2 = 0 THEN 15 + (n * 13) % 300 + 2 / 3e0 END AS human_length_m,
       CASE WHEN n % 6 < 4 THEN 5 + (n * 7) % 40 + 2 / 7e0 END AS human_width_m,
       CASE WHEN n % 30 = 9 THEN cast(20 + n % 50 AS double) END AS graphic_length_m_hull2,
       CASE WHEN n % 30 = 9 THEN cast(5 + n % 9 AS double) END AS graphic_width_m_hull2,
       CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false END AS wake_present,
       n % 15 = 4 AS transhipment_side_by_side,
       CASE WHEN n % 8 = 1 THEN true END AS partial_cloud_obscuration,
       n % 14 = 3 AS has_bridge,
       CASE WHEN n % 4 < 3 THEN cast((n * 53) % 400 AS double) END AS heading_deg_from_north,
       CASE WHEN n % 5 = 1 THEN 'keel_quad_ambiguous' WHEN n % 5 = 2 THEN 'ambiguous_end_end'
            ELSE 'bow_stern' END AS heading_source,
       CASE WHEN n % 2 = 0 THEN ((n * 7919) % 6000) / 3e0 + 4e0 END AS cx_candidate,
       CASE WHEN n % 2 = 0 THEN ((n * 104729) % 14000) / 7e0 - 3e0 END AS cy_candidate,
       CASE WHEN n % 20 = 0 THEN cast((n * 7) % 11 AS int) END AS grid_row,
       CASE WHEN n % 20 = 0 THEN cast((n * 3) % 10 AS int) END AS grid_col,
       CASE WHEN n % 20 = 1 THEN 103e0 + ((n * 31) % 900) / 70000e0 END AS lon,
       CASE WHEN n % 20 = 1 THEN 1e0 + ((n * 17) % 300) / 70000e0 END AS lat
FROM v_events
"""

SQL["v_preds"] = """
SELECT concat('r', cast(n AS string)) AS id,
       CASE WHEN n % 17 < 16 THEN ((n * 37) % 1000) / 999e0 END AS confidence,
       CASE WHEN n % 7 < 6 THEN 12 + (n * 11) % 280 + 1 / 3e0 END AS length_m,
       CASE WHEN n % 7 < 5 THEN 4 + (n * 5) % 38 + 1 / 9e0 END AS width_m,
       CASE WHEN n % 5 < 4 THEN cast((n * 53 + n % 61 + 330) % 360 AS double) END AS heading_keypoint_deg,
       CASE WHEN n % 6 < 5 THEN cast((n * 53 + n % 47 + 340) % 360 AS double) END AS heading_fused_deg,
       CASE WHEN n % 3 = 0 THEN cast((n * 53 + 180 + n % 41) % 360 AS double) END AS heading_wake_deg,
       CASE WHEN n % 4 = 0 THEN cast((n * 53 + n % 83) % 360 AS double) END AS heading_wake_heuristic_deg,
       CASE WHEN n % 5 < 3 THEN cast((n * 53 + n % 29) % 360 AS double) END AS chroma_heading_deg,
       CASE WHEN n % 5 < 4 THEN 1e0 + ((n * 19) % 70) / 11e0 END AS chroma_pnr,
       CASE WHEN n % 5 < 4 THEN ((n * 23) % 170) / 13e0 END AS chroma_speed_ms,
       CASE WHEN n % 3 < 2 THEN ((n * 29) % 101) / 101e0 END AS heading_trust,
       CASE WHEN n % 4 < 3 THEN ((n * 41) % 103) / 103e0 END AS spectral_quality,
       CASE WHEN n % 9 = 2 THEN true WHEN n % 9 = 3 THEN false END AS fp_spectral_flag,
       CASE WHEN n % 4 > 0 THEN ((n * 43) % 107) / 107e0 END AS spectral_consistency,
       CASE WHEN n % 10 = 3 THEN true END AS manual_locator,
       CASE WHEN n % 11 = 2 THEN true END AS coastal_or_land_adjacent,
       CASE WHEN n % 12 = 5 THEN true END AS near_coast_proxy,
       CASE WHEN n % 16 = 7 THEN ((n * 3) % 50) / 10e0 END AS training_priority,
       CASE WHEN n % 5 = 0 THEN (CASE WHEN n % 2 = 0 THEN 'cloud' ELSE 'vessel' END) END AS human_material_category
FROM v_events
"""

SQL["v_dets"] = f"""
SELECT det_id, k, {_SCENE_NAME} AS scene, cx, cy, w, h, score
FROM (
  SELECT o_orderkey AS det_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 40 END AS k,
         ((o_orderkey * 6151) % 6000) / 3e0 AS cx, ((o_orderkey * 3571 + o_custkey) % 14000) / 7e0 AS cy,
         cast(20 + o_orderkey % 60 AS double) AS w, cast(10 + o_orderkey % 25 AS double) AS h,
         ((o_orderkey * 89) % 997) / 997e0 AS score
  FROM orders) d
"""

SQL["v_pixels"] = """
SELECT cast(floor(vec_id / 12) AS bigint) AS chip_id, cast(vec_id % 12 AS int) AS band,
       cast(floor((pos - 1) / 8) AS int) AS r, cast((pos - 1) % 8 AS int) AS c,
       abs(cast(embedding[pos] AS double)) AS v
FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS pos FROM embeddings) x
"""
SPARK_SQL["v_pixels"] = """
SELECT cast(floor(vec_id / 12) AS bigint) AS chip_id, cast(vec_id % 12 AS int) AS band,
       cast(floor(pos / 8) AS int) AS r, cast(pos % 8 AS int) AS c, abs(cast(x AS double)) AS v
FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, x
"""

SQL["v_spectra"] = """
SELECT vec_id, label, list_transform(list_slice(embedding, 1, 12), lambda x: abs(cast(x AS double))) AS spec,
       list_transform(list_slice(embedding, 13, 24), lambda x: abs(cast(x AS double))) AS pred
FROM embeddings
"""
SPARK_SQL["v_spectra"] = """
SELECT vec_id, label, transform(slice(embedding, 1, 12), x -> abs(cast(x AS double))) AS spec,
       transform(slice(embedding, 13, 12), x -> abs(cast(x AS double))) AS pred
FROM embeddings
"""

SQL["v_catalog"] = """
SELECT concat('item', cast(o_orderkey AS string)) AS id,
       CASE WHEN o_orderkey % 10 = 0 THEN 'sentinel-2-l1c' ELSE 'sentinel-2-l2a' END AS collection,
       o_orderdate AS datetime, cast((o_orderkey * 7) % 100 AS double) AS cloud_cover,
       (o_custkey * 7) % 340 - 170e0 AS west, (o_custkey * 3) % 150 - 75e0 AS south,
       (o_custkey * 7) % 340 - 169e0 AS east, (o_custkey * 3) % 150 - 74e0 AS north,
       o_orderkey % 7 > 0 AS has_thumbnail, ((o_orderkey * 31) % 100) / 99e0 AS ocean_score,
       o_orderkey AS n
FROM orders
"""

SQL["v_files"] = f"""
SELECT {_SCENE_NAME} AS scene, k, suffix,
       concat(replace({_SCENE_NAME}, '_TCI_10m', concat('_', suffix)), CASE WHEN (k + b) % 4 = 0 THEN '.part' ELSE '' END) AS file
FROM (SELECT DISTINCT o_custkey % 40 AS k, o_custkey % 13 AS b FROM orders) s
JOIN (SELECT l_suppkey % 13 AS b, CASE l_suppkey % 13 WHEN 0 THEN 'B08_10m' WHEN 1 THEN 'B05_20m'
        WHEN 2 THEN 'B06_20m' WHEN 3 THEN 'B07_20m' WHEN 4 THEN 'B8A_20m' WHEN 5 THEN 'B11_20m'
        WHEN 6 THEN 'B12_20m' WHEN 7 THEN 'B01_60m' WHEN 8 THEN 'B09_60m' WHEN 9 THEN 'B02_10m'
        WHEN 10 THEN 'B03_10m' WHEN 11 THEN 'B04_10m' ELSE 'SCL_20m' END AS suffix
      FROM lineitem GROUP BY l_suppkey % 13) f USING (b)
"""

SQL["v_heads"] = f"""
SELECT det_id AS tile_id, k, {_SCENE_NAME} AS scene, cast(col0 AS int) AS col0, cast(row0 AS int) AS row0,
       640 AS tile_w, 640 AS tile_h, logit, hs, hc, hconf, wx, wy, wconf, len_norm, wid_norm
FROM (
  SELECT o_orderkey AS det_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 40 END AS k,
         (o_orderkey * 61) % 1360 AS col0, (o_orderkey * 37) % 1360 AS row0,
         ((o_orderkey * 89) % 997) / 100e0 - 5 AS logit, ((o_orderkey * 17) % 201) / 100e0 - 1 AS hs,
         ((o_orderkey * 19) % 203) / 101e0 - 1 AS hc, ((o_orderkey * 23) % 61) / 10e0 - 3 AS hconf,
         ((o_orderkey * 29) % 207) / 103e0 - 1 AS wx, ((o_orderkey * 31) % 211) / 105e0 - 1 AS wy,
         ((o_orderkey * 41) % 71) / 10e0 - 3 AS wconf, ((o_orderkey * 43) % 500) / 499e0 AS len_norm,
         ((o_orderkey * 47) % 100) / 499e0 AS wid_norm
  FROM orders) d
"""

_MOSAIC = f"""
SELECT k, {_SCENE_NAME} AS scene, r, c, v, cast(floor(v * 40) AS int) % 12 AS cls,
       cast(floor(v * 300) AS int) % 120 AS occurrence, v * 255e0 AS b0, (1 - v) * 200e0 AS b1, v * v * 255e0 AS b2
FROM ({{}}) q
"""
SQL["v_mosaic"] = _MOSAIC.format("""
  SELECT vec_id % 40 AS k, cast(floor(vec_id / 40) AS int) AS r, cast(pos - 1 AS int) AS c, abs(cast(embedding[pos] AS double)) AS v
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS pos FROM embeddings) x""")
SPARK_SQL["v_mosaic"] = _MOSAIC.format("""
  SELECT vec_id % 40 AS k, cast(floor(vec_id / 40) AS int) AS r, pos AS c, abs(cast(x AS double)) AS v
  FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, x""")

SQL["v_wide"] = """
SELECT chip_id, r, c, """ + ", ".join(
    f"coalesce(max(CASE WHEN band = {i} THEN v END), 0) AS b{i}" for i in range(12)
) + """, count(*) AS n_bands,
  greatest(0e0, 1 - ((r - 3.5e0) * (r - 3.5e0) + (c - 3.5e0) * (c - 3.5e0)) / 12) AS seg,
  CASE WHEN r = 7 THEN 1e0 ELSE 0e0 END AS wake
FROM v_pixels GROUP BY chip_id, r, c
"""

SQL["v_pairs"] = """
SELECT cast(floor(n / 4) AS bigint) AS chip_id, cast(n % 4 AS int) AS pair,
       CASE n % 4 WHEN 0 THEN 'B02' WHEN 3 THEN 'B02' ELSE 'B08' END AS band_a,
       CASE n % 4 WHEN 0 THEN 'B04' WHEN 1 THEN 'B04' WHEN 2 THEN 'B02' ELSE 'B03' END AS band_b,
       CASE n % 4 WHEN 0 THEN 1.004e0 WHEN 1 THEN 1.507e0 ELSE 0.503e0 END AS dt_s,
       (n * 37 % 101) / 71e0 - 0.7e0 AS sx, (n * 53 % 103) / 73e0 - 0.7e0 AS sy, 1.5e0 + (n * 17 % 97) / 23e0 AS pnr
FROM v_events
"""

# Marker sets per label: role, position in the crop, hull, and when it is placed.
_MARKERS = (
    ("side", "40 + n % 9", "22 + n % 4", "1", "n % 3 > 0"),
    ("bow", "70 + n % 11 + 0.5e0", "30 + n % 5", "1", "n % 4 < 2"),
    ("stern", "20 + n % 7", "28 + n % 13", "1", "n % 4 < 2 OR n % 8 = 3"),
    ("side", "41 + n % 9", "38 + n % 6", "NULL", "n % 3 > 0"),
    ("end", "15 + n % 5", "50e0", "1", "n % 5 < 2"),
    ("end", "75 - n % 5", "52 + n % 7", "1", "n % 5 < 2"),
    ("port", "44e0", "20 - n % 3", "1", "n % 6 = 0"),
    ("starboard", "45e0", "44 + n % 3", "1", "n % 6 = 0"),
    ("bridge", "30 + n % 6", "31e0", "1", "n % 7 = 2"),
    ("bow", "72 + n % 11", "33 + n % 5", "1", "n % 12 = 1"),
    ("wake", "10e0", "26 + n % 3", "1", "n % 9 < 4"),
    ("wake", "2 + n % 4", "60 - n % 8", "1", "n % 9 < 3"),
    ("bow", "66e0", "80 + n % 4", "2", "n % 10 = 0"),
    ("stern", "22e0", "82e0", "2", "n % 10 = 0"),
)


def _marker_sql(struct: str, array: str) -> str:
    items = ", ".join(
        f"CASE WHEN {cond} THEN " + struct.format(role=role, x=x, y=y, hull=hull) + " END" for role, x, y, hull, cond in _MARKERS
    )
    return f"""
SELECT n, concat('r', cast(n AS string)) AS id, k, {_SCENE_NAME} AS scene, cast((n * 31) % 1800 AS int) AS col_off,
       cast((n * 17) % 1800 AS int) AS row_off, {array.format(items=items)} AS markers
FROM v_events
"""


SQL["v_markers"] = _marker_sql(
    "{{'role': '{role}', 'x': cast({x} AS double), 'y': cast({y} AS double), 'hull': cast({hull} AS int)}}",
    "list_filter([{items}], lambda m: m IS NOT NULL)",
)
SPARK_SQL["v_markers"] = _marker_sql(
    "named_struct('role', '{role}', 'x', cast({x} AS double), 'y', cast({y} AS double), 'hull', cast({hull} AS int))",
    "filter(array({items}), m -> m IS NOT NULL)",
)

SQL["v_wakes"] = """
SELECT l_orderkey, l_linenumber, l_extendedprice / 97e0 AS distance_m, 1 + l_quantity / 10e0 AS crests
FROM lineitem
"""


class Views:
    """Derived views of one data folder as DataFrames; nothing is read until a query runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run ``text`` with every table or view it mentions bound to this folder."""
        import re

        args = {}
        for name in [*SQL, *TABLES]:
            if re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                text = re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{{{name}}}", text)
                args[name] = getattr(self, name[2:]) if name in SQL else self.table(name)
        return self.spark.sql(text, **args)

    def view(self, name: str) -> DataFrame:
        return self.sql(SPARK_SQL.get(name, SQL[name]))

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" in SQL:
            return self.view(f"v_{name}")
        raise AttributeError(name)
