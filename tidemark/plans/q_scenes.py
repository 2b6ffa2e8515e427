"""Registered queries: catalog, file names, georeference, static sites."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions import geo as G
from tidemark.functions import labels as L
from tidemark.functions import names as N
from tidemark.operators import scenes as SC
from tidemark.plans.q_labels import BASE, EXPORT
from tidemark.plans.registry import query

PI = "pi()"
PAT = "(?i)(S2[AB])_MSIL\\w+?_(\\d{8}T\\d{6})_N\\d+_(R\\d+)_(T[A-Z0-9]+)_"


def lonlat_sql(x: str, y: str) -> str:
    """Inverse UTM written out for DuckDB: a table expression over rows with id columns and affine."""
    n = G._N
    terms_xi = " ".join(f"- {b!r} * sin({2*j} * xi) * cosh({2*j} * eta)" for j, b in enumerate(G._BETA, 1))
    terms_eta = " ".join(f"- {b!r} * cos({2*j} * xi) * sinh({2*j} * eta)" for j, b in enumerate(G._BETA, 1))
    terms_lat = " ".join(f"+ {d!r} * sin({2*j} * chi)" for j, d in enumerate(G._DELTA, 1))
    k = G.UTM_SCALE * G._RECT
    assert n
    return f"""
g0 AS (SELECT *, {x} AS mx, {y} AS my FROM base),
g1 AS (SELECT *, (my - CASE WHEN epsg >= 32700 THEN 10000000.0::double ELSE 0 END) / {k!r} AS xi, (mx - 500000.0::double) / {k!r} AS eta,
  (CASE WHEN epsg >= 32700 THEN epsg - 32700 ELSE epsg - 32600 END) * 6 - 183 AS lon0 FROM g0),
g2 AS (SELECT *, xi {terms_xi} AS xi1, eta {terms_eta} AS eta1 FROM g1),
g3 AS (SELECT *, asin(least(1, greatest(-1, sin(xi1) / cosh(eta1)))) AS chi FROM g2),
ll AS (SELECT *, CASE WHEN epsg = 4326 THEN mx WHEN epsg IS NOT NULL THEN degrees(atan2(sinh(eta1), cos(xi1))) + lon0 END AS lon_,
  CASE WHEN epsg = 4326 THEN my WHEN epsg IS NOT NULL THEN degrees(chi {terms_lat}) END AS lat_ FROM g3)"""


def geodesic_sql(source: str, steps: int = 6) -> str:
    """Vincenty's inverse written out for DuckDB, one table a step: ``geo`` adds dist_ and az_ to rows with lo1, la1, lo2, la2."""
    f, a = G.WGS84_F, G.WGS84_A
    b = a * (1 - f)
    parts = [f"""v0 AS (SELECT *, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, dl AS lam FROM (
  SELECT *, atan({1 - f!r} * tan(radians(la1))) AS u1, atan({1 - f!r} * tan(radians(la2))) AS u2, radians(lo2) - radians(lo1) AS dl FROM {source}))"""]
    arc = f"""SELECT *, CASE WHEN ca2 > 1e-15 THEN cs - 2 * s1 * s2 / ca2 ELSE 0 END AS c2m, {f / 16!r} * ca2 * (4 + {f!r} * (4 - 3 * ca2)) AS k FROM (
  SELECT *, 1 - sa * sa AS ca2 FROM (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss > 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa FROM (
  SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM {{}})))"""
    for i in range(steps):
        parts.append(f"""v{i + 1} AS (SELECT * EXCLUDE (ss, cs, sigma, sa, ca2, c2m, k) REPLACE (
  dl + (1 - k) * {f!r} * sa * (sigma + k * ss * (c2m + k * cs * (2 * c2m * c2m - 1))) AS lam) FROM ({arc.format(f'v{i}')}))""")
    parts.append(f"""geo AS (SELECT *, {b!r} * aa * (sigma - bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1) - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) AS dist_,
  (degrees(atan2(c2 * sin(lam), c1 * s2 - s1 * c2 * cos(lam))) + 360) % 360 AS az_ FROM (
  SELECT *, 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768)) AS aa, uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128)) AS bb FROM (
  SELECT *, ca2 * {(a * a - b * b) / (b * b)!r} AS uu FROM ({arc.format(f'v{steps}')}))))""")
    return ",\n".join(parts)


def lines_sql(x1: str, y1: str, x2: str, y2: str, source: str = "base") -> str:
    """``geo``: the geodesic between two pixels of geographic scenes; ``plane_`` is the plane distance, for all others."""
    place = [c.format(p) for p, c in zip((x1, y1, x2, y2), CENTRE * 2)]
    return f"""lines AS (SELECT *, {place[0]} AS lo1, {place[1]} AS la1, {place[2]} AS lo2, {place[3]} AS la2 FROM {source}),
{geodesic_sql("lines")},
measured AS (SELECT *, CASE WHEN epsg = 4326 THEN dist_ ELSE sqrt(pow(lo2 - lo1, 2) + pow(la2 - la1, 2)) END AS metres_ FROM geo)"""


CENTRE = ("x0 + ({} + 0.5) * a", "y0 + ({} + 0.5) * e")


@query("a9_catalog_search", """
SELECT id FROM v_catalog WHERE collection = 'sentinel-2-l2a' AND west <= 60 AND east >= -40 AND south <= 40 AND north >= -30
 AND datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-06-30' AND cloud_cover <= 30""")
def _(v):
    return SC.catalog_search(v.catalog, (-40, -30, 60, 40), "1996-01-01", "1999-06-30", 30.0, limit=None).select("id")


@query("a9_catalog_newest", """
SELECT id, cloud_cover FROM v_catalog WHERE collection = 'sentinel-2-l2a' AND west <= 60 AND east >= -40 AND south <= 40 AND north >= -30
 AND datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-06-30' AND cloud_cover <= 30 ORDER BY datetime DESC, id LIMIT 15""")
def _(v):
    return SC.catalog_search(v.catalog, (-40, -30, 60, 40), "1996-01-01", "1999-06-30", limit=15).select("id", "cloud_cover")


@query("a10_catalog_get", """
SELECT c.id, c.cloud_cover FROM v_catalog c WHERE c.id IN (SELECT concat('item', l_partkey) FROM lineitem)""")
def _(v):
    ids = v.table("lineitem").select(F.concat(F.lit("item"), F.col("l_partkey").cast("string")).alias("id"))
    return SC.catalog_get(v.catalog, ids).select("id", "cloud_cover")


SETTINGS = {"conf": 0.5, "nms_iou": 0.3}


@query("a14_stale_scenes", f"""
WITH f AS (SELECT scene, substr(sha256(concat(scene, '|', k, '|', '{json.dumps(SETTINGS, sort_keys=True)}')), 1, 16) AS fingerprint FROM v_scenes),
done AS (SELECT DISTINCT scene, substr(sha256(concat(scene, '|', k + det_id % 2, '|', '{json.dumps(SETTINGS, sort_keys=True)}')), 1, 16) AS fingerprint
  FROM v_dets WHERE score > 0.99)
SELECT scene, fingerprint FROM f ANTI JOIN done USING (scene, fingerprint)""")
def _(v):
    text = json.dumps(SETTINGS, sort_keys=True)
    ver = (F.col("k") + F.col("det_id") % 2).cast("string")
    done = v.dets.filter("score > 0.99").select("scene", F.substring(F.sha2(
        F.concat_ws("|", "scene", ver, F.lit(text)), 256), 1, 16).alias("fingerprint")).distinct()
    return SC.stale_scenes(v.scenes.withColumn("version", F.col("k")), done, SETTINGS).select("scene", "fingerprint")


@query("b5_scene_metadata", f"""
WITH m AS (SELECT id, {BASE} AS name FROM v_labels),
t AS (SELECT id, name, try_strptime(nullif(regexp_extract(name, '{PAT}', 2), ''), '%Y%m%dT%H%M%S') AS t FROM m)
SELECT id, CASE WHEN t IS NOT NULL THEN regexp_extract(name, '{PAT}', 1) END AS platform,
 CASE WHEN t IS NOT NULL THEN regexp_extract(name, '{PAT}', 4) END AS tile,
 CASE WHEN t IS NOT NULL THEN regexp_extract(name, '{PAT}', 3) END AS orbit,
 strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS sensed_at,
 round_even(hour(t) + minute(t) / 60.0 + second(t) / 3600.0, 3) AS utc_hour,
 CASE WHEN month(t) IN (3,4,5) THEN 'spring' WHEN month(t) IN (6,7,8) THEN 'summer' WHEN month(t) IN (9,10,11) THEN 'autumn'
  WHEN t IS NOT NULL THEN 'winter' END AS season FROM t""")
def _(v):
    return v.labels.select("id", N.scene_metadata("tci_path").alias("m")).select("id", "m.*")


PID = N.PRODUCT_PATTERN


@query("b6_product_and_time", f"""
WITH m AS (SELECT id, CASE WHEN n % 5 = 0 THEN 'T48NUG_2024_TCI.jp2' WHEN n % 5 = 1 THEN concat('x_20240613T031531_N0510_R118_T48NUG_', n)
  ELSE {BASE} END AS name FROM v_labels)
SELECT id, CASE WHEN regexp_matches(name, '{PID}') THEN regexp_extract(name, '{PID}', 1)
  WHEN contains(name, '_TCI_10m') THEN split_part(name, '_TCI_10m', 1) WHEN contains(name, '_TCI.jp2') THEN split_part(name, '_TCI.jp2', 1)
  WHEN ends_with(name, 'TCI.jp2') THEN rtrim(left(name, length(name) - 7), '_') END AS product,
 CASE WHEN regexp_matches(name, '{N.TIME_PATTERN}') THEN regexp_replace(regexp_extract(name, '{N.TIME_PATTERN}'),
   '^.*_(\\d{{4}})(\\d\\d)(\\d\\d)T(\\d\\d)(\\d\\d)(\\d\\d)$', '\\1-\\2-\\3, \\4:\\5:\\6 UTC')
  WHEN regexp_matches(name, '{N.TIME_FALLBACK}') THEN regexp_replace(regexp_extract(name, '{N.TIME_FALLBACK}'),
   '^_(\\d{{4}})(\\d\\d)(\\d\\d)T(\\d\\d)(\\d\\d)(\\d\\d)_.*$', '\\1-\\2-\\3, \\4:\\5:\\6 UTC') END AS acquired FROM m""")
def _(v):
    name = F.when(F.col("n") % 5 == 0, "T48NUG_2024_TCI.jp2").when(
        F.col("n") % 5 == 1, F.concat(F.lit("x_20240613T031531_N0510_R118_T48NUG_"), F.col("n").cast("string"))
    ).otherwise(L.basename("tci_path"))
    return v.labels.select("id", name.alias("name")).select(
        "id", N.product_id("name").alias("product"), N.acquired_utc("name").alias("acquired"))


@query("b17_item_centroid", """
WITH x AS (SELECT n, id, datetime, cloud_cover, west, south, east, north FROM v_catalog)
SELECT id, round(CASE WHEN n % 3 = 0 THEN west WHEN n % 3 = 1 THEN (west + east + east + west + west) / 5 ELSE (west + east + east) / 3 END, 6) AS lon,
 round(CASE WHEN n % 3 = 0 THEN south WHEN n % 3 = 1 THEN (south + south + north + north + south) / 5 ELSE (south + south + north) / 3 END, 6) AS lat,
 concat(id, '  ·  ', strftime(datetime, '%Y-%m-%d'), '  ·  ', cast(cloud_cover AS int), '% cloud') AS label FROM x""")
def _(v):
    p = lambda x, y: F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]"))
    ring = lambda *ps: F.concat(F.lit("["), F.concat_ws(",", *ps), F.lit("]"))
    wrap = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    sw, se, ne, nw = p("west", "south"), p("east", "south"), p("east", "north"), p("west", "north")
    kind = F.col("n") % 3
    g = F.struct(
        F.when(kind == 0, "Point").when(kind == 1, "Polygon").otherwise("MultiPolygon").alias("type"),
        F.when(kind == 0, sw).when(kind == 1, wrap(ring(sw, se, ne, nw, sw))).otherwise(wrap(wrap(ring(sw, se, ne)))).alias("coordinates"))
    out = v.catalog.withColumn("g", g).withColumn("c", SC.item_centroid("g"))
    return out.select("id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"),
                      SC.item_label("id", "datetime", "cloud_cover").alias("label"))


@query("b20_band_path", """
SELECT id, CASE WHEN contains(tci_path, '_TCI_10m') THEN replace(tci_path, '_TCI_10m', '_B08_10m')
  ELSE replace(tci_path, 'TCI', 'B08_10m') END AS path FROM v_labels""")
def _(v):
    return v.labels.select("id", N.band_path("tci_path", "B08_10m").alias("path"))


TILE = """concat(lpad(cast(abs(floor(({lon})/10)*10)::int AS varchar),3,'0'), CASE WHEN floor(({lon})/10) >= 0 THEN 'E' ELSE 'W' END, '_',
  lpad(cast(abs(floor(({lat})/10)*10)::int AS varchar),2,'0'), CASE WHEN floor(({lat})/10) >= 0 THEN 'N' ELSE 'S' END)"""


@query("b22_water_tiles", f"""
WITH b AS (SELECT id, west, south, east + 12 AS east, north + 3 AS north FROM v_catalog),
x AS (SELECT id, south, north, unnest(generate_series(floor(west/10)::bigint, floor(east/10)::bigint)) AS gx FROM b),
y AS (SELECT id, gx, unnest(generate_series(floor(south/10)::bigint, floor(north/10)::bigint)) AS gy FROM x)
SELECT DISTINCT id, {TILE.format(lon='gx*10+5', lat='gy*10+5')} AS tile FROM y""")
def _(v):
    b = v.catalog.withColumns({"east": F.col("east") + 12, "north": F.col("north") + 3})
    return SC.water_tiles(b, "id")


@query("b22_water_tile_key", f"SELECT id, {TILE.format(lon='west', lat='south')} AS tile FROM v_catalog")
def _(v):
    return v.catalog.select("id", G.water_tile_key("west", "south").alias("tile"))


@query("b23_cell_key", """
SELECT id, round_even(lon, 4) AS cell_lon, round_even(lat, 4) AS cell_lat FROM v_labels""")
def _(v):
    return v.labels.select("id", G.cell_key("lon", "lat").alias("c")).select("id", "c.*")


@query("c12_first_ocean_item", """
WITH r AS (SELECT *, cast(west AS bigint) AS area, row_number() OVER (PARTITION BY west ORDER BY datetime DESC, id) AS rank FROM v_catalog)
SELECT area, arg_min(id, rank) AS id, min(rank)::int AS rank FROM r WHERE has_thumbnail AND ocean_score >= 0.9 GROUP BY area""")
def _(v):
    items = SC.rank_items(v.catalog.withColumn("area", F.col("west").cast("bigint")), "area")
    return SC.first_ocean_item(items, "area", min_score=0.9)


@query("d6_window_overlap", """
WITH a AS (SELECT det_id, floor(cx)::int - 40 AS c0, floor(cy)::int - 40 AS r0 FROM v_dets),
b AS (SELECT det_id, floor(w)::int * 20 AS c0, floor(h)::int * 30 AS r0 FROM v_dets),
x AS (SELECT a.det_id, b.c0 AS bc, b.r0 AS br, greatest(a.c0, b.c0) AS l, greatest(a.r0, b.r0) AS t,
  least(a.c0 + 80, b.c0 + 1000) AS rr, least(a.r0 + 80, b.r0 + 900) AS bb FROM a JOIN b USING (det_id))
SELECT det_id, l - bc AS px0, t - br AS py0, rr - bc - 1 AS px1, bb - br - 1 AS py1 FROM x WHERE l < rr AND t < bb""")
def _(v):
    d = v.dets
    win = lambda c, r, w, h: d.select("det_id", c.cast("int").alias("c0"), r.cast("int").alias("r0"),
                                      F.lit(w).alias("w"), F.lit(h).alias("h"))
    a = win(F.floor("cx") - 40, F.floor("cy") - 40, 80, 80)
    b = win(F.floor("w") * 20, F.floor("h") * 30, 1000, 900)
    return SC.window_overlap(a, b, "det_id")


@query("d11_class_raster", """
WITH f AS (SELECT DISTINCT file FROM v_files WHERE contains(file, 'SCL'))
SELECT scene, f.file AS class_file FROM v_scenes LEFT JOIN f ON f.file = replace(scene, 'TCI_10m', 'SCL_20m')""")
def _(v):
    return SC.class_raster_for_scene(v.scenes, v.files)


EXTRA = "(VALUES ('B08','B08_10m',1),('B05','B05_20m',2),('B06','B06_20m',3),('B07','B07_20m',4),('B8A','B8A_20m',5),('B11','B11_20m',6),('B12','B12_20m',7),('B01','B01_60m',8),('B09','B09_60m',9)) b(band, suffix, i)"


@query("e21_band_availability", f"""
WITH w AS (SELECT scene, band, i, replace(scene, 'TCI_10m', suffix) AS file FROM v_scenes CROSS JOIN {EXTRA}),
p AS (SELECT w.*, f.file IS NOT NULL AS present FROM w LEFT JOIN (SELECT DISTINCT file FROM v_files) f ON f.file = w.file)
SELECT scene, count(*) FILTER (present) AS n_bands, string_agg(concat(band, CASE WHEN present THEN ' ✓' ELSE ' ✗' END), '  ' ORDER BY i) AS summary
FROM p GROUP BY scene""")
def _(v):
    return SC.band_availability(v.scenes, v.files)


@query("s3_missing_files", """
SELECT scene, suffix, replace(scene, 'TCI_10m', suffix) AS file FROM v_scenes
CROSS JOIN (VALUES ('B02_10m'),('B03_10m'),('B04_10m'),('B08_10m')) b(suffix)
WHERE replace(scene, 'TCI_10m', suffix) NOT IN (SELECT file FROM v_files)""")
def _(v):
    return SC.missing_files(v.scenes, v.files).select("scene", "suffix", "file")


@query("e11_static_cells", """
SELECT round_even(lon, 4) AS cell_lon, round_even(lat, 4) AS cell_lat, count(*) AS hits
FROM v_labels WHERE record_type = 'static_sea_witness' AND lon IS NOT NULL GROUP BY 1, 2""")
def _(v):
    from tidemark.operators import labels as LB

    return SC.static_cells(LB.witnesses(v.labels))


@query("e10_witness_summary", """
WITH c AS (SELECT count(*) AS hits FROM v_labels WHERE record_type = 'static_sea_witness' AND lon IS NOT NULL
  GROUP BY round_even(lon, 4), round_even(lat, 4))
SELECT count(*) FILTER (hits >= 2) AS n_hot_cells, sum(hits)::bigint AS n_rows FROM c""")
def _(v):
    from tidemark.operators import labels as LB

    return SC.witness_summary(LB.witnesses(v.labels))


DET_BASE = "base AS (SELECT d.*, s.epsg, s.a, s.e, s.x0, s.y0, s.width, s.height FROM v_dets d LEFT JOIN v_scenes s USING (scene))"


@query("g4_pixel_to_lonlat", f"""
WITH {DET_BASE}, {lonlat_sql(CENTRE[0].format('cx'), CENTRE[1].format('cy'))}
SELECT det_id, round(lon_, 6) AS lon, round(lat_, 6) AS lat FROM ll""")
def _(v):
    out = SC.with_lonlat(v.dets, v.scenes, image="scene", x="cx", y="cy")
    return out.select("det_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("c6_drop_static_sea", f"""
WITH {DET_BASE}, {lonlat_sql(CENTRE[0].format('cx'), CENTRE[1].format('cy'))},
hot AS (SELECT round_even(lon_, 2) AS a, round_even(lat_, 2) AS b, count(*) AS c FROM ll WHERE lon_ IS NOT NULL AND score > 0.8 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT det_id FROM ll WHERE NOT EXISTS (SELECT 1 FROM hot WHERE hot.a = round_even(lon_, 2) AND hot.b = round_even(lat_, 2))""")
def _(v):
    seen = SC.with_lonlat(v.dets.filter("score > 0.8"), v.scenes, image="scene", x="cx", y="cy")
    return SC.drop_static_sea(v.dets, v.scenes, SC.static_cells(seen, 2), 3, decimals=2).select("det_id")


@query("e12_static_vessels", f"""
WITH base AS (SELECT l.* EXCLUDE (lon, lat), s.epsg, s.a, s.e, s.x0, s.y0,
  CASE WHEN graphic_length_m > 0 AND graphic_width_m > 0 THEN graphic_length_m WHEN estimated_length_m > 0 AND estimated_width_m > 0 THEN estimated_length_m END AS lm,
  CASE WHEN graphic_length_m > 0 AND graphic_width_m > 0 THEN graphic_width_m WHEN estimated_length_m > 0 AND estimated_width_m > 0 THEN estimated_width_m END AS wm
  FROM v_labels l JOIN v_scenes s ON s.scene = {BASE} WHERE record_type IS NULL AND review_category = 'vessel'),
{lonlat_sql(CENTRE[0].format('cx_full'), CENTRE[1].format('cy_full'))},
b AS (SELECT round_even(lon_ * 1000, 0) / 1000 AS cell_lon, round_even(lat_ * 1000, 0) / 1000 AS cell_lat,
  round_even(lm / (greatest(lm, wm, 1) * 0.28), 0)::int AS length_bucket, round_even(wm / (greatest(lm, wm, 1) * 0.28), 0)::int AS width_bucket,
  substr(reviewed_at, 1, 10) AS day, tci_path FROM ll WHERE lon_ IS NOT NULL AND lm IS NOT NULL)
SELECT cell_lon, cell_lat, length_bucket, width_bucket, count(*) AS n_rows, count(DISTINCT day) AS n_days, count(DISTINCT tci_path) AS n_images
FROM b GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT day) >= 2""")
def _(v):
    return SC.static_vessel_clusters(v.labels, v.scenes, decimals=3)


@query("g1_pixel_distance", """
SELECT det_id, round(sqrt(((w - cx) * 10.0) * ((w - cx) * 10.0) + ((h - cy) * 10.0) * ((h - cy) * 10.0)), 6) AS metres FROM v_dets""")
def _(v):
    return v.dets.select("det_id", F.round(G.pixel_distance("cx", "cy", "w", "h", 10.0), 6).alias("metres"))


@query("g2_ground_distance", f"""
WITH {DET_BASE}, {lines_sql('cx', 'cy', 'cx + w', 'cy + h')}
SELECT det_id, round(metres_, 3) AS metres FROM measured""")
def _(v):
    d = SC.with_georeference(v.dets, v.scenes, "scene")
    return d.select("det_id", F.round(G.ground_distance("cx", "cy", F.col("cx") + F.col("w"), F.col("cy") + F.col("h")), 3).alias("metres"))


@query("g3_bearing", f"""
WITH base AS (SELECT d.det_id, p, round_even(CASE p WHEN 1 THEN cx ELSE cx + w END * 4, 0) / 4 AS px, round_even(CASE p WHEN 1 THEN cy ELSE cy - h END * 4, 0) / 4 AS py,
  s.epsg, s.a, s.e, s.x0, s.y0 FROM v_dets d LEFT JOIN v_scenes s USING (scene), (SELECT unnest([1, 2]) AS p) q),
{lonlat_sql(CENTRE[0].format('px'), CENTRE[1].format('py'))},
lines AS (SELECT m.det_id, m.lon_ AS lo1, m.lat_ AS la1, n.lon_ AS lo2, n.lat_ AS la2 FROM ll m JOIN ll n ON n.det_id = m.det_id AND m.p = 1 AND n.p = 2),
{geodesic_sql("lines")}
SELECT det_id, round(az_, 4) AS bearing_deg FROM geo""")
def _(v):
    d = SC.with_georeference(v.dets, v.scenes, "scene")
    d = G.add_bearing(d, "cx", "cy", F.col("cx") + F.col("w"), F.col("cy") - F.col("h"))
    return d.select("det_id", F.round("bearing_deg", 4).alias("bearing_deg"))


@query("g5_metres_per_pixel", f"""
WITH {DET_BASE}
SELECT det_id, round(CASE WHEN epsg = 4326 THEN abs(a) * 111320 * cos(radians(y0 + (round_even(cy, 0) + 0.5) * e)) ELSE abs(a) END, 6) AS gsd_x,
 round(CASE WHEN epsg = 4326 THEN abs(e) * 111320 ELSE abs(e) END, 6) AS gsd_y FROM base""")
def _(v):
    gx, gy = G.ground_metres_per_pixel("cx", "cy")
    return SC.with_georeference(v.dets, v.scenes, "scene").select(
        "det_id", F.round(gx, 6).alias("gsd_x"), F.round(gy, 6).alias("gsd_y"))


@query("g6_window_side", f"""
WITH {DET_BASE}
SELECT det_id, greatest(1, round_even(1000 / ((CASE WHEN epsg = 4326 THEN abs(a) * 111320 * cos(radians(y0 + (height // 2 + 0.5) * e)) ELSE abs(a) END
  + CASE WHEN epsg = 4326 THEN abs(e) * 111320 ELSE abs(e) END) / 2), 0)::int) AS side FROM base""")
def _(v):
    return SC.with_georeference(v.dets, v.scenes, "scene").select("det_id", G.window_side(1000.0).alias("side"))


@query("g7_overview_mapping", f"""
WITH {DET_BASE}, o AS (SELECT det_id, least(greatest(cx / width * 168, 0), 167) AS ox, least(greatest(cy / height * 168, 0), 167) AS oy, width, height FROM base)
SELECT det_id, round(ox, 6) AS ox, round(oy, 6) AS oy, round(ox / 168 * width, 6) AS bx, round(oy / 168 * height, 6) AS by_ FROM o""")
def _(v):
    d = SC.with_georeference(v.dets, v.scenes, "scene")
    ox, oy = G.to_downsampled("cx", "cy", F.lit(168), F.lit(168))
    d = d.withColumns({"ox": ox, "oy": oy})
    bx, by = G.from_downsampled("ox", "oy", F.lit(168), F.lit(168))
    return d.select("det_id", F.round("ox", 6).alias("ox"), F.round("oy", 6).alias("oy"),
                    F.round(bx, 6).alias("bx"), F.round(by, 6).alias("by_"))


@query("g8_polygon_measures", """
SELECT det_id, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h AS y2,
 round((cx * 3 + w / 2 - w / 2) / 3, 6) AS mx, round((cy - h / 2 + cy - h / 2 + cy + h) / 3, 6) AS my FROM v_dets""")
def _(v):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    tri = F.array(p(cx - w / 2, cy - h / 2), p(cx + w / 2, cy - h / 2), p(cx, cy + h))
    d = v.dets.withColumn("poly", tri)
    b, m = G.polygon_box("poly"), G.polygon_centroid("poly")
    return d.select("det_id", b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"),
                    F.round(m["x"], 6).alias("mx"), F.round(m["y"], 6).alias("my"))


@query("g9_box_iou", """
WITH x AS (SELECT det_id, w, h, greatest(0, w - abs(w - h)) AS iw, greatest(0, h - h / 4) AS ih FROM v_dets)
SELECT det_id, round(CASE WHEN iw * ih > 0 THEN iw * ih / (2 * w * h - iw * ih) ELSE 0 END, 6) AS iou FROM x""")
def _(v):
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    a = {"x1": F.lit(0.0), "y1": F.lit(0.0), "x2": w, "y2": h}
    s = F.abs(w - h)
    b = {"x1": s, "y1": h / 4, "x2": s + w, "y2": h / 4 + h}
    return v.dets.select("det_id", F.round(G.box_iou(a, b), 6).alias("iou"))


@query("g15_crop_window", f"""
WITH {DET_BASE}, c AS (SELECT det_id, width, height, greatest(0, least(round_even(cx, 0)::int - 160, greatest(0, width - 321))) AS col0,
  greatest(0, least(round_even(cy, 0)::int - 160, greatest(0, height - 321))) AS row0 FROM base)
SELECT det_id, col0, row0, least(321, width - col0) AS w, least(321, height - row0) AS h FROM c""")
def _(v):
    d = SC.with_georeference(v.dets.drop("w", "h"), v.scenes, "scene")
    return d.select("det_id", G.crop_window("cx", "cy", 321).alias("q")).select("det_id", "q.*")


@query("g23_grid_convergence", f"""
WITH {DET_BASE}, {lonlat_sql('x0 + cx * a', 'y0 + cy * e')}
SELECT det_id, round(CASE WHEN epsg BETWEEN 32601 AND 32760 THEN degrees(atan(tan(radians(lon_ - lon0)) * sin(radians(lat_)))) ELSE 0 END, 6) AS convergence FROM ll""")
def _(v):
    d = G.add_convergence(SC.with_georeference(v.dets, v.scenes, "scene"), "cx", "cy", "convergence")
    return d.select("det_id", F.round("convergence", 6).alias("convergence"))


GSD = "(CASE WHEN epsg = 4326 THEN (abs(a) * 111320 * cos(radians(y0 + (round_even(cy_full, 0) + 0.5) * e)) + abs(e) * 111320) / 2 ELSE (abs(a) + abs(e)) / 2 END)"
ERR = "round(CASE WHEN {v} > 0 THEN greatest(4.0, 0.5 * greatest(" + GSD + ", 1e-6) * sqrt(2.0::double), 0.06 * {v}) END, 6)"


@query("a12_vessel_report", f"""
WITH base AS (SELECT l.* EXCLUDE (lon, lat), s.epsg, s.a, s.e, s.x0, s.y0,
  CASE WHEN graphic_length_m IS NOT NULL AND graphic_width_m IS NOT NULL THEN graphic_length_m ELSE estimated_length_m END AS lm,
  CASE WHEN graphic_length_m IS NOT NULL AND graphic_width_m IS NOT NULL THEN graphic_width_m ELSE estimated_width_m END AS wm
  FROM v_labels l JOIN v_scenes s ON s.scene = {BASE} WHERE {EXPORT}),
{lonlat_sql(CENTRE[0].format('cx_full'), CENTRE[1].format('cy_full'))}
SELECT id, tci_path, round(lon_, 6) AS lon, round(lat_, 6) AS lat, reviewed_at, label_confidence, round(lm, 6) AS length_m, round(wm, 6) AS width_m, {ERR.format(v='lm')} AS length_error_m,
 {ERR.format(v='wm')} AS width_error_m, graphic_length_m_hull2 AS second_length_m, transhipment_side_by_side AS multiple_vessels FROM ll""")
def _(v):
    from tidemark.operators import labels as LB
    from tidemark.plans.q_eval import rounded

    out = LB.vessel_report(v.labels, v.scenes, max_rows=None)
    return rounded(out.select("id", "tci_path", "lon", "lat", "reviewed_at", "label_confidence", "length_m", "width_m", "length_error_m",
                              "width_error_m", "second_length_m", "multiple_vessels"))
