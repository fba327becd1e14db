"""Raster-shaped views over the star-schema tables, as SQL that Spark and DuckDB both run.

They give queries and their oracles the same input; {name} stands for another view or table.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "scenes": """SELECT o_orderkey AS scene_id,
  concat('LANDSAT_', CAST(CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 9 END AS VARCHAR(1))) AS spacecraft_id,
  o_orderdate AS time_start, o_totalprice / 5000e0 AS cloud_cover,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 20e0 + o_custkey % 60 END AS sun_elevation,
  CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 2 = 0 THEN 40e0 + o_custkey % 30 ELSE NULL END AS solar_zenith_angle
FROM {orders}""",
    "obs": """SELECT l_orderkey AS scene_id, l_partkey % 200 AS pixel_id,
  7000e0 + 400 * l_quantity AS dn_green, 7000e0 + floor(l_extendedprice / 5) AS dn_red,
  9000e0 + 2400 * round(100 * l_discount) AS dn_nir, 8000e0 + 3200 * round(100 * l_tax) AS dn_swir1,
  CAST(64 + CASE WHEN l_linenumber = 7 THEN 8 ELSE 0 END
          + CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 16 ELSE 0 END
          + CASE WHEN l_suppkey % 13 = 0 THEN 128 ELSE 0 END AS INT) AS qa_pixel
FROM {lineitem}""",
    "raw_obs": """SELECT scene_id, pixel_id, dn_green - 100 AS sr_b1, dn_green AS sr_b2, dn_red AS sr_b3, dn_nir AS sr_b4, dn_swir1 AS sr_b5,
  dn_swir1 + 7 AS sr_b6, dn_swir1 + 11 AS sr_b7, qa_pixel FROM {obs}""",
    "class_map": """SELECT ix, landcover, biome, CASE WHEN biome > 0 THEN 1 ELSE 0 END AS is_veg FROM (VALUES
 (0,11,0),(1,12,0),(2,21,0),(3,22,0),(4,23,0),(5,24,0),(6,31,0),(7,41,1),(8,42,2),(9,43,3),
 (10,51,0),(11,52,4),(12,71,5),(13,72,0),(14,73,0),(15,74,0),(16,81,5),(17,82,6),(18,90,7),(19,95,8)) AS t(ix, landcover, biome)""",
    "pixels": """SELECT p.p_partkey AS pixel_id, CAST(floor(p.p_partkey / 20) AS INT) AS grid_row, CAST(p.p_partkey % 20 AS INT) AS grid_col,
  CAST(p.p_partkey % 25 AS INT) AS state_key, c.landcover, c.biome, c.is_veg
FROM {part} p JOIN {class_map} c ON p.p_size % 20 = c.ix WHERE p.p_partkey < 200""",
    "region_states": """SELECT 'ALL' AS region, n_nationkey AS state_key FROM {nation}
UNION ALL SELECT r_name, n_nationkey FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "hull": """SELECT a.i * 1000 + b.i * 100 + c.i * 10 + d.i AS hull_index, CASE WHEN (a.i + b.i + c.i + d.i) % 7 = 0 THEN 0 ELSE 1 END AS in_hull
FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS a(i) CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS b(i)
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS c(i) CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS d(i)""",
    "tiles": """SELECT n.n_name AS tile, l_partkey % 200 AS pixel_id, CAST(sum(l_quantity) AS BIGINT) % 801 AS raw
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} n ON s_nationkey = n_nationkey
WHERE (l_partkey % 200 + 3 * n_nationkey) % 20 < 4 GROUP BY n.n_name, l_partkey % 200""",
    "cover": """SELECT pixel_id, e.epoch, r.release_rank, CASE WHEN (pixel_id + e.epoch + r.release_rank) % 11 = 0 THEN 99 ELSE c.landcover END AS landcover
FROM {pixels} JOIN (VALUES (2001),(2004),(2006),(2008),(2011),(2013),(2016),(2019)) AS e(epoch) ON 1 = 1 JOIN (VALUES (0),(1)) AS r(release_rank)
 ON (pixel_id + e.epoch) % 3 <> r.release_rank JOIN {class_map} c ON (pixel_id + 3 * e.epoch + 7 * r.release_rank) % 20 = c.ix""",
    "footprints": """SELECT o_orderkey AS scene_id, CAST(o_custkey * 37 % 560 AS DOUBLE) AS xmin, CAST(o_orderkey * 13 % 260 AS DOUBLE) AS ymin,
 CAST(o_custkey * 37 % 560 + 10 + o_custkey % 50 + CASE WHEN o_orderkey % 97 = 0 THEN 300 ELSE 0 END AS DOUBLE) AS xmax, CAST(o_orderkey * 13 % 260 + 8 + o_orderkey % 30 AS DOUBLE) AS ymax FROM {orders}""",
    "wanted": """SELECT CASE n_nationkey % 3 WHEN 0 THEN 'LT05' WHEN 1 THEN 'LE07' ELSE 'LC08' END AS sensor, CAST(1995 + n_nationkey % 5 AS INT) AS year, CAST(1 + n_nationkey % 12 AS INT) AS month
 FROM {nation} WHERE n_regionkey = 2""",
    # zone outlines: a lattice of 5 x 5 slanted cells that share their edges; every third zone has a hole, every fourth a part of its own across others
    "outlines": """SELECT n_nationkey AS zone, 0 AS ring, seq, 120e0 * (n_nationkey % 5 + a) + 14e0 * (((n_nationkey % 5 + a) * 3 + (floor(n_nationkey / 5) + b) * 5) % 4) AS x,
 60e0 * (floor(n_nationkey / 5) + b) + 9e0 * (((n_nationkey % 5 + a) * 2 + floor(n_nationkey / 5) + b) % 3) AS y
 FROM {nation} JOIN (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) AS t(seq, a, b) ON 1 = 1
UNION ALL SELECT n_nationkey, 1, seq, 120e0 * (n_nationkey % 5) + a, 60e0 * floor(n_nationkey / 5) + b FROM {nation} JOIN (VALUES (0, 41, 15), (1, 107, 22), (2, 65, 52)) AS t(seq, a, b) ON n_nationkey % 3 = 0
UNION ALL SELECT n_nationkey, 2, seq, 37e0 * (n_nationkey % 11) + a, 11e0 * n_nationkey + b FROM {nation} JOIN (VALUES (0, 0, -40), (1, 75, -33), (2, 75, 10), (3, 0, -40)) AS t(seq, a, b) ON n_nationkey % 4 = 0""",
}

#: The deterministic stand-in for a retrieval: 3 + 9 NDVI. Oracles only; queries compute these by the library's operators.
ORACLE_VIEWS = {
    "edges": """SELECT zone, CASE WHEN y < yn THEN x ELSE xn END AS x1, least(y, yn) AS y1, CASE WHEN y < yn THEN xn ELSE x END AS x2, greatest(y, yn) AS y2
 FROM (SELECT zone, x, y, coalesce(lead(x) OVER (PARTITION BY zone, ring ORDER BY seq), first_value(x) OVER (PARTITION BY zone, ring ORDER BY seq)) AS xn,
 coalesce(lead(y) OVER (PARTITION BY zone, ring ORDER BY seq), first_value(y) OVER (PARTITION BY zone, ring ORDER BY seq)) AS yn FROM {outlines}) WHERE y <> yn""",
    # a point lies in a zone if a ray to its left crosses an odd number of edges
    "zone_cells": """SELECT e.zone, p.pixel_id, p.grid_row, p.grid_col, p.is_veg FROM {pixels} p JOIN {edges} e ON e.y1 <= 300e0 - (p.grid_row + 0.5e0) * 30e0 AND e.y2 > 300e0 - (p.grid_row + 0.5e0) * 30e0
 AND e.x1 + (300e0 - (p.grid_row + 0.5e0) * 30e0 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) <= (p.grid_col + 0.5e0) * 30e0 GROUP BY ALL HAVING count(*) % 2 = 1""",
    "refl": """SELECT o.scene_id, o.pixel_id, s.time_start, s.cloud_cover, o.qa_pixel,
  (o.dn_green * 2.75e-5 - 0.2e0) / 1e-4 AS green, (o.dn_red * 2.75e-5 - 0.2e0) / 1e-4 AS red,
  (o.dn_nir * 2.75e-5 - 0.2e0) / 1e-4 AS nir, (o.dn_swir1 * 2.75e-5 - 0.2e0) / 1e-4 AS swir1,
  coalesce(90e0 - s.sun_elevation, s.solar_zenith_angle, 45e0) AS sun_zenith
FROM {obs} o JOIN {scenes} s ON o.scene_id = s.scene_id
WHERE s.cloud_cover < 50 AND (o.qa_pixel & 152) = 0""",
    "lai": """SELECT r.*, p.biome, 3e0 + 9e0 * (r.nir - r.red) / nullif(r.nir + r.red, 0e0) AS lai_real,
  CASE WHEN r.red >= 0 AND r.red < 5100 AND r.green >= 0 AND r.green < 5100 AND r.nir >= 0 AND r.nir < 7100 AND r.swir1 >= 0 AND r.swir1 < 7100
   THEN CAST(floor(r.red / 5100 * 10) AS INT) * 1000 + CAST(floor(r.green / 5100 * 10) AS INT) * 100
      + CAST(floor(r.nir / 7100 * 10) AS INT) * 10 + CAST(floor(r.swir1 / 7100 * 10) AS INT) END AS hull_index
FROM {refl} r JOIN {pixels} p ON r.pixel_id = p.pixel_id""",
    "lai_qa": """SELECT l.scene_id, l.pixel_id, l.time_start, l.biome, CAST(least(greatest(round(l.lai_real * 100), 0), 65535) AS INT) AS lai,
  (CASE WHEN coalesce(h.in_hull, 0) = 0 THEN 1 ELSE 0 END)
  | (CASE WHEN l.lai_real >= 0 AND l.lai_real <= 8 THEN 0 ELSE 2 END) | (CASE WHEN l.biome = 0 THEN 4 ELSE 0 END) AS qa
FROM {lai} l LEFT JOIN {hull} h ON l.hull_index = h.hull_index WHERE l.lai_real IS NOT NULL""",
    "clear": """SELECT o.pixel_id, CAST(year(s.time_start) AS INT) AS year, CAST(month(s.time_start) AS INT) AS month
FROM {obs} o JOIN {scenes} s ON o.scene_id = s.scene_id WHERE s.cloud_cover < 50 AND (o.qa_pixel & 152) = 0""",
    "months": "SELECT CAST(unnest(range(1, 13)) AS INT) AS month",
    "mean_counts": """SELECT p.pixel_id, p.grid_row, p.grid_col, p.state_key, p.is_veg, m.month, count(c.pixel_id) / 6e0 AS obs_count
FROM {pixels} p CROSS JOIN {months} m LEFT JOIN (SELECT * FROM {clear} WHERE year BETWEEN 1995 AND 2000) c
 ON c.pixel_id = p.pixel_id AND c.month = m.month GROUP BY ALL""",
    "ordered_tiles": """SELECT t.pixel_id, CAST(floor(t.pixel_id / 20) AS INT) AS grid_row, CAST(t.pixel_id % 20 AS INT) AS grid_col, t.raw,
 CAST(dense_rank() OVER (ORDER BY t.tile) - 1 AS INT) AS tile_ordinal FROM {tiles} t""",
    "mosaic": "SELECT grid_row, grid_col, arg_max(raw, tile_ordinal) * 0.01e0 AS value, max(tile_ordinal) AS tile_ordinal FROM {ordered_tiles} WHERE raw <> 0 GROUP BY ALL",
}
_NAME = re.compile(r"\{(\w+)\}")


#: Analysed views by session, folder and name: plans, no data. Tables of a folder are taken not to change within a session.
_MADE: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of `sf_dir`, as a DataFrame; each is analysed once a session."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _MADE:
        if name not in VIEWS:
            _MADE[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            text = VIEWS[name]
            _MADE[key] = spark.sql(text, **{used: view(spark, sf_dir, used) for used in set(_NAME.findall(text))})
    return _MADE[key]


@cache
def _used(text: str) -> tuple[str, ...]:
    """The views that a text needs, each after those it needs itself."""
    known, found = VIEWS | ORACLE_VIEWS, []
    for name in _NAME.findall(text):
        if name in known:
            found += [*_used(known[name]), name]
    return tuple(dict.fromkeys(found))


def oracle(text: str) -> str:
    """A query over {views} as one statement of SQL for DuckDB."""
    known = VIEWS | ORACLE_VIEWS
    plain = lambda t: _NAME.sub(lambda m: f"v_{m[1]}" if m[1] in known else m[1], t)
    parts = [f"v_{name} AS ({plain(known[name])})" for name in _used(text)]
    text = plain(text)
    if parts and text.startswith("WITH "):
        return f"WITH {', '.join(parts)}, {text[5:]}"
    return f"WITH {', '.join(parts)} {text}" if parts else text
