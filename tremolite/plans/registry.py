"""Registered queries and, beside each, the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL for the tables of ``fixtures``, over the view ``events``.
REPORTS_SQL = """base AS (
  SELECT event_id AS e, user_id AS u, event_type, value, epoch_us(ts) AS us,
    unnest(CASE WHEN event_id % 9 = 0 THEN [0, 1, 2] WHEN event_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS k FROM events
), reports AS (
  SELECT e + 1 + k * 10000000 AS id,
    CASE WHEN k = 1 THEN 'MET' WHEN k = 0 AND e % 10 = 9 THEN 'MANUAL' ELSE 'USGS' END AS source,
    CASE WHEN NOT (k = 0 AND e % 10 = 9) THEN CAST(e + 1 + k * 10000000 AS VARCHAR) END AS source_event_id,
    us + k * ((e * 13) % 75) * 1000000 AS occurred_us,
    CAST(20 + (e * 7919) % 60 + k AS DOUBLE) / 10 AS magnitude, CAST((e * 104729) % 7000 AS DOUBLE) / 10 AS depth_km,
    CAST(4400 + ((u % 12) * 3701) % 6000 + e % 40 + k * ((e * 17) % 70) AS DOUBLE) / 100 AS lon,
    CAST(800 + ((u % 12) * 2903) % 4700 + (e // 40) % 40 AS DOUBLE) / 100 AS lat,
    CASE WHEN e % 13 <> 0 THEN concat('near ', event_type) END AS place,
    CASE e % 4 WHEN 0 THEN 'mb' WHEN 1 THEN 'mww' WHEN 2 THEN 'ml' END AS mag_type,
    CASE WHEN e % 101 = 0 THEN 'red' WHEN e % 101 <= 3 THEN 'orange' WHEN e % 101 <= 9 THEN 'yellow' WHEN e % 101 <= 40 THEN 'green' END AS alert,
    CAST(CASE WHEN e % 97 = 0 THEN 1 ELSE 0 END AS INTEGER) AS tsunami, CASE WHEN e % 7 <> 0 THEN CAST(floor(value) AS INTEGER) END AS sig,
    us + k * ((e * 13) % 75) * 1000000 + 300000000 AS updated_us
  FROM base)"""

DIST_SQL = """2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
    + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"""

PAIRS_SQL = f"""pairs AS (
  SELECT a.id, b.id AS other_id FROM reports a JOIN reports b ON b.occurred_us BETWEEN a.occurred_us - 60000000 AND a.occurred_us + 60000000
  WHERE a.source <> 'MANUAL' AND b.source <> 'MANUAL' AND {DIST_SQL.format(lat1="a.lat", lon1="a.lon", lat2="b.lat", lon2="b.lon")} <= 50000)"""

CATALOG_SQL = f"""{REPORTS_SQL}, {PAIRS_SQL}, clusters AS (SELECT id, min(other_id) AS c FROM pairs GROUP BY id), catalog AS (
  SELECT r.*, coalesce(c.c, r.id) AS cluster_id, r.source = 'MANUAL' OR row_number() OVER (PARTITION BY coalesce(c.c, r.id), r.source = 'MANUAL'
    ORDER BY CASE r.source WHEN 'MET' THEN 1 WHEN 'USGS' THEN 2 ELSE 3 END, r.id) = 1 AS is_canonical
  FROM reports r LEFT JOIN clusters c USING (id))"""

CELLS_SQL = """cells AS (
  SELECT r AS row, c AS col, 44.0::DOUBLE + (c + 0.5::DOUBLE) * 0.1::DOUBLE AS lon, 56.0::DOUBLE - (r + 0.5::DOUBLE) * 0.1::DOUBLE AS lat,
    CASE WHEN (r + c) % 23 = 0 THEN 760.0 ELSE 180 + (r * 31 + c * 17) % 900 END::DOUBLE AS vs30,
    CASE WHEN (r + c) % 23 = 0 THEN -9999.0 ELSE 180 + (r * 31 + c * 17) % 900 END::DOUBLE AS raw
  FROM (SELECT CAST(range AS INTEGER) AS r FROM range(480)), (SELECT CAST(range AS INTEGER) AS c FROM range(610)))"""

PGA_SQL = """1.385 * 980 * pow(10, 0.49 + 0.23 * (magnitude - 6) - log10({r}) - 0.0027 * {r}) * pow(10, 1.35 - 0.47 * log10({vs30}))"""
MMI_SQL = """least(10.0, greatest(1.0, CASE WHEN 2.20 * log10(greatest({p}, 1e-6)) + 1.00 <= 5 THEN 2.20 * log10(greatest({p}, 1e-6)) + 1.00
    ELSE 3.66 * log10(greatest({p}, 1e-6)) - 1.66 END))"""

#: The three strongest canonical events, and their surfaces of intensity 2 and more.
STRONG_SQL = "strong AS (SELECT * FROM catalog WHERE is_canonical ORDER BY magnitude DESC, depth_km, id LIMIT 3)"
SURFACE_SQL = f"""{CATALOG_SQL}, {CELLS_SQL}, {STRONG_SQL}, near AS (
  SELECT s.id AS event_id, s.magnitude, c.row, c.col, c.lon, c.lat, c.vs30,
    greatest(1e-6, sqrt(pow({DIST_SQL.format(lat1="s.lat", lon1="s.lon", lat2="c.lat", lon2="c.lon")}, 2) + pow(s.depth_km * 1000, 2)) / 1000) AS r FROM strong s, cells c
), shaken AS (SELECT *, {PGA_SQL.format(r="r", vs30="vs30")} AS pga FROM near), surface AS MATERIALIZED (
  SELECT event_id, row, col, lon, lat, pga, {MMI_SQL.format(p="pga")} AS mmi FROM shaken WHERE {MMI_SQL.format(p="pga")} >= 2)"""

BANDS_SQL = f"""{SURFACE_SQL}, tops AS (SELECT event_id, max(mmi) AS top FROM surface GROUP BY event_id), bands AS (
  SELECT s.*, (SELECT max(l) FROM (SELECT unnest(range(2, 11)) AS l) WHERE l <= s.mmi AND l < t.top)::INTEGER AS mmi_lower FROM surface s JOIN tops t USING (event_id))"""

#: The same for every canonical event: rows and columns of cells within reach are listed, not tested.
EVERY_STRONG_SQL = "strong AS MATERIALIZED (SELECT * FROM catalog WHERE is_canonical)"
EVERY_NEAR_SQL = f"""reach AS (
  SELECT *, list_min(list_transform(range(56), lambda n: greatest(pow(1.15, n), (c - n * log10(1.15)) / 0.0027))) AS far
  FROM (SELECT *, (magnitude - 6) * 0.23 + 0.49 + log10(1.385 * 980) + 1.35 - 0.47 * log10(180) - 1 / 2.2 AS c FROM strong)
), box AS (
  SELECT *, km / 110.5 AS dlat, km / (greatest(cos(radians(least(abs(lat) + km / 110.5, 89))), 0.02) * 110.5) AS dlon
  FROM (SELECT *, sqrt(far * far - depth_km * depth_km) AS km FROM reach WHERE far >= depth_km)
), lines AS (
  SELECT *, unnest(range(greatest(0, CAST(floor((56 - lat - dlat) / 0.1) AS BIGINT)), least(480, CAST(ceil((56 - lat + dlat) / 0.1) AS BIGINT)))) AS row FROM box
), near AS (
  SELECT s.id AS event_id, s.magnitude, c.row, c.col, c.lon, c.lat, c.vs30,
    greatest(1e-6, sqrt(pow({DIST_SQL.format(lat1="s.lat", lon1="s.lon", lat2="c.lat", lon2="c.lon")}, 2) + pow(s.depth_km * 1000, 2)) / 1000) AS r
  FROM (SELECT *, unnest(range(greatest(0, CAST(floor((lon - dlon - 44) / 0.1) AS BIGINT)), least(610, CAST(ceil((lon + dlon - 44) / 0.1) AS BIGINT)))) AS col FROM lines) s
  JOIN cells c ON c.row = s.row AND c.col = s.col"""


def every_event(sql: str) -> str:
    """``sql`` over the surfaces of the strongest events, over those of every canonical event."""
    out = sql.replace(STRONG_SQL, EVERY_STRONG_SQL)
    a, b = out.index("near AS ("), out.index("), shaken AS")
    return out[:a] + EVERY_NEAR_SQL + out[b:]


#: The edges of ``fixtures.footprint_edges``.
FOOTPRINTS_SQL = f"""{REPORTS_SQL}, feet AS (
  SELECT id AS unit_id, lon AS l, lat AS b, lon + (id % 7 * 0.1::DOUBLE + 0.13::DOUBLE) AS r, lat + (id % 5 * 0.1::DOUBLE + 0.17::DOUBLE) AS t,
    lon + (id % 7 * 0.1::DOUBLE + 0.13::DOUBLE) / 2 AS m, lat + (id % 5 * 0.1::DOUBLE + 0.17::DOUBLE) / 4 AS q FROM reports
), edges AS (SELECT unit_id, unnest([{{'x1': l, 'y1': b, 'x2': r, 'y2': b}}, {{'x1': r, 'y1': b, 'x2': r, 'y2': q}}, {{'x1': r, 'y1': q, 'x2': m, 'y2': q}},
  {{'x1': m, 'y1': q, 'x2': m, 'y2': t}}, {{'x1': m, 'y1': t, 'x2': l, 'y2': t}}, {{'x1': l, 'y1': t, 'x2': l, 'y2': b}}], recursive := true) FROM feet)"""


def units_sql(levels: tuple[str, ...] = ("province", "district")) -> str:
    tiles = {"province": (0, 6, 4, "CAST(NULL AS VARCHAR)"), "district": (100000, 24, 16, "concat('province ', (i % 24) // 4, '-', (i // 24) // 4)"), "tehsil": (200000, 96, 64, "concat('district ', (i % 96) // 4, '-', (i // 96) // 4)")}
    parts = [
        f"SELECT {base} + i AS unit_id, '{level}' AS level, concat('{level} ', i % {nx}, '-', i // {nx}) AS name, {parent} AS parent, 44 + (i % {nx}) * 61.0::DOUBLE / {nx} AS minx, "
        f"8 + (i // {nx}) * 48.0::DOUBLE / {ny} AS miny, 44 + (i % {nx} + 1) * 61.0::DOUBLE / {nx} AS maxx, 8 + (i // {nx} + 1) * 48.0::DOUBLE / {ny} AS maxy FROM (SELECT range AS i FROM range({nx * ny}))"
        for level, (base, nx, ny, parent) in tiles.items() if level in levels
    ]
    return "units AS (" + " UNION ALL ".join(parts) + ")"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
