"""Common table expressions of the oracle SQL, in DuckDB's dialect, matching ``stratacube.sources.views``."""

from __future__ import annotations


def r(e: str) -> str:
    """Six decimals, as ``functions.columns.rounded``; the small shift keeps exact ties from falling either way."""
    return f"round_even(({e}) * 1e6 + 1e-4, 0) / 1e6"


GRID = """grid AS (
  SELECT CAST(s_nationkey % 5 AS INT) AS ilon, CAST(FLOOR(s_nationkey / 5) AS INT) AS ilat, CAST(72 * (s_nationkey % 5) AS DOUBLE) AS lon,
         CAST(60 - 30 * FLOOR(s_nationkey / 5) AS DOUBLE) AS lat, CAST(l_shipdate AS DATE) AS time,
         CAST(273.15 AS DOUBLE) + MAX(l_extendedprice) / 2500 AS t2mmax, CAST(273.15 AS DOUBLE) + AVG(l_extendedprice) / 2500 AS t2m,
         CAST(273.15 AS DOUBLE) + MIN(l_extendedprice) / 2500 AS t2mmin, SUM(l_quantity) / 10000 AS tp, 0 - AVG(l_extendedprice) / 10000 AS pet, COUNT(*) AS n_obs
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, CAST(l_shipdate AS DATE))"""
MASK = """mask AS (
  SELECT CAST(n_nationkey % 5 AS INT) AS ilon, CAST(FLOOR(n_nationkey / 5) AS INT) AS ilat, CAST(n_nationkey % 4 AS DOUBLE) / 3 AS lsm,
         CASE WHEN n_nationkey <> 24 THEN n_regionkey + 1 END AS cont FROM nation)"""
CELL = "PARTITION BY ilon, ilat ORDER BY time"
PEI = f"""{GRID}, wb AS (SELECT *, tp * 1000 + pet AS wb FROM grid), pei AS (
  SELECT *, AVG(wb) OVER ({CELL} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS pei_30, AVG(wb) OVER ({CELL} ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS pei_90,
         AVG(wb) OVER ({CELL} ROWS BETWEEN 179 PRECEDING AND CURRENT ROW) AS pei_180 FROM wb)"""
RANKS = f"""{PEI}, ranks AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY ilon, ilat ORDER BY ROUND(0 - t2mmax, 9), time) / CAST(COUNT(*) OVER (PARTITION BY ilon, ilat) AS DOUBLE) AS rt,
         ROW_NUMBER() OVER (PARTITION BY ilon, ilat ORDER BY ROUND(pei_30, 9), time) / CAST(COUNT(*) OVER (PARTITION BY ilon, ilat) AS DOUBLE) AS rd30,
         ROW_NUMBER() OVER (PARTITION BY ilon, ilat ORDER BY ROUND(pei_90, 9), time) / CAST(COUNT(*) OVER (PARTITION BY ilon, ilat) AS DOUBLE) AS rd90,
         ROW_NUMBER() OVER (PARTITION BY ilon, ilat ORDER BY ROUND(pei_180, 9), time) / CAST(COUNT(*) OVER (PARTITION BY ilon, ilat) AS DOUBLE) AS rd180 FROM pei)"""


def coded(t: float = 0.1, ne: float = 0.1) -> str:
    names = ("rt", "rd30", "rd90", "rd180")
    bits = " | ".join(f"CASE WHEN {n} < {t} THEN {1 << i} ELSE 0 END" for i, n in enumerate(names))
    inside = " AND ".join(f"{n} > {ne} AND {n} < 1 - {ne}" for n in names)
    return f"{RANKS}, event AS (SELECT *, ({bits} | CASE WHEN {inside} THEN 16 ELSE 0 END) AS event FROM ranks)"


EVENT = coded()
RUNS = f"""{RANKS}, dry AS (SELECT ilon, ilat, lon, lat, time, t2mmax, pei_30 FROM ranks WHERE rd30 < 0.3),
  period AS (SELECT MIN(CAST(l_shipdate AS DATE)) AS first, MAX(CAST(l_shipdate AS DATE)) AS last FROM lineitem),
  island AS (SELECT *, time - CAST(ROW_NUMBER() OVER ({CELL}) AS INT) AS g FROM dry),
  runs AS (SELECT ilon, ilat, g, MIN(time) AS t0, MAX(time) AS t1, COUNT(*) AS n FROM island GROUP BY ilon, ilat, g),
  kept AS (SELECT runs.* FROM runs, period WHERE n >= 4 OR t0 = first OR t1 = last)"""


def components(wrap: bool) -> str:
    east = "(a.ilon + 1) % 5" if wrap else "a.ilon + 1"
    return f"""{RUNS}, node AS (SELECT ilon, ilat, t0, t1, (CAST(t0 - DATE '1970-01-01' AS BIGINT) * 5 + ilat) * 5 + ilon AS id FROM kept),
      link AS (SELECT a.id AS x, b.id AS y FROM node a JOIN node b ON a.t0 <= b.t1 AND b.t0 <= a.t1 AND ((b.ilon = {east} AND b.ilat = a.ilat) OR (b.ilon = a.ilon AND b.ilat = a.ilat + 1))),
      both_ AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
      reach AS (SELECT id, id AS far FROM node UNION SELECT r.id, b.y FROM reach r JOIN both_ b ON r.far = b.x),
      root AS (SELECT id, MIN(far) AS root FROM reach GROUP BY id),
      label AS (SELECT id, DENSE_RANK() OVER (ORDER BY root) AS label FROM root),
      voxel AS (SELECT d.ilon, d.ilat, d.lon, d.lat, d.time, d.t2mmax, d.pei_30, l.label FROM dry d JOIN node n ON d.ilon = n.ilon AND d.ilat = n.ilat AND d.time BETWEEN n.t0 AND n.t1 JOIN label l ON l.id = n.id)"""


HOURLY = """hourly AS (SELECT CAST(user_id % 10 AS INT) AS ilon, 0 AS ilat, date_trunc('hour', ts) AS ts, SUM(value) AS tp, AVG(value) AS t2m, COUNT(*) AS n
  FROM events GROUP BY user_id % 10, date_trunc('hour', ts))"""
ENSEMBLE = """ensemble AS (SELECT event_type || CAST(user_id % 2 AS VARCHAR) AS member, CAST((user_id % 9) % 3 AS INT) AS ilon, CAST(FLOOR((user_id % 9) / 3) AS INT) AS ilat,
  CAST(ts AS DATE) AS time, AVG(value / 10) AS v FROM events GROUP BY ALL)"""
REF = """ref AS (SELECT obs_event, day AS start_, CAST(day + INTERVAL 20 DAY AS DATE) AS end_, (obs_event % 5) * 72.0 - 80.0 AS west, (obs_event % 5) * 72.0 AS east,
    70.0 - FLOOR(obs_event / 5) * 30.0 - 40.0 AS south, 70.0 - FLOOR(obs_event / 5) * 30.0 AS north
  FROM (SELECT c_nationkey AS obs_event, CAST(o_orderdate AS DATE) AS day, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
        FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rn = 1),
  boxes AS (SELECT *, west + 360 AS lon_from, CASE WHEN east < 0 THEN east + 360 ELSE 360.0 END AS lon_to FROM ref WHERE west < 0
    UNION ALL SELECT *, CASE WHEN west < 0 THEN 0.0 ELSE west END, east FROM ref WHERE east >= 0)"""
YEARS = """series AS (SELECT CAST(s_nationkey AS INT) AS cell, CAST(YEAR(l_shipdate) AS INT) AS year, SUM(l_quantity) AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
