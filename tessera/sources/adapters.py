"""The domain's tables, derived from the star schema of the test data.

Each is one SQL statement that Spark and DuckDB both run, so a query and the
SQL it is held against start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

ADAPTERS = {
    "hotspots": """SELECT s_suppkey AS hotspot_id, s_name AS name,
  37.43 + CAST((s_suppkey * 7919) % 1000 AS DOUBLE) * 0.00027 AS lat,
  126.80 + CAST((s_suppkey * 104729) % 1000 AS DOUBLE) * 0.00036 AS lng,
  s_suppkey % 10 <> 9 AS is_polled FROM supplier""",
    "cafes": """SELECT c_custkey AS cafe_id, c_name AS name,
  37.43 + CAST((c_custkey * 6997) % 1000 AS DOUBLE) * 0.00027 AS lat,
  126.80 + CAST((c_custkey * 15485863) % 1000 AS DOUBLE) * 0.00036 AS lng,
  c_custkey % 20 <> 0 AS active, c_mktsegment AS origin_provider,
  CAST(c_custkey % 101 AS DOUBLE) / 100 AS source_confidence FROM customer""",
    "snapshots": """SELECT e.user_id % n.k AS hotspot_id, e.event_id, e.ts AS observed_at,
  e.ts + INTERVAL 30 MINUTE AS fetched_at,
  CAST(1 + CAST(floor(e.value) AS BIGINT) % 4 AS INT) AS level,
  CAST(floor(e.value * 100) AS INT) AS ppltn_min, CAST(floor(e.value * 100) AS INT) + 500 AS ppltn_max
  FROM events e CROSS JOIN (SELECT count(*) AS k FROM supplier) n""",
    "od_flows": """SELECT c.c_nationkey AS origin_id, s.s_nationkey AS destination_id,
  CAST(l_orderkey % 24 AS INT) AS departure_hour, CAST((l_orderkey + l_linenumber) % 24 AS INT) AS arrival_hour,
  CAST(1 + l_partkey % 7 AS INT) AS purpose, CAST(l_quantity AS DOUBLE) AS flow
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer c ON c.c_custkey = o_custkey JOIN supplier s ON s.s_suppkey = l_suppkey""",
    "dated_flows": """SELECT CASE l_partkey % 5 WHEN 0 THEN DATE '2024-01-02' WHEN 1 THEN DATE '2024-01-09' WHEN 2 THEN DATE '2024-01-16'
    WHEN 3 THEN DATE '2024-01-23' ELSE DATE '2024-01-27' END AS observed_date, c.c_nationkey AS origin_id, s.s_nationkey AS destination_id,
  CAST(CASE l_orderkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 14 ELSE 18 END AS INT) AS departure_hour,
  CAST(CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN 8 WHEN 1 THEN 14 ELSE 18 END AS INT) AS arrival_hour,
  CAST(1 + (l_partkey + l_linenumber) % 7 AS INT) AS purpose, CAST(l_quantity AS DOUBLE) AS flow
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer c ON c.c_custkey = o_custkey JOIN supplier s ON s.s_suppkey = l_suppkey""",
    "cell_stock": """SELECT observed_date, zone_id, cell_id, hour, (zone_id * 31 + cell_id * 7 + hour) % 11 = 0 AS masked,
  CASE WHEN (zone_id * 31 + cell_id * 7 + hour) % 11 = 0 THEN NULL ELSE sum(quantity) END AS population
  FROM (SELECT observed_date, zone_id, cell_id, quantity, CAST(CASE WHEN i < 3 THEN 7 + i WHEN i < 6 THEN 10 + i ELSE 11 + i END AS INT) AS hour
    FROM (SELECT CASE l_partkey % 5 WHEN 0 THEN DATE '2024-01-02' WHEN 1 THEN DATE '2024-01-09' WHEN 2 THEN DATE '2024-01-16'
    WHEN 3 THEN DATE '2024-01-23' ELSE DATE '2024-01-27' END AS observed_date, CAST(l_orderkey % 25 AS INT) AS zone_id, CAST((l_orderkey + l_suppkey % 4) % 25 AS INT) AS cell_id,
      (CAST(floor(l_orderkey / 25) AS BIGINT) + l_linenumber) % 9 AS i, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem) h) r
  GROUP BY observed_date, zone_id, cell_id, hour""",
    "od_centroids": """SELECT n_nationkey AS zone_id, n_name AS name,
  37.43 + CAST((n_nationkey * 7) % 25 AS DOUBLE) * 0.011 AS lat,
  126.80 + CAST((n_nationkey * 11) % 25 AS DOUBLE) * 0.015 AS lng FROM nation WHERE n_nationkey % 12 <> 11""",
    "cell_fragments": """SELECT CAST(o_custkey % 5 AS INT) AS cell_id, CAST(o_orderdate AS DATE) AS observed_date,
  CAST(o_orderkey % 4 AS INT) AS hour, o_orderkey AS fragment_id, o_orderpriority = '5-LOW' AS masked,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_totalprice AS DECIMAL(38,5)) END AS known_value FROM orders""",
    "catalogue_a": """SELECT c_custkey AS place_id, lower(c_name) AS norm_name,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('02', CAST(10000000 + c_custkey % 997 AS VARCHAR(20))) END AS phone,
  37.43 + CAST((c_custkey * 6997) % 1000 AS DOUBLE) * 0.00027 AS lat,
  126.80 + CAST((c_custkey * 15485863) % 1000 AS DOUBLE) * 0.00036 AS lng FROM customer""",
    "catalogue_b": """SELECT c_custkey + 1000000 AS place_id,
  CASE WHEN c_custkey % 5 = 0 THEN concat(lower(c_name), 'x') ELSE lower(c_name) END AS norm_name,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('02', CAST(10000000 + c_custkey % 997 AS VARCHAR(20))) END AS phone,
  37.43 + CAST((c_custkey * 6997) % 1000 AS DOUBLE) * 0.00027 + CAST(c_custkey % 9 AS DOUBLE) * 0.0001 AS lat,
  126.80 + CAST((c_custkey * 15485863) % 1000 AS DOUBLE) * 0.00036 AS lng FROM customer WHERE c_custkey % 3 <> 2
  UNION ALL SELECT c_custkey + 2000000, lower(c_name), NULL,
  37.43 + CAST((c_custkey * 6997) % 1000 AS DOUBLE) * 0.00027 + 0.0002,
  126.80 + CAST((c_custkey * 15485863) % 1000 AS DOUBLE) * 0.00036 FROM customer WHERE c_custkey % 17 = 0""",
    "cycles": """SELECT min(event_id) AS cycle_id, min(ts) AS started_at, max(ts) AS completed_at, count(*) AS targets,
  CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS BIGINT) AS saved,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM events GROUP BY date_trunc('hour', ts)""",
    "truths": """SELECT o_custkey AS cafe_id, t.ts AS observed_at, concat('slot', CAST(o_orderkey % 6 AS VARCHAR(10))) AS slot,
  CAST(1 + CAST(floor(o_orderkey / 50) AS BIGINT) % 4 AS INT) AS observed_area_level,
  CAST(1 + (CAST(floor(o_orderkey / 50) AS BIGINT) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 4 AS INT) AS reliability_level
  FROM orders o JOIN events t ON t.event_id = o.o_orderkey WHERE o_orderkey % 50 = 0""",
    "transit_stops": """SELECT c_custkey AS stop_id, concat(CASE WHEN c_custkey % 4 = 1 THEN 'S ' ELSE 's' END, CAST(c_custkey % 300 AS VARCHAR(9)), CASE WHEN c_custkey % 4 = 2 THEN '역' ELSE '' END) AS name,
  concat('line', CAST(c_custkey % 6 AS VARCHAR(9))) AS line,
  37.5 + CAST(c_custkey % 300 AS DOUBLE) * 0.0003 + CAST(c_custkey % 7 AS DOUBLE) * 0.0012 + CAST(CAST(floor(c_custkey / 300) AS BIGINT) % 2 AS DOUBLE) * 0.02 AS lat,
  CAST(127 AS DOUBLE) AS lng FROM customer""",
    "transit_exits": """SELECT c_custkey AS exit_id, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'A' ELSE CAST(1 + c_custkey % 9 AS VARCHAR(9)) END AS ref,
  concat('s', CAST(c_custkey % 300 AS VARCHAR(9)), '역', CASE WHEN c_custkey % 3 = 0 THEN concat(' ', CAST(1 + c_custkey % 4 AS VARCHAR(9)), '번 출구') ELSE '' END) AS label,
  37.5 + CAST(c_custkey % 300 AS DOUBLE) * 0.0003 + CAST(c_custkey % 11 AS DOUBLE) * 0.001 AS lat, CAST(127 AS DOUBLE) AS lng FROM customer""",
    "track_ways": """SELECT way_id, grp % 3 AS line_id, grp, a, b,
  CAST(126 AS DOUBLE) + CAST(grp AS DOUBLE) / 1024 AS lng, CAST(37 AS DOUBLE) + CAST(a AS DOUBLE) / 64 AS lat_a, CAST(37 AS DOUBLE) + CAST(b AS DOUBLE) / 64 AS lat_b, way_id % 2 = 1 AS turned FROM (
  SELECT c_custkey AS way_id, grp, CASE WHEN kind = 3 AND i = 11 THEN 10 WHEN kind = 2 AND i >= 8 THEN 4 ELSE i END AS a,
    CASE WHEN kind = 3 AND i = 11 THEN 11 WHEN kind = 3 AND i = 5 THEN NULL WHEN kind = 1 THEN (i + 1) % 12 WHEN kind = 2 AND i >= 8 THEN 20 + i ELSE i + 1 END AS b
  FROM (SELECT c_custkey, CAST(floor(c_custkey / 12) AS BIGINT) AS grp, c_custkey % 12 AS i, CAST(floor(c_custkey / 12) AS BIGINT) % 4 AS kind FROM customer) k) e""",
    "permit_places": """SELECT c_custkey + extra AS permit_id, c_custkey AS k, c_custkey % 400 AS building, concat('Cafe ', CAST(c_custkey AS VARCHAR(20))) AS name,
  concat('서울특별시 ', CASE WHEN c_custkey % 400 % 3 = 0 THEN '강남구 테헤란로 ' WHEN c_custkey % 400 % 3 = 1 THEN '중구 세종대로 ' ELSE '마포구 월드컵로12길 ' END, CAST(1 + c_custkey % 400 AS VARCHAR(20)),
    CASE WHEN c_custkey % 4 = 0 THEN '-2' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN ', 2층' ELSE ' (가동)' END) AS address,
  concat('02-', CAST(1000000 + c_custkey % 997 AS VARCHAR(20))) AS phone, 37.5 + CAST(c_custkey % 400 AS DOUBLE) * 0.001 + CAST(c_custkey % 5 AS DOUBLE) * 0.00005 AS lat, CAST(127 AS DOUBLE) AS lng,
  CAST(20 + c_custkey % 90 AS DOUBLE) AS area
  FROM customer CROSS JOIN (SELECT 0 AS extra UNION ALL SELECT 1000000 AS extra) x WHERE extra = 0 OR c_custkey % 13 = 0""",
    "cafe_places": """SELECT c_custkey + extra AS cafe_id, c_custkey AS k, c_custkey % 400 AS building, c_custkey % 7 <> 3 AS placed, CASE WHEN c_custkey % 19 = 0 THEN 'permit' ELSE c_mktsegment END AS origin_provider,
  CASE WHEN c_custkey % 5 = 0 THEN 'Other' ELSE concat('CAFE  ', CAST(c_custkey AS VARCHAR(20))) END AS name,
  concat(CASE WHEN c_custkey % 7 = 3 THEN '부산시 ' WHEN c_custkey % 2 = 0 THEN '서울시 ' ELSE '서울특별시 ' END, CASE WHEN c_custkey % 400 % 3 = 0 THEN '강남구 테헤란로 ' WHEN c_custkey % 400 % 3 = 1 THEN '중구 세종대로 ' ELSE '마포구 월드컵로12길 ' END, CAST(1 + c_custkey % 400 AS VARCHAR(20)),
    CASE WHEN c_custkey % 4 = 0 THEN '-2' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN ', 2층' ELSE ' 지하1층' END) AS address,
  CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN concat('02) ', CAST(1000000 + c_custkey % 997 AS VARCHAR(20))) ELSE 'ask at the desk' END AS phone,
  37.5 + CAST(c_custkey % 400 AS DOUBLE) * 0.001 + CAST(c_custkey % 9 AS DOUBLE) * 0.0001 AS lat, CAST(127 AS DOUBLE) AS lng
  FROM customer CROSS JOIN (SELECT 0 AS extra UNION ALL SELECT 1000000 AS extra) x WHERE extra = 0 OR c_custkey % 17 = 0""",
    "population_rows": """SELECT replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), '-', '') AS date_raw, lpad(CAST(o_orderkey % 4 AS VARCHAR(2)), 2, '0') AS hour_raw,
  CAST(11000000 + o_custkey % 3 AS VARCHAR(8)) AS administrative_dong_code, concat('다사', lpad(CAST(25 * (o_custkey % 20) AS VARCHAR(4)), 4, '0'), '0025') AS cell_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN '*' ELSE CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR(30)) END AS total_raw, concat('file', CAST(o_orderkey % 3 AS VARCHAR(2)), '.csv') AS source_file FROM orders""",
    "moves_of_day": """SELECT observed_date, origin_id, destination_id, departure_hour, arrival_hour, purpose, flow,
  CAST(500 + (origin_id * 37 + destination_id * 11) % 900 AS DOUBLE) AS distance_m, CAST(5 + (origin_id + 2 * destination_id) % 40 AS DOUBLE) AS duration_min FROM dated_flows WHERE observed_date = DATE '2024-01-09'""",
    "cycle_states": """SELECT c.cycle_id, c.started_at, CASE WHEN c.started_at = m.newest THEN NULL WHEN c.cycle_id % 23 = 0 THEN c.started_at - INTERVAL 1 MINUTE ELSE c.completed_at END AS completed_at, c.targets, c.saved, c.failed,
  CASE WHEN c.started_at = m.newest THEN 'running' WHEN c.failed = 0 THEN 'complete' WHEN c.saved > 0 THEN 'partial' ELSE 'failed' END AS status FROM cycles c CROSS JOIN (SELECT max(started_at) AS newest FROM cycles) m""",
    "viewports": """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN CAST(179.9 AS DOUBLE) ELSE 126.5 + CAST(c_custkey % 97 AS DOUBLE) / 128 END AS west,
  CASE WHEN c_custkey % 10 = 0 THEN CAST(-179.9 AS DOUBLE) WHEN c_custkey % 50 = 1 THEN CAST(490 AS DOUBLE) ELSE 126.5 + CAST(c_custkey % 97 AS DOUBLE) / 128 + CAST(1 + c_custkey % 13 AS DOUBLE) / 64 END AS east,
  CASE WHEN c_custkey % 31 = 0 THEN CAST(-89 AS DOUBLE) ELSE 37 + CAST(c_custkey % 89 AS DOUBLE) / 128 END AS south, 37 + CAST(c_custkey % 89 AS DOUBLE) / 128 + CAST(1 + c_custkey % 11 AS DOUBLE) / 64 AS north,
  CAST(8 + c_custkey % 10 AS DOUBLE) + 0.5 AS zoom FROM customer""",
}


def needed(text: str, names: dict[str, str]) -> list[str]:
    """Names that occur in text or in what they stand for, in the order in which they are defined."""
    found: set[str] = set()
    for n in reversed(names):  # later ones are made of earlier ones
        if re.search(rf"\b{n}\b", text) or any(re.search(rf"\b{n}\b", names[m]) for m in found):
            found.add(n)
    return [n for n in names if n in found]


def with_adapters(body: str) -> str:
    """body, a SELECT or one with its own CTEs, after the tables that it names."""
    ctes = [f"{n} AS ({ADAPTERS[n]})" for n in needed(body, ADAPTERS)]
    if not ctes:
        return body
    own = re.match(r"\s*WITH(\s+RECURSIVE)?\s+", body, re.IGNORECASE)
    if not own:
        return f"WITH {', '.join(ctes)} {body}"
    return f"WITH{own[1] or ''} {', '.join(ctes)}, {body[own.end() :]}"


def run_sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A statement over adapters and base tables, which are read from sf_dir."""
    text = with_adapters(body)
    ctes = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in BASE if re.search(rf"\b{t}\b", text)]
    if not ctes:
        return spark.sql(text)
    rest = text[5:] if text[:5].upper() == "WITH " else None
    return spark.sql(f"WITH {', '.join(ctes)}, {rest}" if rest else f"WITH {', '.join(ctes)} {text}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter or a base table."""
    if name in ADAPTERS:
        return run_sql(spark, sf_dir, f"SELECT * FROM {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
