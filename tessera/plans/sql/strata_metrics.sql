WITH
s AS (SELECT hotspot_id, event_id, observed_at, level, (ppltn_min + ppltn_max) / CAST(2 AS DOUBLE) AS pop FROM snapshots),
m AS (
  SELECT s.hotspot_id, s.observed_at + INTERVAL 60 MINUTE AS target, s.level, s.pop, a.level AS a_level, a.pop AS a_pop,
    row_number() OVER (PARTITION BY s.event_id ORDER BY abs(epoch_us(a.observed_at) - epoch_us(s.observed_at) - CAST(3600000000 AS BIGINT)), a.observed_at) AS rn
  FROM s JOIN s a ON a.hotspot_id = s.hotspot_id AND abs(epoch_us(a.observed_at) - epoch_us(s.observed_at) - CAST(3600000000 AS BIGINT)) <= 150000000),
p AS (SELECT CAST(hotspot_id % 4 AS INT) AS part, CAST(target AS DATE) AS day, * FROM m WHERE rn = 1)
SELECT concat_ws('+', CASE WHEN grouping(part) = 0 THEN 'part' END, CASE WHEN grouping(day) = 0 THEN 'day' END) AS stratum, part, day, count(*) AS n, round(avg(abs(pop - a_pop)), 6) AS mae,
  round(CASE WHEN sum(a_pop) > 0 THEN sum(abs(pop - a_pop)) / sum(a_pop) END, 6) AS wape, round(avg(pop - a_pop), 6) AS bias, round(avg(CASE WHEN level = a_level THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS exact,
  round(avg(CASE WHEN abs(level - a_level) <= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS adjacent
FROM p GROUP BY GROUPING SETS ((), (part), (day), (part, day))
