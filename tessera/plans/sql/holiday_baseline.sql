WITH
h AS (
  SELECT cell_id, CAST(observed_date AS DATE) AS day, hour, bool_and(masked) AS masked, CAST(sum(known_value) AS DOUBLE) AS value FROM cell_fragments
  WHERE date_diff('day', CAST(observed_date AS DATE), DATE '1995-05-05') BETWEEN 1 AND 1095 GROUP BY 1, 2, 3),
r AS (
  SELECT cell_id, hour, masked, ln(1 + CASE WHEN masked THEN 2 ELSE value END) AS x, exp(-ln(2) * date_diff('day', day, DATE '1995-05-05') / 365) AS w, isodow(day) AS wd,
    CASE WHEN day IN (DATE '1995-05-06', DATE '1995-05-07', DATE '1994-10-01', DATE '1994-10-02', DATE '1994-10-03') THEN 'long_holiday'
      WHEN day IN (DATE '1995-03-01', DATE '1994-09-20', DATE '1993-05-05') THEN 'public_holiday' WHEN isodow(day) = 6 THEN 'saturday' WHEN isodow(day) = 7 THEN 'sunday' ELSE 'working_day' END AS kind FROM h),
b AS (
  SELECT *, unnest(['exact', 'type', 'nominal', 'hour']) AS bucket, unnest([wd = 5 AND kind = 'long_holiday', kind = 'long_holiday', wd = 5 AND kind = 'working_day', true]) AS member FROM r),
s AS (
  SELECT cell_id, hour, bucket, count(*) AS n, count(*) FILTER (WHERE masked) AS m, sum(w) AS sw, sum(w * x) / sum(w) AS mean, greatest(0, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)) AS var, sum(w) * sum(w) / sum(w * w) AS neff
  FROM b WHERE member GROUP BY 1, 2, 3),
k AS (
  SELECT h.cell_id, h.hour, CASE WHEN e.n >= 3 THEN 'exact' WHEN t.n >= 3 THEN 'type' WHEN o.n >= 3 THEN 'nominal' ELSE 'hour' END AS bucket FROM s h
  LEFT JOIN s e ON e.cell_id = h.cell_id AND e.hour = h.hour AND e.bucket = 'exact' LEFT JOIN s t ON t.cell_id = h.cell_id AND t.hour = h.hour AND t.bucket = 'type'
  LEFT JOIN s o ON o.cell_id = h.cell_id AND o.hour = h.hour AND o.bucket = 'nominal' WHERE h.bucket = 'hour'),
p AS (
  SELECT c.*, q.mean AS pm, q.var AS pv, row_number() OVER (PARTITION BY c.cell_id, c.hour ORDER BY CASE q.bucket WHEN 'type' THEN 1 WHEN 'nominal' THEN 2 WHEN 'hour' THEN 3 END) AS rn
  FROM k JOIN s c ON c.cell_id = k.cell_id AND c.hour = k.hour AND c.bucket = k.bucket
  LEFT JOIN s q ON q.cell_id = c.cell_id AND q.hour = c.hour AND CASE q.bucket WHEN 'exact' THEN 0 WHEN 'type' THEN 1 WHEN 'nominal' THEN 2 ELSE 3 END > CASE c.bucket WHEN 'exact' THEN 0 WHEN 'type' THEN 1 WHEN 'nominal' THEN 2 ELSE 3 END),
f AS (SELECT *, CASE WHEN pm IS NULL THEN 1 ELSE neff / (neff + 4) END AS a FROM p WHERE rn = 1)
SELECT cell_id, hour, bucket, n AS raw_n, round(neff, 6) AS effective_n, round(exp(a * mean + (1 - a) * coalesce(pm, 0)) - 1, 3) AS expected,
  round(sqrt(a * var + (1 - a) * coalesce(pv, 0) + a * (1 - a) * pow(mean - coalesce(pm, mean), 2)), 6) AS dispersion, round(m / n, 9) AS masked_share, CAST(CASE bucket WHEN 'exact' THEN 0 WHEN 'type' THEN 1 WHEN 'nominal' THEN 2 ELSE 3 END AS INT) AS fallback_depth FROM f
