WITH
-- include slo_of
, d AS (
  SELECT *, status <> 'running' AS ended, CASE WHEN status <> 'running' AND completed_at >= started_at THEN (epoch_us(completed_at) - epoch_us(started_at)) / CAST(1000000 AS DOUBLE) END AS seconds FROM mine),
a AS (
  SELECT count(*) AS cycles, count(*) FILTER (WHERE ended) AS terminal, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'failed') AS failed,
    round(count(*) FILTER (WHERE status = 'complete') / count(*) FILTER (WHERE ended), 9) AS complete_rate, round(sum(saved) FILTER (WHERE ended) / sum(targets) FILTER (WHERE ended), 9) AS target_success_rate,
    count(seconds) AS seconds_n, round(quantile_cont(seconds, 0.5), 3) AS seconds_p50, round(quantile_cont(seconds, 0.95), 3) AS seconds_p95, count(*) FILTER (WHERE ended AND seconds IS NULL) AS invalid_durations FROM d),
i AS (SELECT count(*) AS interval_min_n, round(quantile_cont(gap_min, 0.5), 6) AS interval_min_p50, round(max(gap_min), 6) AS interval_min_max FROM spans WHERE kind = 'between_cycles'),
g AS (SELECT count(*) AS gaps, CAST(coalesce(sum(missed), 0) AS BIGINT) AS missed_cycles FROM gaps),
l AS (SELECT round(quantile_cont(lag, 0.95), 6) AS lag_min_p95, count(*) FILTER (WHERE lag < 0) AS negative_lags FROM (SELECT (epoch_us(fetched_at) - epoch_us(observed_at)) / CAST(60000000 AS DOUBLE) AS lag FROM seen) x),
s AS (
  SELECT count(*) FILTER (WHERE signal = 'new_data') AS new_data, count(*) FILTER (WHERE signal = 'duplicate_or_unchanged') AS duplicate_or_unchanged, count(*) FILTER (WHERE signal = 'no_new_data_failure') AS no_new_data_failure,
    count(*) FILTER (WHERE status NOT IN ('running', 'complete')) AS anomalous FROM told),
h AS (
  SELECT count(*) AS polled, count(n) AS seen, round(count(n) / count(*), 9) AS coverage_rate, round(quantile_cont(n, 0.5), 6) AS snapshots_p50
  FROM hotspots p LEFT JOIN (SELECT hotspot_id, count(*) AS n FROM seen GROUP BY 1) e ON e.hotspot_id = p.hotspot_id WHERE is_polled)
SELECT a.*, i.*, g.*, l.*, s.*, h.*, CAST(533 AS INT) AS expected_cycles FROM a, i, g, l, s, h
