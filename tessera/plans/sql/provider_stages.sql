WITH
-- include catalogue_stages
, counts AS (
  SELECT 'spatial' AS stage, (SELECT count(*) FROM catalogue_b) AS n, count(DISTINCT p_id) FILTER (WHERE np = 1 AND nf = 1) AS matched, count(DISTINCT p_id) FILTER (WHERE np > 1 OR nf > 1) AS ambiguous FROM m1
  UNION ALL SELECT 'permit', (SELECT count(*) FROM rest), count(DISTINCT p_id) FILTER (WHERE np = 1 AND nf = 1), count(DISTINCT p_id) FILTER (WHERE np > 1 OR nf > 1) FROM m2
  UNION ALL SELECT 'identity', (SELECT count(*) FROM remaining), count(DISTINCT p_id) FILTER (WHERE np = 1 AND nf = 1), count(DISTINCT p_id) FILTER (WHERE np > 1 OR nf > 1) FROM m3)
SELECT stage, matched, ambiguous, n - matched - ambiguous AS unmatched FROM counts
