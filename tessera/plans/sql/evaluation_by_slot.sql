WITH
-- include scores_then
, j AS (SELECT t.slot, t.observed_area_level AS truth, s.level, s.score FROM truths t JOIN past s ON s.cafe_id = t.cafe_id AND s.observed_at = t.observed_at WHERE s.score IS NOT NULL)
SELECT slot, count(*) AS n, round(avg(CASE WHEN level = truth THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS exact_share, round(avg(CASE WHEN abs(level - truth) <= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS adjacent_share, round(avg(abs(score - truth)), 6) AS mae FROM j GROUP BY slot
