WITH
-- include scores_then
SELECT cafe_id, observed_at, round(score, 6) AS score, level, coverage FROM past
