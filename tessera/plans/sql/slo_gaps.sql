WITH
-- include slo_of
SELECT kind, since, until, round(gap_min, 6) AS gap_min, missed FROM gaps
