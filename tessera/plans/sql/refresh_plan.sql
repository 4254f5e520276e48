WITH
-- include releases_of
SELECT count(*) AS matched, count(*) FILTER (WHERE a OR b OR c) AS changed, count(*) FILTER (WHERE NOT (a OR b OR c)) AS unchanged, count(*) FILTER (WHERE a) AS names, count(*) FILTER (WHERE b) AS phones, count(*) FILTER (WHERE c) AS places,
  count(*) FILTER (WHERE moved > 80) AS large_moves, (SELECT count(*) FROM old WHERE place_id NOT IN (SELECT place_id FROM new)) AS missing, (SELECT count(*) FROM new WHERE place_id NOT IN (SELECT place_id FROM old)) AS added FROM j
