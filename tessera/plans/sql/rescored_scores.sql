WITH
-- include near_of
, made AS (SELECT cafe_id, sum(level / pow(greatest(d, 50), 2)) / sum(1 / pow(greatest(d, 50), 2)) AS score, min(d) AS nearest, count(*) AS n, max(observed_at) AS newest, max(CASE WHEN rank = 1 THEN hotspot_id END) AS primary_hotspot_id,
    string_agg(CAST(hotspot_id AS VARCHAR), ',' ORDER BY rank) AS contributors FROM near GROUP BY cafe_id)
SELECT c.cafe_id, round(score, 6) AS score, CASE WHEN nearest IS NULL THEN 'uncovered' WHEN nearest <= 600 THEN 'covered' ELSE 'fringe' END AS coverage, CAST(coalesce(n, 0) AS INT) AS neighbours, primary_hotspot_id,
  CASE WHEN nearest IS NOT NULL THEN round(greatest(0, 1 - nearest / 1500) * exp(-greatest(0, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(newest)) / CAST(60000000 AS DOUBLE)) / 15) * least(1, n / CAST(2 AS DOUBLE)), 9) END AS confidence, coalesce(contributors, '') AS contributors
FROM cafes c LEFT JOIN made m ON m.cafe_id = c.cafe_id WHERE c.active
