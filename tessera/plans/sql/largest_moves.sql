WITH
-- include releases_of
SELECT place_id, round(moved, 3) AS moved_m FROM j ORDER BY round(moved, 3) DESC, place_id LIMIT 20
