WITH
-- include catalogue_stages
SELECT 'first' AS source, f_id AS source_id, p_id AS provider_id, 'spatial' AS stage, CASE WHEN nm AND ph THEN 'both' WHEN nm THEN 'name' ELSE 'phone' END AS rule FROM m1 WHERE np = 1 AND nf = 1
UNION ALL SELECT 'permit', f_id, p_id, 'permit', CASE WHEN nm AND ph THEN 'both' WHEN nm THEN 'name' ELSE 'phone' END FROM m2 WHERE np = 1 AND nf = 1
UNION ALL SELECT 'first', f_id, p_id, 'identity', 'identity' FROM m3 WHERE np = 1 AND nf = 1
