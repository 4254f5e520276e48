WITH
-- include fragments_of
, spoilt AS (SELECT *, (CAST(substr(cell_id, 3, 4) AS INT) / 25 + hour + day(date)) % 9 AS kind FROM compacted)
SELECT date, hour, cell_id, CASE kind WHEN 1 THEN 'sum' WHEN 2 THEN 'fragment_count' WHEN 3 THEN 'canonical_json' WHEN 4 THEN 'json,canonical_json,fragment_count,fields,code,source_file,masked_value,unmasked_value,value_is_total,masked_count,sum,order' ELSE '' END AS faults FROM spoilt
