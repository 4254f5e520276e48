WITH
-- include fragments_of
SELECT date, hour, cell_id, CAST(known_total AS VARCHAR) AS known_total, fragment_count, masked_fragment_count, fragments_json FROM compacted
