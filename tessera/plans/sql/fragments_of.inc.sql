compacted AS (
  SELECT CAST(strptime(date_raw, '%Y%m%d') AS DATE) AS date, CAST(hour_raw AS INT) AS hour, cell_id,
    coalesce(sum(CASE WHEN total_raw <> '*' THEN CAST(total_raw AS DECIMAL(38, 5)) END), CAST(0 AS DECIMAL(38, 5))) AS known_total, CAST(count(*) AS INT) AS fragment_count,
    CAST(count(*) FILTER (WHERE total_raw = '*') AS INT) AS masked_fragment_count,
    concat('[', string_agg(CAST(to_json(struct_pack(administrative_dong_code := administrative_dong_code,
      known_value := CASE WHEN total_raw <> '*' THEN CAST(CAST(total_raw AS DECIMAL(38, 5)) AS VARCHAR) END, total_raw := total_raw, masked := total_raw = '*', source_file := source_file)) AS VARCHAR),
      ',' ORDER BY administrative_dong_code, source_file, total_raw), ']') AS fragments_json
  FROM population_rows WHERE substr(cell_id, 3, 4) <> '0000' GROUP BY date_raw, hour_raw, cell_id)
