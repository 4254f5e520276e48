SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS invalid_date, CAST(count(*) FILTER (WHERE CAST(hour_raw AS INT) = 3) AS BIGINT) AS invalid_hour, CAST(0 AS BIGINT) AS invalid_administrative_dong_code,
  count(*) FILTER (WHERE substr(cell_id, 3, 4) = '0025') AS invalid_cell_id, count(*) FILTER (WHERE total_raw = '*') AS invalid_total, count(*) FILTER (WHERE total_raw <> '*') AS invalid_fraction_scale FROM population_rows
