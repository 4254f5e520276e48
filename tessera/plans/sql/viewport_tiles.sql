WITH
v AS (SELECT id, west, CASE WHEN east < west THEN east + 360 ELSE east END AS east, greatest(-85.05112878, least(85.05112878, south)) AS south, greatest(-85.05112878, least(85.05112878, north)) AS north, greatest(10, least(15, floor(zoom))) AS zoom FROM viewports),
r AS (
  SELECT v.*, z, pow(2, z) AS n, east - west >= 360 AS whole, (1 - ln(tan(radians(north)) + sqrt(pow(tan(radians(north)), 2) + 1)) / pi()) / 2 AS yn, (1 - ln(tan(radians(south)) + sqrt(pow(tan(radians(south)), 2) + 1)) / pi()) / 2 AS ys FROM v CROSS JOIN (SELECT unnest(range(10, 16)) AS z) z),
k AS (
  SELECT id, z, zoom, n, CASE WHEN whole THEN 0 ELSE floor((west + 180) / 360 * n) END AS x0, CASE WHEN whole THEN n - 1 ELSE ceil((east + 180) / 360 * n) - 1 END AS x1, greatest(0, least(n - 1, floor(yn * n))) AS y0, greatest(0, least(n - 1, ceil(ys * n) - 1)) AS y1 FROM r),
s AS (SELECT *, greatest(0, x1 - x0 + 1) * greatest(0, y1 - y0 + 1) AS size FROM k),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY z DESC) AS rn FROM s WHERE z = 10 OR (z <= zoom AND size <= 16))
SELECT id, CAST(z AS INT) AS z, CAST(size AS BIGINT) AS tiles, CAST(CASE WHEN size > 0 THEN (x0 % n + n) % n END AS BIGINT) AS first_x, CAST(CASE WHEN size > 0 THEN (x1 % n + n) % n END AS BIGINT) AS last_x, CAST(CASE WHEN size > 0 THEN y0 END AS BIGINT) AS first_y, CAST(CASE WHEN size > 0 THEN y1 END AS BIGINT) AS last_y
FROM c WHERE rn = 1
