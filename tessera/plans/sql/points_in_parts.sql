WITH
-- include parts_of
SELECT c.cafe_id, b.hotspot_id FROM cafes c JOIN boxes b
  ON CASE WHEN b.sign = 1 THEN c.lat BETWEEN y0 AND y1 AND c.lng BETWEEN x0 AND x1 ELSE c.lat > y0 AND c.lat < y1 AND c.lng > x0 AND c.lng < x1 END
GROUP BY c.cafe_id, b.hotspot_id HAVING sum(sign) > 0
