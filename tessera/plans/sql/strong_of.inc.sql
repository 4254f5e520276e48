strong AS (
  SELECT permit_id, cafe_id, by_name, by_phone, d FROM (
    SELECT p.permit_id, c.cafe_id, lower(regexp_replace(p.name, '\s+', ' ', 'g')) = lower(regexp_replace(c.name, '\s+', ' ', 'g')) AS by_name,
      coalesce(regexp_full_match(c.phone, '[0-9+().\s-]+') AND regexp_replace(p.phone, '[^0-9]', '', 'g') = regexp_replace(c.phone, '[^0-9]', '', 'g'), false) AS by_phone,
      2 * 6371008.8 * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lng - p.lng) / 2), 2)))) AS d
    FROM permit_places p JOIN cafe_places c ON c.building = p.building AND c.placed AND (c.k % 4 = 0) = (p.k % 4 = 0)) x
  WHERE d <= 50 AND (by_name OR by_phone))
