"""Schemas of the domain's tables, as DDL. Nothing is inferred from files."""

from __future__ import annotations

FORECAST = "array<struct<at:timestamp,level:int,population_min:int,population_max:int>>"

TABLES = {
    "ingest_cycles": "id int, started_at timestamp, completed_at timestamp, targets int, saved int, failed int, status string",
    "hotspots": "id int, area_cd string, name string, category string, lat double, lng double, is_polled boolean",
    "hotspot_snapshots": f"hotspot_id int, observed_at timestamp, fetched_at timestamp, congest_level int, congest_label string, ppltn_min int, ppltn_max int, forecast {FORECAST}, raw string",
    "hotspot_serving_states": f"hotspot_id int, computed_at timestamp, observed_at timestamp, trend_12h array<struct<observed_at:timestamp,level:int>>, forecast_1h {FORECAST}",
    "hotspot_parse_failures": "hotspot_id int, fetched_at timestamp, error_type string, error_message string, raw string",
    "cafes": "id int, origin_provider string, origin_source_id string, overture_id string, source_release string, source_confidence double, primary_category string, name string, lat double, lng double, road_address string, phone string, website string, sources array<map<string,string>>, external_links map<string,string>, active boolean",
    "cafe_provider_places": "id int, cafe_id int, provider string, provider_place_id string, detail_url string, active boolean, match_method string, match_distance_m double, verified_at timestamp, last_seen_at timestamp",
    "cafe_scores": "cafe_id int, model_version string, computed_at timestamp, source_observed_at timestamp, score double, level int, confidence double, tier string, coverage string, primary_hotspot_id int, primary_distance_m double, contributors array<struct<hotspot_id:int,distance_m:double,level:int,weight:double>>",
    "cafe_place_reports": "id int, kind string, cafe_id int, payload string, status string, created_at timestamp",
    "cafe_crowd_feedback": "id int, cafe_id int, reported_at timestamp, street_level int, seat_state string, predicted_level int, predicted_confidence double",
    "user_contribution_rate_limits": "kind string, bucket_epoch bigint, submission_count int",
}

#: For each table, conditions that all rows meet, by name.
RULES = {
    "ingest_cycles": {"counts": "saved >= 0 AND failed >= 0 AND saved + failed <= targets", "state": "(completed_at IS NULL) = (status = 'running')", "complete": "status <> 'complete' OR (saved = targets AND failed = 0 AND saved > 0)"},
    "hotspots": {"lat": "lat BETWEEN -90 AND 90", "lng": "lng BETWEEN -180 AND 180"},
    "hotspot_snapshots": {"level": "congest_level BETWEEN 1 AND 4", "bounds": "ppltn_min IS NULL OR (0 <= ppltn_min AND ppltn_min <= ppltn_max)"},
    "cafes": {"confidence": "source_confidence BETWEEN 0 AND 1", "lat": "lat BETWEEN -90 AND 90", "lng": "lng BETWEEN -180 AND 180"},
    "cafe_provider_places": {"distance": "match_distance_m IS NULL OR match_distance_m >= 0"},
    "cafe_scores": {"nulls": "(coverage = 'uncovered') = (score IS NULL) AND (score IS NULL) = (level IS NULL) AND (score IS NULL) = (confidence IS NULL)", "score": "score IS NULL OR score BETWEEN 1 AND 4"},
    "user_contribution_rate_limits": {"count": "submission_count > 0"},
}
