WITH
-- include slo_of
SELECT cycle_id, status, new_snapshots, signal FROM told
