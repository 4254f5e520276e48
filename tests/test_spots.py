"""Queries over cafes and hotspots that share their spots, against their SQL and by the rows that meet in cells."""

import duckdb
import pytest

from tessera import catalog
from tessera.operators import resolution, spatial
from tessera.sources import adapters

DATA = "/root/testdata"


def shown(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """1,500 cafes and 4,000 hotspots at 1,000 spots, as spots go by keys modulo 1,000; each hotspot has two or three snapshots."""
    made, c = tmp_path_factory.mktemp("shared"), duckdb.connect()
    tables = {
        "customer": f"SELECT * FROM '{DATA}/sf0.01/customer.parquet'",
        "supplier": f"SELECT s.* REPLACE (s_suppkey + 1000 * i AS s_suppkey) FROM '{DATA}/sf0.1/supplier.parquet' s, range(4) g(i)",
        "events": f"SELECT * REPLACE (event_id AS user_id) FROM '{DATA}/sf0.01/events.parquet'",
    }
    for t, text in tables.items():
        c.sql(f"COPY ({text}) TO '{made}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{made}/{t}.parquet'")
    return str(made), c


@pytest.mark.parametrize("name", ["band_shortages", "band_topn", "coverage_counts", "coverage_transition", "knn_topk", "masked_serving", "cafe_summary", "score_points"])
def test_shared_spots(spark, shared, monkeypatch, name):
    """The rows of the SQL; cells are met by one row for each spot of cafes and by the first three polled hotspots of each spot, 900 of them."""
    sf_dir, con = shared
    seen, real = [], spatial.with_cells
    monkeypatch.setattr(spatial, "with_cells", lambda *a: seen.append(real(*a)) or seen[-1])
    df, rel = catalog.QUERIES[name](spark, sf_dir), con.sql(catalog.SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(shown, r)) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())
    assert [cells.count() for cells in seen] == [1000, 9 * 3 * 900]


def test_gates_are_counted_without_pairs(spark, tmp_path):
    """One building, of whose permits some repeat ids: the rows of the SQL, from one row at most for each gate and permit."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (c_custkey * 400 AS c_custkey) FROM '{DATA}/sf0.1/customer.parquet' WHERE c_custkey % 2500 < 400 AND c_custkey < 5000) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    permits, cafes = (adapters.load(spark, str(tmp_path), t) for t in ("permit_places", "cafe_places"))
    assert permits.count() > permits.select("permit_id").distinct().count()
    want = con.sql(catalog.SQL["gate_funnel"]).fetchall()
    assert max(r[2] for r in want) > 100 * permits.count()
    counts = resolution.gate_masks(permits, cafes, "permit")
    assert counts.count() <= 11 * permits.count()
    assert sorted(map(tuple, resolution.gate_funnel(counts).collect())) == sorted(want)
