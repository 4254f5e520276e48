"""Hard negatives against brute force."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.llm import negatives


def plain(rows, is_anchor, positives=5, negatives=5, window=(80, 100)):
    """rows (id, label, vector); {(anchor, positive, rank): (negative, scores)}."""
    out = {}
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), j, m) for j, m, w in rows if j != i and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(n, s) for s, n, m in scored if m != label and window[0] * -p <= 100 * -s <= window[1] * -p]
            out |= {(i, j, r): (n, -p, -s) for r, (n, s) in enumerate(fits[:negatives], 1)}
    return out


def mined(df):
    got = df.collect()
    out = {tuple(r)[:3]: tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def test_query(spark, sf_dir):
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    rows = [(i, (m + 1) % 10 if i % 7 == 0 else m, [math.floor(256 * x) for x in v]) for i, m, v in rows if m is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = plain(rows, lambda i: i % 100 == 0)
    assert want and mined(negatives.op13_negatives(spark, sf_dir)) == want


def test_many_blocks_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 100)
    monkeypatch.setattr(negatives, "ASKED", 10)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 0, 0, 1, 2]), [5, 5, 5, 1] if i % 3 == 0 else [rnd.randint(-9, 9) for _ in range(4)]) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, label int, v array<int>")
    assert mined(negatives.mine(df, F.col("id") % 9 == 0)) == plain(rows, lambda i: i % 9 == 0)
    assert mined(negatives.mine(df, F.col("id") % 50 == 0, 2, 7, (50, 150))) == plain(rows, lambda i: i % 50 == 0, 2, 7, (50, 150))


def test_nulls_lengths_large_numbers_and_empty_tables(spark):
    m = negatives.LIMIT
    good = [(0, 1, [m, m]), (1, 1, [m, m - 1]), (2, 2, [m - 1, m - 1]), (3, 2, [m - 2, m]), (4, 2, [1]), (5, 1, [3]), (6, 1, []), (7, 2, []), (8, 1, [2]), (9, 1, [])]
    bad = [(None, 1, [m, m]), (20, None, [m, m]), (21, 2, None), (22, 2, [m, None]), (23, 2, [m + 1, m]), (0, 3, [1, 1]), (3, 2, [m - 2, m])]
    df = spark.createDataFrame(good + bad, "id bigint, label int, v array<bigint>").withColumn("_x", F.lit(1)).withColumn("score", F.lit(2))
    want = plain(good, lambda i: True)
    assert want and mined(negatives.mine(df, F.col("id") >= 0)) == want
    assert negatives.mine(df.limit(0), F.col("id") >= 0).count() == 0
    assert negatives.mine(df, F.col("id") < 0).count() == 0


def test_bounds_leave_balls_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (20, 8))
    x = np.repeat(centres, 100, axis=0) + rng.integers(-3, 4, (2000, 8))
    search = negatives.Search(x, np.arange(2000), np.repeat(np.arange(20) % 3, 100), 16)
    q = x[::100]
    wide = np.full(20, negatives.NONE + 1)
    scores, ids = search.run(q, np.arange(0, 2000, 100), np.arange(20) % 3, np.arange(20), wide, -wide, True, 5)
    assert search.seen < 0.2 * 20 * 2000
    for i in range(20):
        s = x @ q[i]
        fits = [j for j in np.lexsort((np.arange(2000), -s)) if search.labels[j] == i % 3 and j != 100 * i][:5]
        assert ids[i].tolist() == fits and scores[i].tolist() == s[fits].tolist()
