"""Nearest points in a band against brute force."""

import bisect
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bands


def nulls_first(x):
    return tuple((v is not None, v) for v in x)


def near(p, u, flat=50, per_mille=5):
    return abs(u - p) <= flat or 1000 * abs(u - p) <= per_mille * min(u, p)


def plain(items, lines, k=10):
    """items (id, p); lines (u, sale, line, item, weight): {id: (nearest, n, gaps, weights)} of each pair."""
    lines = sorted(lines, key=nulls_first)
    at = [x[0] for x in lines]
    out = {}
    for i, p in items:
        pairs = []
        if i is not None and p is not None:
            reach = 50 + abs(p) // 100
            for u, s, n, j, w in lines[bisect.bisect_left(at, p - reach) : bisect.bisect_right(at, p + reach)]:
                if j != i and near(p, u):
                    pairs.append((abs(u - p), u, s, n, j, w))
        pairs.sort(key=nulls_first)
        out[i, p] = [x[:5] for x in pairs[:k]], len(pairs), sum(x[0] for x in pairs), sum(x[5] or 0 for x in pairs)
    return out


def test_query(spark, sf_dir):
    f = lambda x: math.floor(100 * x + 0.5)
    items = duckdb.sql(f"SELECT item_id, price FROM '{sf_dir}/items.parquet'").fetchall()
    lines = duckdb.sql(f"SELECT sale_id, line_no, item_id, quantity, amount FROM '{sf_dir}/sale_lines.parquet' WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL").fetchall()
    lines = [((2 * f(a) + q) // (2 * q), s, n, i, zlib.crc32(f"{s},{n},{i}".encode())) for s, n, i, q, a in lines]
    want = {}
    for (i, _), (best, *totals) in plain([(i, None if p is None else f(p)) for i, p in items], lines).items():
        want |= {(i, r): (*x, *totals) for r, x in enumerate(best, 1)} or {(i, 0): (None,) * 5 + tuple(totals)}
    got = [tuple(r) for r in bands.op12_bands(spark, sf_dir).collect()]
    assert len(got) == len(want) and {r[:2]: r[2:] for r in got} == want


def found(spark, items, lines, **args):
    queries = spark.createDataFrame(items, "own bigint, p bigint")
    points = spark.createDataFrame(lines, "u bigint, sale bigint, line bigint, own bigint, weight bigint").select("own", "u", "weight", "sale", "line")
    out = bands.nearest_in_band(queries, points, ["sale", "line"], **args).collect()
    assert len(out) == len(items)
    return {(r.own, r.p): ([tuple(x) for x in r.nearest], r.n, r.gap_sum, r.weight_sum) for r in out}


def test_hot_owners_ties_and_magnitudes(spark):
    rnd = random.Random(5)
    around = [0, 7, 99, 100, 1000, 9_990, 99_950, 100_000, 100_040, 999_500, 1_000_000, 12_345_678, 987_654_321_000, -40, -3000]
    lines = [(max(rnd.choice(around) + rnd.randint(-60, 60), -4000), rnd.randint(0, 9), rnd.choice([None, 0, 1]), rnd.choice([1, 1, 1, 1, 2, 3, 4]), rnd.choice([None, 1, 5, 2**32 - 1])) for _ in range(3000)]
    lines += [(500, 1, 1, 1, 9)] * 500 + [(987_654_000_000, 1, 1, 8, 2)] * 3
    items = [(i, p + d) for i, p in enumerate(around) for d in (0, 13)] + [(1, 500), (2, 500), (2, 540)]
    assert found(spark, items, lines) == plain(items, lines)
    assert found(spark, items, lines, k=3) == plain(items, lines, 3)


def test_nulls_repeated_rows_and_empty_tables(spark):
    items = [(1, 100), (1, 100), (None, 100), (2, None), (3, 10**9)]
    lines = [(100, 1, 1, 2, 5), (100, 1, 1, 2, 5), (None, 1, 1, 2, 5), (100, 1, 1, None, 5), (150, None, None, 2, None)]
    queries = spark.createDataFrame(items, "own bigint, p bigint").withColumn("u", F.lit("x"))
    points = spark.createDataFrame(lines, "u bigint, sale bigint, line bigint, own bigint, weight bigint").withColumn("points", F.lit(1))
    got = sorted(bands.nearest_in_band(queries, points, ["sale", "line"]).collect(), key=str)
    assert [r.n for r in got if r.own == 1] == [3, 3] and [r.weight_sum for r in got if r.own == 1] == [10, 10] and [r.gap_sum for r in got if r.own == 1] == [50, 50]
    assert all(r.n == 0 and r.nearest == [] for r in got if r.own != 1) and len(got) == 5
    assert bands.nearest_in_band(queries.limit(0), points, ["sale", "line"]).count() == 0
    assert [r.n for r in bands.nearest_in_band(queries, points.limit(0), ["sale", "line"]).collect()] == [0] * 5


def test_prices_that_are_no_numbers(spark):
    rows = spark.createDataFrame([(1.005, 2), (float("nan"), 1), (float("inf"), 1), (None, 1), (3.0, 0), (-3.0, -2), (-3.01, 2)], "a double, q int")
    assert [r[0] for r in rows.select(bands.unit_cents(F.col("a"), F.col("q"))).collect()] == [50, None, None, None, None, 150, -150]


def test_blocks_cover_every_band(spark):
    p = [0, 49, 50, 149, 99_499, 99_999, 100_000, 100_500, 999_999, 1_004_000, 10**12 + 7, -1, -50, -101]
    low, high = bands.Band().ends(F.col("p"))
    rows = spark.createDataFrame([(x,) for x in p], "p bigint").select("p", low.alias("low"), high.alias("high"))
    rows = rows.withColumn("blocks", bands.blocks_between(F.col("low"), F.col("high"))).withColumn("u", F.explode(F.array("low", "p", "high"))).withColumn("at", bands.block_of(F.col("u")))
    for r in rows.collect():
        assert near(r.p, r.low) and near(r.p, r.high) and not near(r.p, r.low - 1) and not near(r.p, r.high + 1)
        assert r["at"] in r.blocks and r["at"] <= r.u and len(set(r.blocks)) == len(r.blocks) <= 13


@pytest.mark.parametrize("keys", [[0], [0, 1], [7], [0, 9, 10, 99], [3, 250, 251, 999], list(range(0, 100))])
def test_trie(keys):
    n = np.arange(1, len(keys) + 1)
    trie = bands.Trie(np.array(keys), np.stack([n, n * np.array(keys)], axis=1))
    x = np.arange(-3, 1200)
    want = [[sum(c for k, c in zip(keys, n) if k < y), sum(c * k for k, c in zip(keys, n) if k < y)] for y in x]
    assert trie.below(x).tolist() == want
    for q in (-5, 0, 9, 50, 251, 2000):
        got = [(g, keys[i]) for g, i in trie.nearest(q, 2, 300)]
        assert got == sorted((abs(k - q), k) for k in keys if 2 <= k <= 300)
