"""Nearest points within a band around a value, with totals over the whole band.

Points are first summed by value, so that a value is one leaf however many
points it has: their number, the sum of their weights, and the first of them
in order. Leaves and query values meet in blocks that share their high
digits. In a block a digit trie stands over the leaves, with sums for every
subtree. Totals of a band come from descents along its two ends, and the
nearest points from a best-first walk that opens the subtree with the least
possible gap. A query's own points never count: their totals are subtracted,
and a leaf keeps enough points that the nearest remain without any one owner.

Queries of equal value share one search, so the work follows the number of
different values, not the number of queries or points.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.store import table

#: Values below LARGE in blocks of WIDTH; others in blocks of all values with the same three first digits.
LARGE, WIDTH = 100_000, 100


@dataclass(frozen=True)
class Band:
    """Values p and u are near if |u - p| is at most flat, or 1000 * |u - p| at most per_mille * min(u, p)."""

    flat: int = 50
    per_mille: int = 5

    def ends(self, p: Column) -> tuple[Column, Column]:
        """The least and the greatest value near p."""
        low = -floor_div(-1000 * p, F.lit(1000 + self.per_mille))
        return F.least(p - self.flat, low), p + F.greatest(F.lit(self.flat), floor_div(self.per_mille * p, F.lit(1000)))


def floor_div(x: Column, y: Column) -> Column:
    """The greatest whole number not above x / y, of whole numbers, y positive."""
    return F.call_function("div", x - F.pmod(x, y), y)


def width_of(u: Column) -> Column:
    """The width of the block of u, a power of ten."""
    return F.when(u < LARGE, F.lit(WIDTH).cast("long")).otherwise(F.rpad(F.lit("1"), F.length(u.cast("string")) - 2, "0").cast("long"))


def block_of(u: Column) -> Column:
    """The first value of the block of u."""
    return u - F.pmod(u, width_of(u))


def blocks_between(low: Column, high: Column) -> Column:
    """The first values of all blocks that hold a value from low to high; these differ in width once at most."""
    w, v = width_of(low), width_of(high)
    edge = F.when(w == v, block_of(high)).otherwise(100 * v - w)  # a width's blocks end where the next width's begin
    wider = F.when(w == v, F.array().cast("array<bigint>")).otherwise(F.sequence(100 * v, F.greatest(100 * v, block_of(high)), v))
    return F.concat(F.sequence(block_of(low), F.greatest(block_of(low), edge), w), wider)


class Trie:
    """Decimal digits over whole numbers from 0, with the sums of every subtree.

    keys: the leaves in ascending order; sums: a row of totals for each.
    Level n holds the subtrees of the numbers that agree but for n digits.
    """

    def __init__(self, keys: np.ndarray, sums: np.ndarray):
        self.keys, self.first, self.upto = [keys], [], []
        top = int(keys[-1])
        while top:  # up to a root that holds all
            top //= 10
            node = self.keys[-1] // 10
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            self.upto.append(np.concatenate([np.zeros((1, sums.shape[1]), np.int64), np.cumsum(sums, axis=0)]))
            self.first.append(np.r_[start, len(node)])
            sums = np.add.reduceat(sums, start)
            self.keys.append(node[start])
        self.total = sums.sum(axis=0)
        if not self.first:  # the number 0 alone
            self.upto.append(np.concatenate([np.zeros((1, sums.shape[1]), np.int64), sums]))
            self.first.append(np.array([0, 1]))
            self.keys.append(np.zeros(1, np.int64))

    def below(self, x: np.ndarray) -> np.ndarray:
        """Totals of the leaves below each x: on the way down to x, the subtrees left of it at each level."""
        top = len(self.keys) - 1
        out = np.zeros((len(x), self.upto[0].shape[1]), np.int64)
        x = np.clip(x, 0, 10**top)
        out[x == 10**top] = self.total  # the way leads past the root
        for level in range(top - 1, -1, -1):
            digit = x // 10**level
            at = np.searchsorted(self.keys[level], digit)
            begin = np.searchsorted(self.keys[level], digit // 10 * 10)
            inside = x < 10**top
            out[inside] += (self.upto[level][at] - self.upto[level][begin])[inside]
        return out

    def nearest(self, q: int, low: int, high: int) -> Iterator[tuple[int, int]]:
        """(gap, index of leaf) of the leaves from low to high, by gap to q and by number.

        A subtree stands in the queue with the least gap that a leaf of it can
        have, before leaves of that gap.
        """
        queue = [(0, 0, 0, len(self.keys) - 1, 0)]
        while queue:
            gap, leaf, _, level, i = heapq.heappop(queue)
            if leaf:
                yield gap, i
                continue
            level -= 1
            size = 10**level
            for j in range(self.first[level][i], self.first[level][i + 1]):
                begin = int(self.keys[level][j]) * size
                a, b = max(begin, low), min(begin + size - 1, high)
                if a <= b:
                    heapq.heappush(queue, (max(a - q, q - b, 0), int(level == 0), begin, level, j))


def search(leaves: pa.Table, asked: pa.Table, take: int, cap: int) -> tuple[np.ndarray, list[int], list[int]]:
    """For each value asked in one block: totals (n, gaps, weights), and the first points by gap.

    leaves are in order of u. Points come as indices into their flattened
    lists, with the number of points for each value asked; at most take in all
    and cap of one owner.
    """
    start = leaves["block"][0].as_py()
    keys = leaves["u"].to_numpy() - start
    n, weight = leaves["n"].to_numpy(), leaves["weight"].to_numpy()
    trie = Trie(keys, np.stack([n, n * keys, weight], axis=1))
    p, low, high = (asked[c].to_numpy() - start for c in ("p", "low", "high"))
    at_low, at_p, past = trie.below(low), trie.below(p), trie.below(high + 1)
    left, right = at_p - at_low, past - at_p
    gaps = p * left[:, 0] - left[:, 1] + right[:, 1] - p * right[:, 0]
    totals = np.stack([left[:, 0] + right[:, 0], gaps, left[:, 2] + right[:, 2]], axis=1)
    lists = leaves["points"].combine_chunks()
    ends = lists.offsets.to_numpy().tolist()
    owners = lists.values.field("own").to_pylist()
    found: list[int] = []
    sizes = []
    for q, a, b, some in zip(p.tolist(), low.tolist(), high.tolist(), totals[:, 0].tolist()):
        began, seen = len(found), {}
        for _, i in trie.nearest(q, a, b) if some else ():
            for j in range(ends[i], ends[i + 1]):
                c = seen[owners[j]] = seen.get(owners[j], 0) + 1
                if c <= cap:
                    found.append(j)
                    if len(found) - began == take:
                        break
            if len(found) - began == take:
                break
        sizes.append(len(found) - began)
    return totals, found, sizes


def of_block(schema: pa.Schema, take: int, cap: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The search as a function of the two tables of a block."""

    def run(leaves: pa.Table, asked: pa.Table) -> pa.Table:
        if not leaves.num_rows or not asked.num_rows:
            return schema.empty_table()
        leaves = leaves.sort_by("u")
        totals, found, sizes = search(leaves, asked, take, cap)
        points = leaves["points"].combine_chunks().values.take(pa.array(found, pa.int64()))
        nearest = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), points)
        columns = [asked["p"].combine_chunks(), *(pa.array(totals[:, i]) for i in range(3)), nearest.cast(schema.field("nearest").type)]
        return pa.Table.from_arrays(columns, schema=schema).filter(pa.array(totals[:, 0] > 0))

    return run


def nearest_in_band(queries: DataFrame, points: DataFrame, order: list[str], k: int = 10, band: Band = Band()) -> DataFrame:
    """For each row of queries (own, p): n, gap_sum and weight_sum over the points near p of other owners, and the first k of them.

    points: (own, u, weight, and the columns order), p, u and weight long. The
    column nearest lists (gap, u, order, own) by gap, u, order and own. Points
    null in own or u, and queries null in own or p, never meet: totals are 0 and
    the list is empty. Equal points each count and take a place each; equal
    queries give equal rows. A null in order comes first; a null weight is 0.
    Columns of queries other than own and p are dropped. Values must be below
    10 ** 15.

    Nothing is gathered by owner or value before it is summed, so an owner or a
    value may have any share of all points. A block holds at most WIDTH leaves
    below LARGE, and above it a hundredth of the values of its decade.
    """
    queries = queries.select("own", F.when(F.col("own").isNotNull(), F.col("p")).alias("p"))
    points = points.where("own IS NOT NULL AND u IS NOT NULL").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    low, high = band.ends(F.col("p"))
    first = [F.col(c).asc_nulls_first() for c in [*order, "own"]]
    by = lambda *keys: Window.partitionBy(*keys).orderBy(*first)
    kept = points.select("u", "own", *order).withColumn("_r", F.row_number().over(by("u", "own"))).where(f"_r <= {k}")
    kept = kept.withColumn("_r", F.row_number().over(by("u"))).where(f"_r <= {2 * k}")  # any owner has k of them at most
    point = F.struct("u", *order, "own")
    lists = kept.groupBy("u").agg(F.sort_array(F.collect_list(point)).alias("points"))
    sums = points.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    leaves = sums.join(lists, "u").withColumn("block", block_of(F.col("u")))
    asked = queries.where("p IS NOT NULL").select("p").distinct().select("p", low.alias("low"), high.alias("high"))
    asked = asked.withColumn("block", F.explode(blocks_between(F.col("low"), F.col("high"))))
    schema = asked.select("p", *(F.lit(0).cast("long").alias(c) for c in ("n", "gap_sum", "weight_sum"))).schema.add("nearest", leaves.schema["points"].dataType)
    parts = leaves.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(of_block(to_arrow_schema(schema), 2 * k, k), schema)
    # a band meets a few blocks, each with 2k points at most
    spread = parts.select("p", "n", "gap_sum", "weight_sum", F.posexplode("nearest").alias("_i", "x"))
    spread = spread.select("p", *(F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in ("n", "gap_sum", "weight_sum")), F.struct(F.abs(F.col("x.u") - F.col("p")).alias("gap"), "x.*").alias("x"))
    spread = spread.withColumn("_r", F.row_number().over(Window.partitionBy("p", "x.own").orderBy("x")))
    spread = spread.withColumn("_s", F.row_number().over(Window.partitionBy("p").orderBy(F.col("_r") > k, "x")))
    listed = F.sort_array(F.collect_list(F.when((F.col("_r") <= k) & (F.col("_s") <= 2 * k), F.col("x"))))
    found = spread.groupBy("p").agg(*(F.sum(c).alias(c) for c in ("n", "gap_sum", "weight_sum")), listed.alias("x"))
    own = points.groupBy("own", "u").agg(F.count(F.lit(1)).alias("m"), F.sum("weight").alias("w"))
    pairs = queries.where("p IS NOT NULL").distinct().select("own", "p", low.alias("low"), high.alias("high"))
    own = own.join(pairs, "own").where("u BETWEEN low AND high").groupBy("own", "p")
    own = own.agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.abs(F.col("u") - F.col("p"))).alias("g"), F.sum("w").alias("w"))
    joined = queries.join(own, ["own", "p"], "left").join(found, "p", "left")
    less = lambda a, b: (F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))).cast("long")
    others = F.slice(F.filter("x", lambda x: x.own != F.col("own")), 1, k)
    empty = F.array().cast(joined.schema["x"].dataType)
    return joined.select("own", "p", less("n", "m").alias("n"), less("gap_sum", "g").alias("gap_sum"), less("weight_sum", "w").alias("weight_sum"), F.coalesce(others, empty).alias("nearest"))


def cents(x: Column) -> Column:
    """Whole cents of a price, half a cent up; null for what isn't a finite number."""
    return F.when(F.abs(x) < 1e13, F.floor(100 * x + 0.5)).cast("long")


def unit_cents(amount: Column, quantity: Column) -> Column:
    """Cents of one of quantity pieces, half a cent up, in whole numbers; null if the quantity is 0."""
    q = quantity.cast("long")
    a = 2 * cents(amount) + q
    return F.when(q > 0, floor_div(a, F.abs(2 * q))).when(q < 0, floor_div(-a, F.abs(2 * q)))


def op12_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's nearest lines of other items by price, and totals over all of them."""
    items = table(spark, sf_dir, "items").select(F.col("item_id").alias("own"), cents(F.col("price")).alias("p"))
    lines = table(spark, sf_dir, "sale_lines").where("sale_id IS NOT NULL AND item_id IS NOT NULL")
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "line_no", "item_id")))
    points = lines.select(F.col("item_id").cast("long").alias("own"), unit_cents(F.col("amount"), F.col("quantity")).alias("u"), F.crc32(text).alias("weight"), F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"))
    found = nearest_in_band(items, points, ["sale_id", "line_no"])
    rows = found.select(F.col("own").alias("item_id"), F.posexplode_outer("nearest").alias("i", "x"), "n", "gap_sum", "weight_sum")
    return rows.select(
        "item_id",
        (F.coalesce("i", F.lit(-1)) + 1).cast("int").alias("rank"),
        "x.gap",
        "x.u",
        "x.sale_id",
        "x.line_no",
        F.col("x.own").alias("line_item_id"),
        F.col("n").alias("n_pairs"),
        "gap_sum",
        F.col("weight_sum").alias("lines_crc"),
    )
