"""SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint is cut into two halves: of three differing bits, one half holds
one at most. Each half is indexed once for each of its bits with that bit
left out, so two halves that differ in one bit or none share an entry.
Fingerprints under one entry are compared and their links become a spanning
forest, never all pairs. An entry with more fingerprints than a task should
hold is cut again: its fingerprints agree on the half in question, so their
other halves are halved in turn. After three cuts an entry's fingerprints can
differ in 11 bits only, which bounds it at 2048.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.components import connect
from tessera.llm.store import cut, drop, table

WORDS, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of one entry that a task holds at once; 2048 at least.
HELD = 8192
#: Entries up to this size are compared pair by pair, as arrays.
SMALL = 8


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned; 0 without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = list(accumulate(len(p) + 1 for p in parts))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Adds the long column out with the fingerprint's 64 bits; a null text counts as empty."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array(np.array([fingerprint(t.as_py(), words, seed) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, run(F.col(text)))


def differing(x: np.ndarray) -> np.ndarray:
    """The number of set bits; numpy counts those of the absolute value of signed numbers."""
    return np.bitwise_count(x.view(np.uint64))


def forest(prints: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that connect what is connected by pairs within distance.

    Every fingerprint that is reached leaves the rest, so a dense entry costs
    little more than its size.
    """
    a, b = [], []
    rest = np.sort(prints)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        stack = [root]
        while stack and len(rest):
            near = differing(rest ^ stack.pop()) <= distance
            hit = rest[near]
            if len(hit):
                rest = rest[~near]
                stack.extend(hit)
                a += [root] * len(hit)
                b += hit.tolist()
    return a, b


def links_of_runs(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(edge, len(keys)))
    a, b = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for gap in range(1, min(SMALL, int(sizes.max(initial=0)))):
        x, y = prints[:-gap], prints[gap:]
        hit = small[:-gap] & (keys[:-gap] == keys[gap:]) & (differing(x ^ y) <= distance) & (x != y)
        a.append(x[hit])
        b.append(y[hit])
    for at, size in zip(edge[sizes > SMALL], sizes[sizes > SMALL]):
        c, d = forest(np.unique(prints[at : at + size]), distance)
        a.append(np.array(c, np.int64))
        b.append(np.array(d, np.int64))
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    return np.minimum(a, b), np.maximum(a, b)


def compare(distance: int, held: int):
    """For mapInArrow over (key, print, low, width) sorted by key: links, and rows of entries that are too large."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, low=None, width=None) -> pa.RecordBatch:
        zero = np.zeros(len(a), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(zero + kind), pa.array(a), pa.array(b), pa.array(zero if low is None else low), pa.array(zero if width is None else width)], names=["kind", "a", "b", "low", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # rows of the last key so far
        over = None  # the key whose rows are passed on
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(rows[0]):
                continue
            if over is not None:
                n = int(np.searchsorted(rows[0] != over, True)) if (rows[0] != over).any() else len(rows[0])
                if n:
                    yield out(1, *(r[:n] for r in rows))
                if n == len(rows[0]):
                    continue
                rows, over = [r[n:] for r in rows], None
            if kept:
                rows = [np.concatenate((k, r)) for k, r in zip(kept, rows)]
            last = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
            kept = [r[last:] for r in rows]
            if len(kept[0]) > held:
                over = kept[0][0]
                yield out(1, *kept)
                kept = []
            if last:
                yield from finish([r[:last] for r in rows])
        if kept:
            yield from finish(kept)

    def finish(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = rows[0]
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(edge, len(keys)))
        large = np.repeat(sizes > held, sizes)
        if large.any():
            yield out(1, *(r[large] for r in rows))
        several = np.repeat((sizes > 1) & (sizes <= held), sizes)
        if several.any():
            a, b = links_of_runs(keys[several], rows[1][several], distance)
            if len(a):
                pairs = np.unique(np.stack((a, b), axis=1), axis=0)
                yield out(0, pairs[:, 0].copy(), pairs[:, 1].copy())

    return run


def variants(rows: DataFrame) -> DataFrame:
    """The entries of each fingerprint: for both halves of its open bits, each with one bit left out."""

    def of(half: int):
        low, key, bits = F.col("low"), F.col("key"), F.col("print")
        out = []
        for side in (0, 1):
            at = low + side * half
            part = F.expr(f"shiftrightunsigned(print, low + {side * half})").bitwiseAND((1 << half) - 1)
            out += [F.struct(F.xxhash64(key, at, F.lit(bit), part.bitwiseAND(((1 << half) - 1) & ~(1 << bit))).alias("key"), bits.alias("print"), (low + (1 - side) * half).alias("low"), F.lit(half).alias("width")) for bit in range(half)]
        return F.explode(F.array(*out)).alias("v")

    half = rows.first()["width"] // 2
    return rows.select(of(half)).select("v.*")


def link(prints: DataFrame, fingerprint: str = "fingerprint", distance: int = DISTANCE, held: int = HELD) -> DataFrame:
    """Links (a, b), a < b, that connect the distinct fingerprints within distance.

    Chains of links join exactly what chains of pairs within distance would;
    not every such pair is a link. Without rows there are no links.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves serve distances up to 3")
    spark = prints.sparkSession
    rows = prints.select(F.lit(0).cast("long").alias("key"), F.col(fingerprint).alias("print"), F.lit(0).alias("low"), F.lit(64).alias("width"))
    found, made = None, []
    while not rows.isEmpty():
        spread = variants(rows).repartition("key").sortWithinPartitions("key")
        level = cut(spread.mapInArrow(compare(distance, max(held, 2048)), "kind int, a bigint, b bigint, low int, width int"))
        made.append(level)
        links = level.where("kind = 0").select("a", "b")
        found = links if found is None else found.union(links)
        rows = level.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("print"), "low", "width")
    if found is None:
        return spark.createDataFrame([], "a bigint, b bigint")
    out = cut(found.distinct())
    drop(*made)
    return out


def cluster(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row (key, fingerprint, component_id) for each row of df.

    component_id is the smallest key that chains of links reach. Rows without
    words share fingerprint 0 and link like any other; rows with equal keys
    each get a row. Null keys get a component too, and name one only where it
    holds nothing else. Other columns of df are left out.
    """
    docs = cut(add_fingerprint(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "fingerprint").select("key", "fingerprint"))
    firsts = cut(docs.groupBy("fingerprint").agg(F.min("key").alias("first")))
    links = link(firsts)
    stars = connect(links)  # (node, root) of linked fingerprints, roots left out
    linked = stars.select("node", "root").union(stars.select(F.col("root"), F.col("root")).distinct())
    named = cut(linked.join(firsts, F.col("node") == F.col("fingerprint")).groupBy("root").agg(F.min("first").alias("component_id")))
    members = cut(linked.join(named, "root").select("node", "component_id"))
    labels = cut(firsts.join(members, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id")))
    drop(links, stars, named, members)
    right = labels.select(F.col("fingerprint").alias("_f"), "component_id")
    return docs.join(right, F.col("fingerprint") == F.col("_f")).select(F.col("key").alias(key), "fingerprint", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    docs = cluster(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
