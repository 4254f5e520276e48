"""Homomorphic multiset hashes of documents, in SQL operations only.

A text's paragraphs are its lines. Each is hashed into a wide vector, and a
fingerprint is the sum of the vectors, lane by lane, modulo 2 ** 60. So the
order of paragraphs doesn't matter, fingerprints of two texts add up to that
of both, and a paragraph is inserted or deleted by adding or subtracting its
vector.

A paragraph's vector has STRONG lanes of its SHA-512, which tell multisets of
paragraphs apart, and a profile of its sentences: their number, and for each
of COUNTERS bits of a sentence's hash the number of sentences that have it.
Over many bits, how far the counters lean to either side tells how much two
texts share, in the way of a tug of war, also where a paragraph was changed
in part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.names import set_aside
from tessera.llm.store import cut, drop, table

BITS = 60
MASK = (1 << BITS) - 1
#: A lane of the profile holds two counters of 30 bits, which a text of under a gigabyte can't overflow.
STRONG, HASHES, GAP = 8, 2, 30
PAIR = 1 | 1 << GAP
COUNTERS = 2 * HASHES * GAP
LANES = STRONG + 1 + HASHES * GAP
#: Where a paragraph is cut into sentences: at spaces after the end of one.
CUT = r"(?<=[.!?]) "
#: Documents in a block if ids are spread evenly, blocks in a row of blocks as a power of two, and parts of the ids in the densest of which blocks are that large.
IN_BLOCK, ROW_BITS, PARTS = 128, 12, 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(text: Column) -> Column:
    """The array<long> of LANES lanes; a null text is empty, and an empty one has one empty paragraph."""

    def summed(rows: Column, part: Callable[[Column], Column]) -> Column:
        return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, x: (acc + part(x)).bitwiseAND(MASK))

    def number(digest: Column, lane: int) -> Column:
        return F.conv(F.substring(digest, lane * BITS // 4 + 1, BITS // 4), 16, 10).cast("long")

    def lanes(v: Column) -> Column:
        strong = [summed(v.digests, lambda d, i=i: number(d, i)) for i in range(STRONG)]
        profile = [summed(v[f"h{i}"], lambda h, j=j: F.shiftright(h, j).bitwiseAND(PAIR)) for i in range(HASHES) for j in range(GAP)]
        return F.array(*strong, F.size(v.h0).cast("long"), *profile)

    def hashed(paragraphs: Column) -> Column:
        sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, CUT)))
        digests = F.transform(paragraphs, lambda p: F.sha2(p.cast("binary"), 512))
        seeded = lambda i: lambda u: F.xxhash64(F.lit(i), u)
        return let(sentences, lambda s: let(F.struct(digests.alias("digests"), *(F.transform(s, seeded(i)).alias(f"h{i}") for i in range(HASHES))), lanes))

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), hashed)


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(MASK))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of a without the paragraphs of b, all of which it must hold."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(MASK))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the estimated cosine of two texts' sentences; 1 for equal fingerprints.

    Its error is about one by the root of COUNTERS. A text of which half is
    replaced by another's keeps near 0.5 of its sentences.
    """

    def leaning(f: Column) -> Column:
        lanes = F.slice(f, STRONG + 2, HASHES * GAP)
        n = F.get(f, F.lit(STRONG))
        return F.flatten(F.transform(lanes, lambda x: F.array(*(2.0 * F.shiftright(x, GAP * k).bitwiseAND((1 << GAP) - 1) - n for k in range(2)))))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def cosine(v: Column) -> Column:
        size = F.sqrt(dot(v.x, v.x) * dot(v.y, v.y))
        return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(v.x, v.y) / size)))

    return F.when(a == b, 1.0).otherwise(let(F.struct(leaning(a).alias("x"), leaning(b).alias("y")), cosine))


def hexes(f: Column) -> Column:
    """The lanes as text, 15 hexadecimal digits each."""
    return F.array_join(F.transform(f, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def successors(blocks: DataFrame) -> DataFrame:
    """(_block, _before) for distinct longs _block: each with the one before it, the first with the last; a written table.

    Blocks are put into rows of blocks, and only where there are over
    2 ** ROW_BITS of those, the rows into rows of rows, so that no window
    spans more than so many.
    """
    rows = blocks.withColumn("_row", F.shiftright("_block", ROW_BITS))
    inside = cut(rows.withColumn("_to", F.lead("_block").over(Window.partitionBy("_row").orderBy("_block"))))
    starts = cut(inside.groupBy("_row").agg(F.min("_block").alias("_b")))
    if starts.count() <= 1 << ROW_BITS:
        whole = Window.orderBy("_row")
        ahead = starts.select(F.col("_row").alias("_r"), F.coalesce(F.lead("_b").over(whole), F.first("_b").over(whole)).alias("_ahead"))
    else:
        above = successors(starts.select(F.col("_row").alias("_block")))
        ahead = above.join(starts, F.col("_block") == F.col("_row")).select(F.col("_before").alias("_r"), F.col("_b").alias("_ahead"))
    made = cut(inside.join(ahead, F.col("_row") == F.col("_r")).select(F.coalesce("_to", "_ahead").alias("_block"), F.col("_block").alias("_before")))
    drop(inside, starts)
    return made


def with_next(df: DataFrame, key: str, order: list[str], ride: list[str]) -> DataFrame:
    """Adds the struct column next: the columns ride of the next row by key, then order; the last row's is the first.

    key is a whole number. Rows are dealt into blocks of neighbouring keys and
    each block is sorted by itself; only the first row of a block travels to
    the block before. The width of blocks follows from where the keys are
    densest, by PARTS quantiles: far outliers get blocks of their own, and no
    block holds much more than IN_BLOCK rows or else a PARTS-th of all. Null
    keys come first, in one block; rows with equal keys share one. A column
    next of df is replaced.
    """
    names = [c for c in df.columns if c.lower() != "next"]
    used = {"_at", "_block", "_first", "_head"}
    if used & {c.lower() for c in [key, *order, *ride]}:
        raise ValueError("name the key and what goes with it otherwise")
    df, back = set_aside(df.select(*names), *used)
    at = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    cuts, n = df.where(F.col(key).isNotNull()).agg(F.percentile_approx(F.col(key).cast("long"), [i / PARTS for i in range(PARTS + 1)], 100 * PARTS), F.count(F.lit(1))).first()
    gaps = [b - a for a, b in zip(cuts, cuts[1:]) if b > a] if n else []
    width = max(1, min(gaps) * PARTS * IN_BLOCK // n) if gaps else 1
    shift = min(62, (width - 1).bit_length())
    rows = df.withColumn("_at", at).withColumn("_block", F.shiftright("_at", shift))
    jumps = successors(rows.select("_block").distinct())

    line = Window.partitionBy("_block").orderBy("_at", *order)
    ranked = rows.withColumn("next", F.lead(F.struct(*ride)).over(line)).withColumn("_first", F.row_number().over(line) == 1)
    heads = ranked.where("_first").select("_block", F.struct(*ride).alias("_head")).join(jumps, "_block").select(F.col("_before").alias("_block"), "_head")
    ends = ranked.where("next IS NULL").join(heads, "_block").withColumn("next", F.col("_head"))
    kept = [*df.columns, "next"]
    return back(ranked.where("next IS NOT NULL").select(*kept).union(ends.select(*kept)))


def op7_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and likeness to an edited text and to the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("f", fingerprint(F.col("text"))), "doc_id", ["text"], ["text", "f"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next.text").substr(F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("e", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hexes(F.col("f")).alias("fingerprint"),
        hexes(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"),
        likeness(F.col("f"), F.col("next.f")).alias("near_next"),
    )
