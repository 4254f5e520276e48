"""Rendezvous hashing of stable record keys over weighted shards.

Every shard scores every key and the best score wins. A score depends on the
key and its own shard alone, so a further shard takes rows only into itself
and a removed one gives up only its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.names import set_aside
from tessera.llm.ranks import number_rows
from tessera.llm.store import table

MASK = 0x7FFFFFFF
STEP = 0x1E3779B1
ODD1, ODD2 = 739982445, 695872825
MAX_SHARDS = 1 << 15
SHARDS = 40


def key_bits(key: Column) -> tuple[Column, Column]:
    """Two 31-bit numbers from the key's text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\x00")).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long").bitwiseAND(MASK)
    return part(1), part(9)


def score(h1: Column, h2: Column, shard: int) -> Column:
    """The 31-bit score that a shard gives a key."""
    x = h1.bitwiseXOR(F.lit((shard + 1) * STEP & MASK))
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(ODD1)).bitwiseAND(MASK)
    x = (x + h2).bitwiseAND(MASK)
    x = (x.bitwiseXOR(F.shiftright(x, 12)) * F.lit(ODD2)).bitwiseAND(MASK)
    return x.bitwiseXOR(F.shiftright(x, 15))


def assign(df: DataFrame, key: str, weights: int | Sequence[float], name: str = "shard") -> DataFrame:
    """Adds the int column name, the shard of each row.

    weights: the number of equal shards, or a positive weight for each. A
    shard's share of the keys follows its weight. A null key is a key like
    any other; rows with equal keys share a shard. Of equal scores the lower
    shard wins.
    """
    if key.lower() == "_k":
        raise ValueError("name the key otherwise")
    df, back = set_aside(df, "_k")
    return back(df.withColumn("_k", F.struct(*key_bits(F.col(key)))).withColumn(name, best(F.col("_k.col1"), F.col("_k.col2"), weights)).drop("_k"))


def best(h1: Column, h2: Column, weights: int | Sequence[float]) -> Column:
    n = weights if isinstance(weights, int) else len(weights)
    if not 1 <= n <= MAX_SHARDS:
        raise ValueError(f"1 to {MAX_SHARDS} shards are possible, not {n}")
    if not isinstance(weights, int):
        if min(weights) <= 0:
            raise ValueError("weights must be positive")
        if min(weights) < max(weights):
            timed = [F.struct((-F.log((score(h1, h2, i) + 0.5) / (MASK + 1.0)) / float(w)).alias("t"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
            return F.array_min(F.array(*timed)).getField("i")
    ranked = [score(h1, h2, i) * MAX_SHARDS + (MAX_SHARDS - 1 - i) for i in range(n)]
    top = F.greatest(*ranked) if n > 1 else ranked[0]
    return (F.lit(MAX_SHARDS - 1) - F.pmod(top, F.lit(MAX_SHARDS))).cast("int")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over SHARDS equal shards, by doc_id; law: key.

    Null texts have size 16 and checksum 0. Rows with one doc_id share a
    shard and get slots of their own.
    """
    raw = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    dealt = assign(assign(docs, "doc_id", SHARDS), "doc_id", SHARDS + 1, "grown_shard")
    numbered = number_rows(dealt, ["shard"], ["doc_id"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
