"""Gapless numbering inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.names import set_aside


def number_rows(df: DataFrame, group: list[str], block_of: list[str], order: list[Column], name: str, in_block: int = 1 << 20) -> DataFrame:
    """Adds the long column name: 0, 1, 2 ... in each group, without gaps.

    A group is dealt into blocks by a hash of the columns block_of, so that a
    group with a third of all rows is still ranked by many tasks; there are 64
    blocks, or more if blocks would hold over in_block rows. Each block
    then starts where the blocks before it end. The counts hold a row for
    each group and block. df is counted, then read twice, the
    first time only for the columns group and block_of. Rows equal in block_of share a block and are
    told apart by order; rows equal in that too are interchangeable. A column
    name of df is replaced.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    own = {"_in_block", "_in_rank", "_in_start", "_of_block", *keys}
    if own & {c.lower() for c in [*group, *block_of]}:
        raise ValueError("name the columns of groups and blocks otherwise")
    df, back = set_aside(df.select(*(c for c in df.columns if c.lower() != name.lower())), *own)
    blocks = max(64, -(-df.count() // in_block))
    block = F.pmod(F.xxhash64(*block_of), F.lit(blocks)).cast("int")
    start = Window.partitionBy(*(f"_g{i}" for i in range(len(group)))).orderBy("_of_block")
    starts = (
        df.select(*(F.col(c).alias(k) for c, k in zip(group, keys)), block.alias("_of_block"))
        .groupBy(*keys, "_of_block")
        .agg(F.count(F.lit(1)).alias("_in_n"))
        .withColumn("_in_start", F.sum("_in_n").over(start) - F.col("_in_n"))
        .drop("_in_n")
    )
    inside = Window.partitionBy(*group, "_in_block").orderBy(*order)
    ranked = df.withColumn("_in_block", block).withColumn("_in_rank", F.row_number().over(inside))
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(group, keys)]
    joined = ranked.join(starts, [*on, F.col("_in_block") == F.col("_of_block")])
    return back(joined.withColumn(name, F.col("_in_start") + F.col("_in_rank") - 1).drop(*own))
