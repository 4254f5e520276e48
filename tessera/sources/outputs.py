"""Sinks: canonical JSON, CSV with fixed decimals, Markdown, and upserts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import _fs


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, no characters escaped that needn't be; numbers that JSON doesn't have are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one piece: written beside path, then renamed over what is there, so that a reader meets the old file or the new one."""
    fs, at = _fs(spark, path)
    _, part = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(part), fs.makeQualified(at), over)


def fixed(number: Column, places: int) -> Column:
    """A number as text with so many decimals, half away from zero; null stays null."""
    return F.round(number, places).cast(f"decimal(38,{places})").cast("string")


def write_csv(df: DataFrame, path: str, decimals: Mapping[str, int], order: Sequence[str]) -> None:
    """CSV files in the order given, with a header each and fixed decimals; nulls are empty."""
    cols = [fixed(F.col(c), decimals[c]).alias(c) if c in decimals else F.col(c) for c in df.columns]
    df.orderBy(*order).select(*cols).write.option("header", True).csv(path)


def markdown_table(df: DataFrame, order: Sequence[str], most: int = 1000) -> str:
    """A table of a report of at most so many rows; more are an error, as a report isn't for them."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["-"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current with the rows of changes in place of those with equal keys; a key twice in changes is an error.

    A null in a key equals a null. One full join on the keys; write the result
    beside current and swap them, or merge by partition.
    """
    again = changes.groupBy(*keys).count().where("count > 1").limit(1)
    checked = changes.crossJoin(F.broadcast(again.agg(F.count(F.lit(1)).alias("_again"))))
    fail = F.raise_error(F.lit("a key occurs twice")).cast("boolean")
    checked = checked.where(F.when(F.col("_again") == 0, F.lit(True)).otherwise(fail)).drop("_again")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = current.withColumn("_old", F.lit(True)).alias("a").join(checked.withColumn("_new", F.lit(True)).alias("b"), on, "full")
    return both.select(*[F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in current.columns])
