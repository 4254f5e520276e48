"""Permit records: conflicts, exclusions and the funnel of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import digits


def first_reason(**checks: Column) -> Column:
    """The name of the first check that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(checks.items()):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def resolve(df: DataFrame, key: str, fields: list[str], phone: str) -> DataFrame:
    """One row for each key: its fields if its records agree, else conflicts, the names of fields that differ.

    Records equal in everything count once. Phones that differ in signs only
    agree; different numbers give no phone but no conflict either.
    """
    differs = [F.when(F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\x00"))) > 1, f) for f in fields]
    numbers = F.array_distinct(F.filter(F.collect_set(digits(F.col(phone))), lambda x: x != ""))
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("records"), F.concat_ws(",", *differs).alias("conflicts"), *[F.min(f).alias(f) for f in fields], numbers.alias("_p"))
    return out.withColumn(phone, F.when(F.size("_p") == 1, F.get("_p", F.lit(0)))).drop("_p")


def latest_record(df: DataFrame, key: str, updated: str, tie: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(updated), tie.desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def funnel(pairs: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """How many pairs pass the gates up to each one: rows (stage, gate, n)."""
    passed, counts = F.lit(True), []
    for gate, holds in gates.items():
        passed = passed & F.coalesce(holds, F.lit(False))
        counts.append(F.count_if(passed).alias(gate))
    row = pairs.agg(*counts)
    items = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(g).alias("gate"), F.col(g).alias("n")) for i, g in enumerate(gates)])
    return row.select(F.explode(items).alias("x")).select("x.*")


def quarantine_large_moves(moves: DataFrame, moved_m: str, large_m: float = 250.0, bound: int = 20) -> DataFrame:
    """Adds large and applied: if more rows than bound are large, none of them is applied."""
    large = F.col(moved_m) > large_m
    n = moves.agg(F.count_if(large).alias("_large"))
    return moves.crossJoin(F.broadcast(n)).withColumn("large", large).withColumn("applied", ~large | (F.col("_large") <= bound)).drop("_large")
