"""Columns of the caller's out of the way of an operator's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def set_aside(df: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns renamed that an operator's own names would clash with, and what gives them their names again.

    Names clash without regard to letter case, as they do to the engine.
    """
    taken = {c.lower() for c in df.columns} | {c.lower() for c in own}
    mine = {c.lower() for c in own}
    aside = {}
    for c in df.columns:
        if c.lower() in mine:
            new = f"{c}_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            aside[c] = new
    if not aside:
        return df, lambda out: out
    return df.withColumnsRenamed(aside), lambda out: out.withColumnsRenamed({new: c for c, new in aside.items()})
