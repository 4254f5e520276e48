"""Where the plans put their queries."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.adapters import with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_adapters(sql)
        return f

    return put


def stored(f):
    """Registers a function (spark, sf_dir) with the DuckDB SQL in the file of its name; a line `-- include x` stands for x.inc.sql."""
    QUERIES[f.__name__] = f
    SQL[f.__name__] = with_adapters(read_sql(f"{f.__name__}.sql"))
    return f


def read_sql(name: str) -> str:
    folder = Path(__file__).parent / "sql"
    lines = (folder / name).read_text(encoding="utf-8").splitlines()
    return "\n".join(read_sql(f"{line.split()[2]}.inc.sql") if line.startswith("-- include ") else line for line in lines)


def sql_of(name: str, sql: str) -> None:
    """DuckDB SQL for the rows of a query that another module registers."""
    SQL[name] = with_adapters(sql)
