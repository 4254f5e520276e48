"""Data sources for interfaces that give their rows page by page, within a budget of calls, and pages kept as they come."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.artifacts import create, exists, remove
from tessera.sources.outputs import canonical_json, write_text

#: Seconds that an interface may ask to wait, at most, and the wait before the first retry without its word.
LONGEST_WAIT, FIRST_WAIT = 30.0, 0.05


class Throttled(OSError):
    """An interface asks to be called again later, after so many seconds if it says."""

    def __init__(self, retry_after: float | None = None):
        super().__init__("called too often")
        self.retry_after = retry_after


class BudgetSpent(RuntimeError):
    """No call is left."""


class PagedSource(DataSource):
    """spark.read.format("paged") over a function fetch(page, size) -> (total, rows as dicts).

    Options: fetch, as module:function, which executors must be able to
    import; size, rows of a page; retries. Each page is a partition of its
    own. A page with fewer rows than the total promises is an error.

    budget bounds the calls of all partitions together: one tells the total,
    every page has one, and what is left is divided between them for
    retries. Too small a budget is an error before the first page. A task that
    Spark runs again has no calls unless attempts says how many times a page's
    share is divided. pages are the first and last wanted, as "3-7".
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class MeteredSource(PagedSource):
    """As PagedSource, with the column calls: how many a page has taken."""

    @classmethod
    def name(cls) -> str:
        return "metered"

    def schema(self) -> str:
        return "page int, row string, calls int"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options, True)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], metered: bool = False, sleep: Callable[[float], None] = time.sleep):
        self.fetch_name, self.size, self.retries = options["fetch"], int(options.get("size", 100)), int(options.get("retries", 3))
        self.budget = int(options["budget"]) if "budget" in options else None
        self.attempts, self.pages = int(options.get("attempts", 1)), options.get("pages")
        self.metered, self.sleep = metered, sleep
        if self.retries < 1 or self.attempts < 1:
            raise ValueError("retries and attempts must be positive")

    def fetch(self, page: int, calls: int | None = None) -> tuple[int, list[dict], int]:
        """The total, a page's rows, and the calls that it took; calls bounds them."""
        module, _, name = self.fetch_name.partition(":")
        call = getattr(importlib.import_module(module), name)
        most = self.retries if calls is None else min(self.retries, calls)
        for attempt in range(most):
            try:
                return *call(page, self.size), attempt + 1
            except OSError as e:
                if attempt + 1 == self.retries:
                    raise
                if attempt + 1 < most:
                    asked = getattr(e, "retry_after", None)
                    self.sleep(FIRST_WAIT * 2**attempt if asked is None else min(max(0.0, asked), LONGEST_WAIT))
        raise BudgetSpent(f"no call is left for page {page}")

    def partitions(self) -> list[InputPartition]:
        total, _, used = self.fetch(0, self.budget)
        first, last = 0, -(-total // self.size) - 1
        if self.pages:
            low, high = map(int, self.pages.split("-"))
            first, last = max(first, low), min(last, high)
        n = max(0, last - first + 1)
        share = None
        if self.budget is not None:
            if self.budget - used < n * self.attempts:
                raise BudgetSpent(f"{n} pages need more than the {self.budget - used} calls that are left")
            share = (self.budget - used) // n // self.attempts if n else 0
        return [InputPartition((p, min(self.size, total - p * self.size), share)) for p in range(first, last + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, expected, share = partition.value
        task = TaskContext.get()
        if share is not None and task and task.attemptNumber() >= self.attempts:
            raise BudgetSpent(f"page {page} has used its calls")
        _, rows, calls = self.fetch(page, share)
        if len(rows) != expected:
            raise ValueError(f"page {page} has {len(rows)} rows, not {expected}")
        for r in rows:
            row = json.dumps(r, sort_keys=True, ensure_ascii=False)
            yield (page, row, calls) if self.metered else (page, row)


def fetch_into(spark: SparkSession, path: str, fetch: str, size: int = 100, budget: int | None = None, per_round: int = 50, **options: str) -> DataFrame:
    """Rows (page, row, calls) of all pages, kept below path as they come, so that a later call goes on where this one stopped.

    Pages are fetched in rounds, each written as a whole; the manifest says
    what was asked for and which rounds are there. Another interface, size or
    total than the manifest's is an error, as is a round that it doesn't know.
    budget bounds the calls of this run over all rounds; when it is spent,
    BudgetSpent is raised and the rounds so far stay.
    """
    spark.dataSource.register(MeteredSource)
    probe = PagedReader({"fetch": fetch, "size": str(size)} | options)
    total, _, used = probe.fetch(0, budget)
    head = {"fetch": fetch, "size": size, "total": total, "per_round": per_round}
    manifest_path = f"{path}/manifest.json"
    done: list[int] = []
    if exists(spark, manifest_path):
        held = json.loads(spark.read.text(manifest_path, wholetext=True).first()[0])
        if {k: held.get(k) for k in head} != head:
            raise ValueError(f"the manifest is of {held}, not {head}")
        done = held["rounds"]
    else:
        create(spark, manifest_path, canonical_json(head | {"rounds": []}))
    left = None if budget is None else budget - used
    schema = "page int, row string, calls int"
    for first in range(0, -(-total // size), per_round):
        if first in done:
            continue
        target = f"{path}/round={first}"
        remove(spark, target)  # of a run that ended before its manifest
        reader = spark.read.format("metered").options(fetch=fetch, size=size, pages=f"{first}-{first + per_round - 1}", **options)
        try:
            (reader if left is None else reader.option("budget", left)).load().write.parquet(target)
        except Exception as e:
            remove(spark, target)
            if "BudgetSpent" in str(e):
                raise BudgetSpent("the budget of calls is spent") from e
            raise
        taken = spark.read.schema(schema).parquet(target).groupBy("page").agg(F.max("calls").alias("n")).agg(F.sum("n")).first()[0]
        left = None if left is None else left - taken - 1  # each round asks for the total once
        done = [*done, first]
        write_text(spark, manifest_path, canonical_json(head | {"rounds": done}))
    return spark.read.schema(schema).parquet(*[f"{path}/round={r}" for r in done]) if done else spark.createDataFrame([], schema)
