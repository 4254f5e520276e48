"""Hard negatives of anchors, by ball trees over blocks of rows.

Rows and anchors are dealt into blocks by a hash, and every pair of blocks is
one task: it builds a ball tree over its rows and walks it for all of its
anchors at once. A ball with centre c and radius r holds inner products with
q from q.c - |q|r to q.c + |q|r, so a ball is left out for an anchor if that
interval misses the window of scores, or lies strictly beneath the anchor's
present k-th best. What blocks find is merged by score. A first pass finds
the positives, whose scores set the windows of the second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.store import cut, drop, table

#: Rows and anchors of a block; rows of a leaf.
ROWS, ASKED, LEAF = 4096, 16384, 64
#: Greatest size of a component, so that inner products of up to 2 ** 11 components fit into 64 bits.
LIMIT = 1 << 26
NONE = np.iinfo(np.int64).min


@dataclass
class Ball:
    """A node: its centre and radius, the one label of its rows if it is one, and its rows or its halves."""

    centre: np.ndarray
    radius: float
    label: int | None
    rows: np.ndarray | None = None
    halves: tuple[Ball, Ball] | None = None


def ball_tree(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Ball:
    """A tree over the rows of x, split at the median along the line through two distant rows."""

    def build(rows: np.ndarray) -> Ball:
        part = x[rows]
        centre = part.mean(axis=0)
        away = ((part - centre) ** 2).sum(axis=1)
        one = labels[rows[0]] if (labels[rows] == labels[rows[0]]).all() else None
        ball = Ball(centre, float(np.sqrt(away.max())), one)
        if len(rows) <= leaf or not away.max():
            ball.rows = rows
            return ball
        a = part[away.argmax()]
        b = part[((part - a) ** 2).sum(axis=1).argmax()]
        order = np.argsort(part @ (b - a), kind="stable")
        half = len(rows) // 2
        ball.halves = build(rows[order[:half]]), build(rows[order[half:]])
        return ball

    return build(np.arange(len(x)))


class Search:
    """The best k rows of each question: of one label or of all others, with scores in a window.

    q: vectors of the anchors; of: the anchor of each question; low and high:
    its window, ends included. Best rows are those of greatest score, then of
    least id. One walk serves all questions; each goes first into the half
    whose centre it likes more.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.ids, self.labels = ids, labels
        self.x = x.astype(np.float64)
        self.whole = x
        self.tree = ball_tree(self.x, labels, leaf)
        self.seen = 0

    def run(self, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), k of each for every question; scores NONE where there are fewer."""
        self.q, self.q_ids, self.q_labels, self.of, self.low, self.high, self.same, self.k = q, q_ids, q_labels, of, low, high, same, k
        self.qf = q.astype(np.float64)
        self.norm = np.sqrt((self.qf**2).sum(axis=1))
        most = float(np.abs(q).max(initial=0)) * float(np.abs(self.whole).max(initial=0)) * q.shape[1]
        self.exact = most < 2**53  # sums of doubles are then exact
        self.slack = 1e-9 * (1 + most)
        self.best = np.full((len(of), k), NONE)
        self.best_ids = np.full((len(of), k), np.iinfo(np.int64).max)
        self.visit(self.tree, np.arange(len(of)))
        return self.best, self.best_ids

    def visit(self, ball: Ball, asked: np.ndarray) -> None:
        if ball.label is not None:
            asked = asked[(self.q_labels[self.of[asked]] == ball.label) == self.same]
        if not len(asked):
            return
        who = self.of[asked]
        middle, reach = self.qf[who] @ ball.centre, self.norm[who] * ball.radius + self.slack
        asked = asked[(middle + reach >= self.low[asked]) & (middle - reach <= self.high[asked]) & (middle + reach >= self.best[asked, -1])]
        if not len(asked):
            return
        if ball.rows is not None:
            self.compare(ball.rows, asked)
            return
        left, right = ball.halves
        first = self.qf[self.of[asked]] @ (left.centre - right.centre) >= 0
        self.visit(left, asked[first])
        self.visit(right, asked[~first])
        self.visit(right, asked[first])
        self.visit(left, asked[~first])

    def compare(self, rows: np.ndarray, asked: np.ndarray) -> None:
        """Scores of the rows of a leaf, merged with the best so far."""
        who = self.of[asked]
        self.seen += len(rows) * len(asked)
        if self.exact:
            scores = (self.qf[who] @ self.x[rows].T).astype(np.int64)
        else:
            scores = self.q[who] @ self.whole[rows].T
        ok = (scores >= self.low[asked, None]) & (scores <= self.high[asked, None]) & (self.ids[rows] != self.q_ids[who, None])
        ok &= (self.labels[rows] == self.q_labels[who, None]) == self.same
        scores = np.hstack([self.best[asked], np.where(ok, scores, NONE)])
        ids = np.hstack([self.best_ids[asked], np.broadcast_to(self.ids[rows], ok.shape)])
        order = np.lexsort((ids, -np.maximum(scores, NONE + 1)), axis=1)[:, : self.k]
        self.best[asked] = np.take_along_axis(scores, order, axis=1)
        self.best_ids[asked] = np.take_along_axis(ids, order, axis=1)


def vectors(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each length."""
    lists = column.combine_chunks()
    flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()
    size = np.diff(ends)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, flat[ends[at][:, None] + np.arange(n)]


def of_blocks(same: bool, k: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The search as a function of a block of rows and a block of anchors."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        parts = []
        blocks = {x.shape[1]: (at, x) for at, x in vectors(rows["v"])}
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        q_ids, q_labels = asked["id"].to_numpy(), asked["label"].to_numpy()
        spans = asked["spans"].combine_chunks()
        low, high, span_ids = (spans.values.field(c).to_numpy() for c in ("low", "high", "id"))
        ends = spans.offsets.to_numpy()
        for at, q in vectors(asked["v"]):
            if q.shape[1] not in blocks:
                continue
            mine, x = blocks[q.shape[1]]
            search = Search(x, ids[mine], labels[mine])
            counts = np.diff(ends)[at]
            of = np.repeat(np.arange(len(at)), counts)
            span = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in at]) if counts.sum() else np.zeros(0, np.int64)
            scores, found = search.run(q, q_ids[at], q_labels[at], of, low[span], high[span], same, k)
            there = scores != NONE
            repeat = np.broadcast_to(np.arange(len(of))[:, None], there.shape)[there]
            parts.append((q_ids[at][of][repeat], span_ids[span][repeat], found[there], scores[there]))
        columns = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts) if parts else [()] * 4)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run


def best_rows(rows: DataFrame, asked: DataFrame, same: bool, k: int, row_blocks: int, asked_blocks: int) -> DataFrame:
    """(anchor, span, id, score, rank): the best k rows for each span (id, low, high) of asked (id, label, v, spans).

    Every pair of blocks is searched, so rows are sent once for each block of
    anchors and anchors once for each block of rows.
    """
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "label", "v", deal(row_blocks).alias("_r"), every(asked_blocks).alias("_q"))
    right = asked.select(*(F.col(c).alias(c) for c in ("id", "label", "v", "spans")), deal(asked_blocks).alias("_q"), every(row_blocks).alias("_r"))
    names = ["anchor", "span", "id", "score"]
    run = of_blocks(same, k, pa.schema([(c, pa.int64()) for c in names]))
    found = left.groupBy("_r", "_q").cogroup(right.groupBy("_r", "_q")).applyInArrow(run, ", ".join(f"{c} bigint" for c in names))
    order = Window.partitionBy("anchor", "span").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100)) -> DataFrame:
    """Hard negatives of the rows of df (id, label, v) for which anchors holds.

    id and label are whole numbers, v is a list of whole numbers. Rows are
    scored by their inner product with the anchor, higher first, ties by
    smaller id. Positives are an anchor's first rows of its label but itself.
    For each anchor and positive, the first rows of other labels come whose
    score lies within window, in hundredths of the positive's score, ends
    included: (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). Anchors without positives, and positives without such
    rows, give none; a positive's score below zero has an empty window.

    Rows with a null id, label or vector, a null component or one beyond
    LIMIT take no part. Of rows with one id the least by label and vector
    stays. Vectors of different lengths don't meet; those without components
    score 0. Further columns of df are dropped. The result is exact: nothing
    is left out but what bounds exclude.
    """
    usable = F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= LIMIT)), F.lit(False))
    rows = df.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable).select(F.col("id").cast("long").alias("id"), F.struct(F.col("label").cast("long").alias("label"), F.col("v").cast("array<int>").alias("v")).alias("_x"))
    rows = cut(rows.groupBy("id").agg(F.min("_x").alias("_x")).select("id", "_x.*"))
    asked = rows.where(anchors)
    row_blocks, asked_blocks = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // ASKED))
    wide = F.struct(F.lit(0).cast("long").alias("id"), F.lit(NONE + 1).alias("low"), F.lit(-NONE - 1).alias("high"))
    first = best_rows(rows, asked.withColumn("spans", F.array(wide)), True, positives, row_blocks, asked_blocks)
    first = cut(first.select(F.col("anchor").alias("id"), F.col("id").alias("positive"), "score"))
    down = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
    low, high = -down(-window[0] * F.col("score")), down(window[1] * F.col("score"))
    spans = first.groupBy("id").agg(F.collect_list(F.struct(F.col("positive").alias("id"), low.alias("low"), high.alias("high"))).alias("spans"))
    second = best_rows(rows, asked.join(spans, "id"), False, negatives, row_blocks, asked_blocks)
    score = first.select(F.col("id").alias("anchor"), F.col("positive").alias("span"), F.col("score").alias("positive_score"))
    out = second.join(score, ["anchor", "span"])
    out = cut(out.select(F.col("anchor").alias("anchor_id"), F.col("span").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    drop(rows, first)
    return out


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, some labels moved on by one."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < 1e15))
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform(x, lambda c: F.floor(256 * c.cast("double"))).alias("v"))
    return mine(rows, F.col("id") % 100 == 0)
