"""Quality rules on repetition: how much of a text lies in repeated pieces.

The words of a text become 64-bit numbers, a rolling polynomial hash turns
them into numbers for every window of n words, and windows whose number
occurs more than once mark the words that they cover. All of it is numpy
over one text at a time, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.names import set_aside
from tessera.llm.store import table

BASE = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits above which a text is rejected.

    coverage: for each window length in words, the greatest share of word
    characters that may lie in repeated windows; line_chars: the same for
    lines equal to an earlier one; symbols_per_word: of SYMBOLS. Short clean
    texts that quote one passage twice reach shares near 0.28.
    """

    min_words: int = 50
    repeat_words_percent: int = 50
    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30})
    line_chars: float = 0.30
    symbols_per_word: float = 0.1


RULES = Rules()
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def words_of(text: str) -> list[str]:
    """Runs of characters other than space and U+0009 to U+000D."""
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A number for each window of n of the numbers h, by Horner's rule."""
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= BASE
        out += h[i : len(h) - n + 1 + i]
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the numbers that occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    mark = np.zeros(len(keys), bool)
    mark[order[1:][same]] = True
    mark[order[:-1][same]] = True
    return mark


def covered(mark: np.ndarray, n: int, size: int) -> np.ndarray:
    """Marks the words that lie in a marked window of n words."""
    edge = np.zeros(size + 1, np.int32)
    edge[: len(mark)] += mark
    edge[n : n + len(mark)] -= mark
    return np.cumsum(edge[:size]) > 0


def measure(text: str | None, lengths: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """FIELDS, and the characters covered for each window length."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    chars = int(sizes.sum())
    seen: set[str] = set()
    dup = dup_chars = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                inside = words_of(line)
                if inside:
                    dup += 1
                    dup_chars += sum(map(len, inside))
            else:
                seen.add(line)
    n_repeat, spans = 0, []
    for k in (3, *lengths):
        mark = repeated(windows(h, k)) if n > k else None
        if mark is None or not mark.any():
            if k != 3:
                spans.append(0)
            continue
        inside = covered(mark, k, n)
        if k == 3:
            n_repeat = int(inside.sum())
        else:
            spans.append(int(sizes[inside].sum()))
    symbols = sum(map(text.count, SYMBOLS))
    return [n, chars, symbols, dup, n_repeat, dup_chars], spans


def judge(df: DataFrame, text: str = "text", rules: Rules = RULES, out: str = "quality") -> DataFrame:
    """Adds the struct column out: FIELDS, coverage, base_failed and kept.

    coverage holds the share of word characters in repeated windows, for each
    length in rules.coverage. A null text has no words. A text without words
    is rejected by min_words. Words that occur alike in a text count once for
    each place. Columns of df stay as they are; one named out is replaced.
    """
    lengths = tuple(sorted(rules.coverage))
    limits = [rules.coverage[k] for k in lengths]

    @F.arrow_udf("struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ",coverage:array<double>,base_failed:boolean,kept:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            rows, shares, failed, kept = [], [], [], []
            for t in texts:
                row, spans = measure(t.as_py(), lengths)
                share = [s / row[1] if row[1] else 0.0 for s in spans]
                bad = row[0] < rules.min_words or 100 * row[4] > rules.repeat_words_percent * row[0]
                good = not bad and row[2] <= rules.symbols_per_word * row[0] and row[5] <= rules.line_chars * row[1] and all(s <= m for s, m in zip(share, limits))
                rows.append(row)
                shares.append(share)
                failed.append(bad)
                kept.append(good)
            cols = np.array(rows, np.int64).reshape(len(rows), len(FIELDS))
            yield pa.StructArray.from_arrays(
                [*(pa.array(cols[:, i]) for i in range(len(FIELDS))), pa.array(shares, pa.list_(pa.float64())), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                names=[*FIELDS, "coverage", "base_failed", "kept"],
            )

    return df.withColumn(out, run(F.col(text)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict under RULES."""
    docs = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), out="q")
    return docs.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept")


def filter_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep."""
    safe, back = set_aside(docs, "_quality")
    return back(judge(safe, out="_quality").where("_quality.kept").drop("_quality"))
