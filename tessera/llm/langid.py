"""Language of a text by error-correcting output codes over character n-grams.

Every language has a codeword of signs. For each bit a binary classifier tells
the languages of one sign from those of the other: its weight for an n-gram is
the logarithm of the ratio of the n-gram's mean shares on the two sides, and
its output the mean weight over a text, centred and scaled. A codeword's loss
sums those of its bits, each weighted by how reliably the bit was told for
that language on rows kept apart. The codeword of least loss wins; a text is
ambiguous if the next one is near.

Counts come from a sample of labelled rows, bounded for each language. They,
and so the model, have a fixed size: labels times buckets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.store import table

SPACE = 32
#: Characters that are weighed at once, whatever the length of a text.
CHUNK = 1 << 19
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """What is learnt and how it is decided.

    sample: about so many labelled rows of each language at most are learnt
    from; labels: more languages than that raise ValueError; buckets: a power
    of two, into which n-grams are hashed; order: their length in characters;
    steady: so many n-grams without weight are added to a text, so that short
    ones stay undecided; near: a second codeword within it is ambiguous; sure:
    how fast scores part with losses.
    """

    sample: int = 20_000
    labels: int = 256
    buckets: int = 1 << 15
    order: int = 3
    smoothing: float = 0.5
    most: float = 4.0
    steady: int = 20
    steep: float = 4.0
    near: float = 0.6
    sure: float = 3.0


def codewords(n: int) -> np.ndarray:
    """A row of signs for each of n languages, no column alike for all.

    Up to seven languages have all different ways to split them; more have
    rows of a Hadamard matrix, any two of which differ in half their places.
    """
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        ways = np.arange(2 ** (n - 1) - 1)  # the first language is always on the positive side
        rest = np.where(ways[None, :] >> np.arange(n - 1)[:, None] & 1, 1, -1)
        return np.vstack([np.ones(len(ways)), rest]).astype(np.int8)
    h = np.ones((1, 1), np.int8)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]]).astype(np.int8)
    h = h[:n]
    return h[:, np.abs(h.sum(axis=0)) < n]


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def hashed(texts: list[str | None], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, where each text's begin, letters of each text).

    Text is lower-cased, and each run of other characters than letters is one
    space, as are its beginning and its end.
    """
    pad = " " * settings.order
    low = [(t or "").lower() for t in texts]
    joined = np.frombuffer((pad + pad.join(low) + pad).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + settings.order
    edges = np.r_[0, np.cumsum(sizes)]
    letter = letters()[joined]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run that follows a letter
    # one space stands before a text, so that its first letter has a context
    keep[edges[:-1] + settings.order - 1] = True
    at = np.cumsum(keep) - keep
    x = np.where(letter, joined, SPACE)[keep].astype(np.uint32)
    n = len(x) - settings.order + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(low) + 1, np.int64), np.zeros(len(low), np.int64)
    h = np.zeros(n, np.uint32)
    for i in range(settings.order):
        h *= np.uint32(0x9E3779B1)
        h += x[i : i + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h >>= np.uint32(32 - settings.buckets.bit_length() + 1)
    starts = at[edges[:-1] + settings.order - 1]
    counts = np.add.reduceat(letter, edges[:-1], dtype=np.int64) if len(low) else np.zeros(0, np.int64)
    return h, np.r_[starts, len(x)], counts


def spans(starts: np.ndarray, order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the n-grams of each text reach; none of them crosses into the next text."""
    begin = np.minimum(starts[:-1], n)
    return begin, np.maximum(np.minimum(starts[1:] - order + 1, n), begin)


@dataclass
class Model:
    """languages; code (language, bit); weights (bucket, bit); centre and scale of bits; trust (language, bit)."""

    settings: Settings
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trust: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def raw(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums of weights by bit, n-grams, letters) of each text."""
        h, starts, counts = hashed(texts, self.settings)
        begin, end = spans(starts, self.settings.order, len(h))
        sums = np.zeros((len(texts), self.code.shape[1]))
        for a in range(0, len(h), CHUNK):
            b = min(a + CHUNK, len(h))
            w = self.weights[h[a:b]]
            some = np.flatnonzero((begin < b) & (end > a) & (begin < end))
            if len(some):
                cuts = np.stack([np.maximum(begin[some], a), np.minimum(end[some], b)], axis=1).ravel() - a
                inside = np.vstack([w, np.zeros((1, w.shape[1]), w.dtype)])
                sums[some] += np.add.reduceat(inside, cuts, axis=0)[::2]
        return sums, end - begin, counts

    def outputs(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The classifiers' outputs; the languages of a bit's sides lie around 1 and -1."""
        return (sums - n[:, None] * self.centre) / (n[:, None] + self.settings.steady) / self.scale

    def losses(self, f: np.ndarray) -> np.ndarray:
        """The weighted loss of each language for each text."""
        each = np.log1p(np.exp(-self.settings.steep * np.clip(f[:, None, :] * self.code[None], -20, 20)))
        return (self.trust[None] * each).sum(axis=2)

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[str | None], np.ndarray]:
        """(language, score, next language, ambiguous) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts), np.zeros(len(texts), bool)
        sums, n, counts = self.raw(texts)
        known = counts > 0
        if len(self.languages) == 1:
            return [self.languages[0] if k else UNKNOWN for k in known], known * 1.0, [None] * len(texts), ~known & False
        loss = self.losses(self.outputs(sums, n))
        order = np.argsort(loss, axis=1, kind="stable")
        one, two = order[:, 0], order[:, 1]
        rows = np.arange(len(texts))
        odds = np.exp(self.settings.sure * (loss[rows, one][:, None] - loss))
        score = np.where(known, 1 / odds.sum(axis=1), 0.0)
        close = known & (loss[rows, two] - loss[rows, one] < self.settings.near)
        name = lambda k, i: self.languages[i] if k else None
        return [name(k, i) or UNKNOWN for k, i in zip(known, one)], score, [name(k, i) for k, i in zip(known, two)], close


def bounded(df: DataFrame, key: str, label: str, settings: Settings) -> tuple[DataFrame, list[str]]:
    """About settings.sample rows of each label at most, chosen by a hash of key, and the labels in order."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().limit(settings.labels + 1).collect()}
    if len(counts) > settings.labels:
        raise ValueError(f"over {settings.labels} labels")
    share = F.lit(0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col(label) == name, int(2**30 * min(1, settings.sample / n))).otherwise(share)
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(2**30)) < share), sorted(counts)


def fit(df: DataFrame, key: str, text: str = "text", label: str = "lang", settings: Settings = Settings()) -> Model:
    """A model of the labels of df, a fifth of whose sample rows are kept apart for centres, scales and trust.

    Rows with a null key, text or label teach nothing. Without a row there are
    no languages, and every text is unknown.
    """
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (key, text, label)))
    sample, languages = bounded(rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l")), "k", "l", settings)
    apart = F.pmod(F.xxhash64("k", F.lit("apart")), F.lit(5)) == 0
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(settings, languages, code, np.zeros((settings.buckets, 0), np.float32))
    index = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(index), settings.buckets), np.int64)
        for part in slices(batches, 200):
            h, starts, _ = hashed(part["t"].to_pylist(), settings)
            begin, end = spans(starts, settings.order, len(h))
            for a, b, name in zip(begin, end, part["l"].to_pylist()):
                n[index[name]] += np.bincount(h[a:b], minlength=settings.buckets)
        which, bucket = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n[which, bucket])], names=["l", "bucket", "n"])

    counted = sample.where(~apart).select("t", "l").mapInArrow(count, "l int, bucket int, n bigint").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(languages), settings.buckets))
    n[counted["l"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    share = (n + settings.smoothing) / (n.sum(axis=1, keepdims=True) + settings.smoothing * settings.buckets)
    sides = [np.stack([share[code[:, j] == s].mean(axis=0) for j in range(code.shape[1])], axis=1) for s in (1, -1)]
    weights = np.clip(np.log(sides[0]) - np.log(sides[1]), -settings.most, settings.most).astype(np.float32)
    model = Model(settings, languages, code, weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 200):
            sums, grams, _ = model.raw(part["t"].to_pylist())
            mean = sums / np.maximum(grams, 1)[:, None]
            yield pa.RecordBatch.from_arrays([part["l"], pa.array(mean.tolist(), pa.list_(pa.float64()))], names=["l", "m"])

    # a row for each row kept apart: bounded by the sample
    held = sample.where(apart).select("t", "l").mapInArrow(measure, "l string, m array<double>")
    bits = [F.col("m")[j] for j in range(code.shape[1])]
    rows = held.groupBy("l").agg(*(F.percentile(b, 0.5).alias(f"c{j}") for j, b in enumerate(bits))).collect()
    middle = np.where(code > 0, 1.0, -1.0)
    for r in rows:
        middle[index[r.l]] = [r[f"c{j}"] for j in range(code.shape[1])]
    low, high = (np.array([f(middle[code[:, j] == s, j]) for j in range(code.shape[1])]) for f, s in ((np.max, -1), (np.min, 1)))
    model.centre, model.scale = (low + high) / 2, np.maximum((high - low) / 2, 1e-3)
    right = [F.avg(((b > float(model.centre[j])) == F.lit(True)).cast("double")).alias(f"p{j}") for j, b in enumerate(bits)]
    trust = np.full(code.shape, 0.5)
    for r in held.groupBy("l").agg(F.count(F.lit(1)).alias("n"), *right).collect():
        p = np.array([r[f"p{j}"] for j in range(code.shape[1])])
        trust[index[r.l]] = (np.where(code[index[r.l]] > 0, p, 1 - p) * r.n + 1) / (r.n + 2)
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def predict(df: DataFrame, model: Model, text: str = "text", out: str = "lang_found") -> DataFrame:
    """Adds the struct column out: lang, score, second and ambiguous.

    score is the share of the language among all, by the exponential of their
    losses. A null text and one without letters are UNKNOWN, with score 0 and
    no second language. Columns of df stay as they are; one named out is
    replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # labels times buckets, whatever the corpus

    @F.arrow_udf("struct<lang:string,score:double,second:string,ambiguous:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches, 200):
            lang, score, second, close = shared.value.decide(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(close, pa.bool_())], names=["lang", "score", "second", "ambiguous"])

    return df.withColumn(out, run(F.col(text)))


def held_out(key: Column) -> Column:
    """Whether a row is kept for testing: the CRC-32 of its key as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), "doc_id")
    found = predict(docs.select("doc_id", "text"), model, out="found")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.second", "found.ambiguous")
