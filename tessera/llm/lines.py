"""Line deduplication over a whole corpus by a deletion-neighbourhood join.

Two lines are one word apart if a word inserted, left out or replaced makes
one the other. Then they share a variant: one line, or it less a word. All
variants of a line are emitted as 64-bit keys and equal keys meet. Lines that
lost the word at one place, and a line that is the variant as it is, are all
one word apart from each other, so such a meeting is kept as a group of
lines, not as pairs, and verified on the words against its first.

The earliest line stays. Groups are settled in that order: a line stays if it
is the first in all its groups, lines that share a group with one that stays
go, and so on with what is left. So each line that goes is one word apart
from a line that stays, and no two lines that stay are.

Two steps come before, both exact. Equal lines are one class, found by an
aggregation over 128 bits of hashes. And only lines that share their first or last half with another
enter the join: one edit leaves one of the halves whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.names import set_aside
from tessera.llm.store import cut, drop, table

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Bounds:
    """min_words: shorter lines always stay. near_words: words for each that an edit may change.

    The edit bound follows the length: lines of under near_words words have a
    bound of 0 and go only as exact repeats; longer ones have a bound of 1, so
    near lines differ in one word of five at most. near_words=1 gives a bound
    of 1 to every line.
    """

    min_words: int = 1
    near_words: int = 5


BOUNDS = Bounds()
#: A variant is frequent if it holds over so many rows and over a SHARE-th of all, so there are fewer than SHARE frequent ones.
FREQUENT, SHARE = 10_000, 1 << 16
#: One line of so many is spelled to find frequent variants.
PART = 16


def sums(words: list[bytes]) -> np.ndarray:
    """The polynomial in BASE over the words' hashes: its prefix sums, 0 first."""
    n = len(words)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    powers = np.full(n, BASE, np.uint64)
    if n:
        powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * powers)))


def signed(x: int) -> int:
    return (x & MASK) - (1 << 64) if x & (1 << 63) else x & MASK


def halves(words: list[bytes]) -> list[int]:
    """Keys for the first and last halves of n words, of n // 2 and (n - 1) // 2 words.

    One edit leaves a half whole: of the shorter line's (n - 1) // 2 words or
    the longer one's as many. A tail's key doesn't depend on its place.
    """
    n, digest = len(words), xxhash.xxh64_intdigest
    out = set()
    for k in {n // 2, (n - 1) // 2}:
        out.add(signed(digest(b" ".join(words[:k]), 2 * k)))
        out.add(signed(digest(b" ".join(words[n - k :]), 2 * k + 1)))
    return sorted(out)


def variants(words: list[bytes]) -> np.ndarray:
    """Keys of the words as they are, then less the first, less the second and so on."""
    prefix = sums(words)
    after = (prefix[-1] - prefix[1:]) * np.uint64(INVERSE)
    return np.concatenate((prefix[-1:], prefix[:-1] + after)).view(np.int64)


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether the word edit distance is one or none."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :]


def explode_lines(bounds: Bounds):
    """For mapInArrow over (_k, doc_id, text): a row for each line with min_words words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, ids, nos, wholes, checks, half = [], [], [], [], [], []
            for k, d, text in zip(*(batch.column(i) for i in range(3))):
                raw = (text.as_py() or "").encode()
                lines = [(no, w) for no, line in enumerate(raw.split(b"\n")) if len(w := line.split()) >= bounds.min_words]
                if not lines:
                    continue
                keys += [k.as_py()] * len(lines)
                ids += [d.as_py()] * len(lines)
                for no, words in lines:
                    nos.append(no)
                    joined = b" ".join(words)
                    wholes.append(signed(xxhash.xxh64_intdigest(joined, 7)))
                    checks.append(signed(xxhash.xxh64_intdigest(joined, 11)))
                    half.append(halves(words) if len(words) >= bounds.near_words else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(wholes, pa.int64()), pa.array(checks, pa.int64()), pa.array(half, pa.list_(pa.int64()))],
                names=["_k", "doc_id", "line_no", "h1", "h2", "halves"],
            )

    return run


def take_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (_k, doc_id, text, line_no, whole), the last two arrays: a row for each line named."""
    for batch in batches:
        rows = []
        for k, d, text, nos, wholes in zip(*(batch.column(i).to_pylist() for i in range(5))):
            lines = text.split("\n")
            rows += [(w, d, k, no, lines[no]) for no, w in zip(nos, wholes)]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["whole", "doc_id", "_k", "line_no", "line"])


def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (whole, doc_id, _k, line_no, line): all variants of each line; place -1 is the line itself."""
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        made = [variants(line.encode().split()) for line in cols[4]]
        n = [len(m) for m in made]
        rep = [np.repeat(np.array(c, np.int64), n) for c in cols[:4]]
        place = np.concatenate([np.arange(-1, x - 1) for x in n]) if n else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(made) if made else np.empty(0, np.int64)), pa.array(place.astype(np.int32)), *(pa.array(r) for r in rep)],
            names=["variant", "place", "whole", "doc_id", "_k", "line_no"],
        )


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (variant, place, whole, doc_id, _k, line_no) sorted by variant and place, then when: the rows of groups.

    A group is of one place of a variant, with the line that is the variant
    as it is, which has place -1 and so comes first; g numbers it. A row
    stands in the group of its place, the line as it is in each of them.
    Rows are passed on as they come; only the last are held.
    """
    key = place = itself = held = None
    rows: list[tuple] = []
    g = 0

    for batch in batches:
        keys = batch.column(0).to_numpy()
        n = len(keys)
        if not n:
            continue
        same = np.zeros(n, bool)
        same[1:] = keys[1:] == keys[:-1]
        same[:-1] |= same[1:]
        same[0] = same[-1] = True  # the batches next to this one may go on with these
        wanted = batch.take(pa.array(np.flatnonzero(same)))
        for variant, at, *row in zip(*(wanted.column(i).to_pylist() for i in range(6))):
            if variant != key:
                key, place, itself = variant, None, None
            if at < 0:
                itself = itself or row
                continue
            if at != place:
                # the first of its place waits until another joins it
                place, held, g = at, row, group(variant, at)
                if itself:
                    rows += [(g, *itself), (g, *held)]
                    held = None
                continue
            if held:
                rows.append((g, *held))
                held = None
            rows.append((g, *row))
        yield members(rows)
        rows = []


MEMBERS = "g bigint, whole bigint, doc_id bigint, _k bigint, line_no bigint"


def members(rows: list[tuple]) -> pa.RecordBatch:
    m = np.array(rows, np.int64).reshape(len(rows), 5)
    return pa.RecordBatch.from_arrays([pa.array(m[:, i].copy()) for i in range(5)], names=[c.split(" ")[0] for c in MEMBERS.split(", ")])


def frequent_variants(held: DataFrame, most: int = FREQUENT) -> list[int]:
    """Variants that over most lines show, as far as one line of PART tells. Results don't depend on them."""
    part = held.where(F.pmod(F.xxhash64("whole"), F.lit(PART)) == 0)
    counts = cut(part.mapInArrow(spell, "variant bigint, place int, whole bigint, doc_id bigint, _k bigint, line_no bigint").groupBy("variant").count())
    n = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("count") > max(most / PART, n / SHARE)).select("variant").collect()]
    drop(counts)
    return sorted(hot)


def spread(hot: list[int]):
    """For mapInArrow over (whole, doc_id, _k, line_no, line): the rows of groups of frequent variants, which need not meet.

    A line that is such a variant as it is stands in the groups of all places
    that a longer line could have lost a word at. Groups of one line change
    nothing.
    """
    wanted = np.array(hot, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *row, line in zip(*(batch.column(i).to_pylist() for i in range(5))):
                made = variants(line.encode().split())
                for i in np.flatnonzero(np.isin(made, wanted)).tolist():
                    places = [i - 1] if i else range(len(made))
                    rows += [(group(int(made[i]), at), *row) for at in places]
            yield members(rows)

    return run


def group(variant: int, place: int) -> int:
    return signed(xxhash.xxh64_intdigest(b"%d %d" % (variant, place)))


def verified(groups: DataFrame, held: DataFrame) -> DataFrame:
    """The rows (g, whole, when) of groups whose line is one word apart from the first of its group, and the first itself; a written table."""

    @F.arrow_udf("boolean")
    def apart(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([one_edit(x.as_py().encode().split(), y.as_py().encode().split()) for x, y in zip(a, b)], pa.bool_())

    rows = groups.select("g", "whole", F.struct("doc_id", "_k", "line_no").alias("when"))
    firsts = cut(rows.groupBy("g").agg(F.min(F.struct("when", "whole")).alias("f")).select("g", F.col("f.whole").alias("of")))
    words = cut(held.groupBy("whole").agg(F.min("line").alias("line")))  # written, so that a join on a frequent line can be split
    pairs = rows.join(firsts, "g").join(words, "whole").join(words.select(F.col("whole").alias("of"), F.col("line").alias("first_line")), "of")
    sure = cut(pairs.where((F.col("whole") == F.col("of")) | apart("line", "first_line")).select("g", "whole", "when"))
    drop(firsts, words)
    return sure


def settle(groups: DataFrame) -> DataFrame:
    """Rows (whole, near) of classes that go, near the place of one that stays; groups has rows (g, whole, when). A written table.

    Each round decides the classes that are the first in all their groups, and
    with them all who share a group with them; the rest goes on without both.
    The first of all is decided in any round, so it ends; rounds follow the
    longest chain of lines each one word apart from the one before, in order.
    """
    gone: list[DataFrame] = []
    left = groups
    while not left.isEmpty():
        firsts = cut(left.groupBy("g").agg(F.min("when").alias("first")))
        placed = left.join(firsts, "g")
        stay = cut(placed.groupBy("whole").agg(F.bool_and(F.col("when") == F.col("first")).alias("stays")).where("stays").select("whole"))
        settled = left.join(stay, "whole", "left_semi").select("g", F.col("when").alias("near"), F.col("whole").alias("by"))
        go = cut(left.join(settled, "g").where(F.col("whole") != F.col("by")).groupBy("whole").agg(F.min("near").alias("near")))
        done = stay.union(go.select("whole"))
        after = cut(left.join(done, "whole", "left_anti"))
        gone.append(go)
        drop(firsts, stay, *([left] if left is not groups else []))
        left = after
    if not gone:
        return groups.select("whole", F.col("when").alias("near")).limit(0)
    out = gone[0]
    for more in gone[1:]:
        out = out.union(more)
    made = cut(out)
    drop(*gone, left)
    return made


def find(df: DataFrame, bounds: Bounds = BOUNDS) -> DataFrame:
    """Lines of (doc_id long, text) that repeat an earlier one; a written table.

    Rows: _k (the document row, a hash of doc_id and text), doc_id, line_no
    from 0, kind (exact or near), keeper_doc_id, keeper_line_no. Earlier means
    a smaller doc_id, then hash, then line; a null doc_id comes first and is
    given as the smallest long. exact:
    the words are those of an earlier line, white space aside. near: the first
    line with its words is one word apart from the keeper, the earliest such
    line that stays; an exact repeat of it goes with it. Lines without min_words words never appear, and rows equal in
    doc_id and text are one document, all of whose copies share its lines'
    fate. A null text has no lines.
    """
    docs = df.select(F.xxhash64("doc_id", "text").alias("_k"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("text"))
    lines = cut(docs.mapInArrow(explode_lines(bounds), "_k bigint, doc_id bigint, line_no int, h1 bigint, h2 bigint, halves array<bigint>"))
    when = F.struct("doc_id", "_k", "line_no")
    # a class is a line by 128 bits of hashes; once written, its number names it
    classes = lines.groupBy("h1", "h2").agg(F.min(when).alias("first"), F.max(when).alias("last"), F.first("halves").alias("halves"))
    classes = cut(classes.withColumn("whole", F.monotonically_increasing_id()))

    half = cut(classes.where("halves IS NOT NULL").select("whole", F.explode("halves").alias("half")))
    shared = cut(half.groupBy("half").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("half"))
    suspects = cut(half.join(shared, "half", "left_semi").select("whole").distinct())
    places = classes.join(suspects, "whole", "left_semi").select("whole", "first.*")
    by_doc = cut(places.groupBy("_k", "doc_id").agg(F.collect_list(F.struct("line_no", "whole")).alias("at")))  # lines of one document
    texts = docs.hint("merge").join(by_doc, ["_k", "doc_id"]).select("_k", "doc_id", "text", "at.line_no", "at.whole")
    held = cut(texts.mapInArrow(take_lines, "whole bigint, doc_id bigint, _k bigint, line_no int, line string"))

    keys = held.mapInArrow(spell, "variant bigint, place int, whole bigint, doc_id bigint, _k bigint, line_no bigint")
    order = ["variant", "place", "doc_id", "_k", "line_no"]
    hot = frequent_variants(held)
    met = keys.where(~F.col("variant").isin(hot)) if hot else keys
    met = met.repartition("variant").sortWithinPartitions(*order).mapInArrow(meet, MEMBERS)
    if hot:
        met = met.union(held.mapInArrow(spread(hot), MEMBERS))
    met = cut(met)
    groups = verified(met, held)
    near = settle(groups)

    fates = cut(classes.join(near, "whole", "left").where("near IS NOT NULL OR first <> last").select("h1", "h2", "first", "near"))
    joined = lines.select("_k", "doc_id", "line_no", "h1", "h2").join(fates, ["h1", "h2"])
    is_first = F.struct("doc_id", "_k", "line_no") == F.col("first")
    out = joined.where(~is_first | F.col("near").isNotNull()).select(
        "_k",
        "doc_id",
        "line_no",
        F.when(is_first, "near").otherwise("exact").alias("kind"),
        F.when(is_first, F.col("near.doc_id")).otherwise(F.col("first.doc_id")).alias("keeper_doc_id"),
        F.when(is_first, F.col("near.line_no")).otherwise(F.col("first.line_no")).cast("int").alias("keeper_line_no"),
    )
    made = cut(out.distinct())
    drop(lines, classes, half, shared, suspects, by_doc, held, met, groups, near, fates)
    return made


def remove(df: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """df with the lines found taken out of text, and struct column _lines.

    _lines: n_lines, n_exact, n_near and n_kept, longs; n_lines counts the
    lines of the whole text. Texts without such lines stay as they are, null
    ones too. Other columns stay as they are; one named _lines is replaced.
    """
    df, back = set_aside(df, "_key", "_doc", "_gone", "_exact")
    gone = cut(found.groupBy(F.col("_k").alias("_key"), F.col("doc_id").alias("_doc")).agg(F.collect_list("line_no").alias("_gone"), F.count_if(F.col("kind") == "exact").alias("_exact")))

    @F.arrow_udf("string")
    def without(texts: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for t, gone in zip(texts, lines):
            t, gone = t.as_py(), gone.as_py()
            out.append("\n".join([x for i, x in enumerate(t.split("\n")) if i not in bad]) if gone and t is not None and (bad := set(gone)) else t)
        return pa.array(out, pa.string())

    keyed = df.withColumn("_key", F.xxhash64("doc_id", "text")).withColumn("_doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    keyed = keyed.hint("merge").join(gone, ["_key", "_doc"], "left")
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long")
    dropped = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    exact = F.coalesce("_exact", F.lit(0)).cast("long")
    counts = F.struct(n.alias("n_lines"), exact.alias("n_exact"), (dropped - exact).alias("n_near"), (n - dropped).alias("n_kept"))
    touched = F.col("_gone").isNotNull()
    left = F.when(touched, without(F.when(touched, F.col(text)), "_gone")).otherwise(F.col(text))  # other texts needn't go through Python
    return back(keyed.withColumn("_lines", counts).withColumn(text, left).drop("_key", "_doc", "_gone", "_exact"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines counted, and the digest of what is left of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove(docs, find(docs))
    return out.select("doc_id", "_lines.*", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("left_sha256"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without repeated lines; those left without a word go.

    A column n_chars follows the text.
    """
    safe, back = set_aside(docs, "_lines")
    out = remove(safe, find(docs.select("doc_id", "text")))
    left = out.where("_lines.n_exact + _lines.n_near = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    touched = F.col("_lines.n_exact") + F.col("_lines.n_near") > 0
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(left.drop("_lines")).select(*docs.columns)
