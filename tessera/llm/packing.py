"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so the documents enter the
search as counts by length: a table whose size the capacity bounds, however
many documents there are. Around the largest length left, the undominated
fillings of the open space are enumerated from long to short; a filling is
repeated as often as its lengths last. An incumbent, at first the best-fit
solution, allows an improvement only so much waste in all: fillings and
branches beyond that are pruned. Rows then find their places by their rank
among rows of equal length.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.bpe import byte_letters
from tessera.llm.names import set_aside
from tessera.llm.ranks import number_rows
from tessera.llm.store import cut, table

CAPACITY, END_ID = 1024, 2
#: Texts of so many characters are searched for white space of LONG // 10 and more.
LONG = 100_000
SPACES = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG // 10},}}")
#: Fixed value: how byte-level models of this kind split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # times, (length, copies)
Filling = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Search:
    """How far the search goes on the driver, whatever the size of the data.

    fillings: branches at a node, of the least waste; fill_steps: steps of one
    enumeration; nodes and steps: of the whole search; held: branches that
    wait, beyond which only the one of the least waste is followed. dives: steps of one
    enumeration in the dives that come first, which take the filling of the
    least waste each time and improve the incumbent. Beyond these limits the
    incumbent is the result, and Plan.proven says whether it is known to be
    best.
    """

    fillings: int = 4
    fill_steps: int = 3000
    nodes: int = 6000
    steps: int = 300_000
    held: int = 1000
    dives: tuple[int, ...] = (100, 300, 1000)


class Plan(NamedTuple):
    """patterns use up all lengths in that many sequences; best_fit is what the incumbent began with, bound a lower bound."""

    patterns: list[Pattern]
    sequences: int
    best_fit: int
    bound: int
    proven: bool


SEARCH = Search()


class ByteModel:
    """A byte-level BPE file of the tokenizers library.

    Ids that follow the order of merges are what tiktoken needs, which is
    much faster and encodes a text at once, without memory between texts.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        if any(vocab[t] != 256 + i for i, t in enumerate(merged)) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level model whose ids follow its merges is needed")
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in self.specials:
            self.ranks.pop(t.encode(), None)

    def start(self) -> None:
        """Prepares what a worker needs besides the tables."""
        import tiktoken

        self.coder = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=self.ranks, special_tokens=self.specials)._core_bpe
        self.ranks = {}  # the coder has its own
        self.allowed = set(self.specials)

    def plain(self, text: str) -> bytes:
        return bytes(self.coder.encode_to_tiktoken_buffer(text, self.allowed))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if len(text) < LONG:
            return self.plain(text)
        # the pattern can't look ahead over very long white space: it is a word of its own but for its last character
        out, at = [], 0
        for m in SPACES.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += [self.plain(text[at : m.start()]), array("I", self.coder.encode_single_piece(text[m.start() : end].encode())).tobytes()]
            at = end
        return b"".join([*out, self.plain(text[at:])])


def load(path: str | None = None) -> ByteModel:
    """The model in a file on the driver; by default the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return ByteModel(f.read())


def pieces(df: DataFrame, model: ByteModel, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, out: str = "pieces") -> DataFrame:
    """Adds the column out: each text's ids and end_id, in pieces of at most capacity.

    It is an array of (piece, start, length, ids); ids are little-endian
    unsigned 32-bit numbers. Only the first piece of a text that is cut may
    be shorter than capacity. A null text is empty and has end_id alone.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    tail = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids:binary>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        if not hasattr(m, "coder"):
            m.start()
        for texts in slices(batches):
            rows, at, start, size, ids = [0], [], [], [], []
            for t in texts:
                coded = m.encode(t.as_py() or "") + tail
                n = len(coded) // 4
                begin, piece = 0, 0
                while begin < n:
                    end = begin + ((n - begin) % capacity or capacity)
                    at.append(piece)
                    start.append(begin)
                    size.append(end - begin)
                    ids.append(coded[4 * begin : 4 * end])
                    begin, piece = end, piece + 1
                rows.append(len(at))
            parts = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())], names=["piece", "start", "length", "ids"])
            yield pa.ListArray.from_arrays(pa.array(rows, pa.int32()), parts)

    return df.withColumn(out, run(F.col(text)))


def dominates(a: Filling, b: Filling) -> bool:
    """Whether the items of b fit into distinct items of a, several into one where they can.

    Then a solution with b has one as good with a. Fillings whose difference
    is over six items count as not comparable, which only keeps both.
    """
    more, less = dict(a), dict(b)
    for s in more.keys() & less.keys():
        n = min(more[s], less[s])
        more[s] -= n
        less[s] -= n
    room = sorted(s for s, n in more.items() for _ in range(n))
    items = sorted((s for s, n in less.items() for _ in range(min(n, 7))), reverse=True)
    if sum(items) > sum(room) or len(items) > 6:
        return False

    def go(i: int) -> bool:
        if i == len(items):
            return True
        for k in range(len(room)):
            if room[k] >= items[i] and (k == 0 or room[k] != room[k - 1]):
                room[k] -= items[i]
                if go(i + 1):
                    return True
                room[k] += items[i]
        return False

    return go(0)


def fillings(counts: dict[int, int], space: int, slack: int, most: int = SEARCH.fillings, steps: int = SEARCH.fill_steps) -> tuple[list[Filling], bool, int]:
    """Undominated fillings of space that waste no more than slack, the least waste first; whether that is all of them, and the steps taken.

    They are enumerated from long to short lengths. What is left open after a
    choice shrinks by no more than all shorter items together, which prunes by
    the waste; one length that fits exactly dominates all others.
    """
    if counts.get(space):
        return [((space, 1),)], True, 1
    lengths = sorted((s for s, c in counts.items() if c and s <= space), reverse=True)
    below = [0]  # of all items from a place on, as far as it matters
    for s in reversed(lengths):
        below.append(min(below[-1] + s * counts[s], space + 1))
    below.reverse()
    found: list[tuple[int, Filling]] = []
    taken, whole = 0, True

    def keep(left: int, chosen: Filling) -> None:
        nonlocal whole
        if left > slack or any(dominates(f, chosen) for _, f in found):
            return
        found[:] = [(w, f) for w, f in found if not dominates(chosen, f)]
        found.append((left, chosen))
        found.sort(key=lambda f: f[0])
        if len(found) > most:
            whole = False
            found.pop()

    def go(at: int, left: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal taken, whole
        taken += 1
        full = True
        while at < len(lengths):
            s = lengths[at]
            if s <= left:
                if left - below[at] > slack:
                    return  # even all that is shorter leaves too much open
                for copies in range(min(counts[s], left // s), 0, -1):
                    if taken > steps and found or len(found) == most and not found[-1][0]:
                        whole = False
                        return
                    chosen.append((s, copies))
                    go(at + 1, left - s * copies, chosen)
                    chosen.pop()
                full = False
            at += 1
        if full:
            keep(left, tuple(chosen))

    go(0, space, [])
    return [f for _, f in found], whole, taken


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """The incumbent: each sequence takes the longest that fits, again and again."""
    counts, out = dict(counts), []
    while counts:
        left, taken = capacity, {}
        for s in sorted(counts, reverse=True):
            if n := min(counts[s], left // s):
                taken[s], left = n, left - n * s
        out.append(place(counts, tuple(taken.items())))
    return out


def place(counts: dict[int, int], filling: tuple[tuple[int, int], ...]) -> Pattern:
    """Takes a filling out of counts as often as it can be repeated."""
    times = min(counts[s] // n for s, n in filling)
    for s, n in filling:
        counts[s] -= times * n
        if not counts[s]:
            del counts[s]
    return times, filling


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: items over half the capacity can't share, and what they leave open takes only items that fit there."""
    size = [0] * (capacity + 1)
    for s, c in counts.items():
        size[s] = c
    number, total = [0], [0]  # of items shorter than each length
    for s, c in enumerate(size):
        number.append(number[-1] + c)
        total.append(total[-1] + s * c)
    best = -(-total[-1] // capacity)
    half = capacity // 2
    for k in range(half + 1):
        alone = number[-1] - number[capacity - k + 1]
        shared, held = number[capacity - k + 1] - number[half + 1], total[capacity - k + 1] - total[half + 1]
        small = total[half + 1] - total[k]
        best = max(best, alone + shared + max(0, -(-(small - (shared * capacity - held)) // capacity)))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, search: Search = SEARCH) -> Plan:
    """Patterns that use up the counts by length in as few sequences as the search finds.

    Each pattern exhausts a length, so there are at most as many as lengths.
    The result is proven if it meets the lower bound, or if the search ended
    by itself, with every filling placed once at a time.
    """
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    best = best_fit(counts, capacity)
    first = fewest = sum(t for t, _ in best)
    total = sum(s * c for s, c in counts.items())
    bound = least_sequences(counts, capacity)

    def explore(branches: int, fill_steps: int, nodes: int, steps: int) -> bool:
        """Goes on until an incumbent meets the bound; whether all was seen."""
        nonlocal best, fewest
        whole = True
        # a branch: what is left, patterns so far, sequences so far, their waste; one dive after another, the next from the oldest branch
        open_: deque[tuple[dict[int, int], list[Pattern], int, int]] = deque([(dict(counts), [], 0, 0)])
        deeper = False
        while open_ and fewest > bound:
            if nodes <= 0 or steps <= 0:
                return False
            left, done, used, waste = open_.pop() if deeper else open_.popleft()
            nodes -= 1
            slack = (fewest - 1) * capacity - total - waste  # what an improvement may still waste
            deeper = bool(left) and slack >= 0
            if slack >= 0 and not left:
                best, fewest = done, used
            if not deeper:
                continue
            largest = max(left)
            rest = dict(left)
            rest[largest] -= 1
            found, all_of_them, taken = fillings(rest, capacity - largest, slack, branches, fill_steps)
            steps -= taken
            whole &= all_of_them
            deeper = bool(found)
            if len(open_) > search.held and len(found) > 1:
                found, whole = found[:1], False
            for f in reversed(found):
                filled = dict(f)
                filled[largest] = filled.get(largest, 0) + 1
                after = dict(left)
                made = place(after, tuple(sorted(filled.items(), reverse=True)))
                whole &= made[0] == 1
                lost = made[0] * (capacity - sum(s * n for s, n in made[1]))
                open_.append((after, [*done, made], used + made[0], waste + lost))
        return whole

    for fill_steps in search.dives:
        explore(1, fill_steps, search.nodes, search.steps)
    whole = explore(search.fillings, search.fill_steps, search.nodes, search.steps)
    return Plan(best, fewest, first, bound, fewest == bound or whole)


def counts_of(df: DataFrame, length: str, capacity: int = CAPACITY) -> dict[int, int]:
    """The number of rows by length, of which there are at most capacity; a length that is null or out of range is an error."""
    ok = F.col(length).between(1, capacity)
    wrong = df.where(~F.coalesce(ok, F.lit(False))).select(length).first()
    if wrong is not None:
        raise ValueError(f"lengths must be from 1 to {capacity}, not {wrong[0]}")
    return {r[0]: r[1] for r in df.where(ok).groupBy(length).count().collect()}


def pack(df: DataFrame, length: str, keys: list[str], order: list[Column], capacity: int = CAPACITY, search: Search = SEARCH) -> DataFrame:
    """Adds the long columns sequence_id and offset: each row's place.

    length must lie from 1 to capacity in every row. keys tell rows apart and
    spread equal lengths over tasks. Rows equal in keys and order are
    interchangeable. df is read four times, so it should be a table. Columns
    sequence_id and offset of df are replaced.
    """
    spark = df.sparkSession
    own = {"_rank", "_s", "_from", "_to", "_n", "_seq", "_off"}
    if own & {c.lower() for c in [length, *keys]}:
        raise ValueError("name the length and the keys otherwise")
    df, back = set_aside(df.select(*(c for c in df.columns if c.lower() not in ("sequence_id", "offset"))), *own)
    rows, seq = [], 0
    taken: dict[int, int] = {}
    for times, filling in plan(counts_of(df, length, capacity), capacity, search).patterns:
        offset = 0
        for s, n in filling:
            at = taken.get(s, 0)
            rows.append((s, at, at + times * n, n, seq, offset))
            taken[s] = at + times * n
            offset += s * n
        seq += times
    # no filling has more than sqrt(2 * capacity) lengths and no plan more than capacity patterns
    slots = spark.createDataFrame(rows, "_s bigint, _from bigint, _to bigint, _n bigint, _seq bigint, _off bigint")
    ranked = number_rows(df, [length], keys, order, "_rank")
    found = ranked.join(F.broadcast(slots), (F.col(length) == F.col("_s")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    return back(
        found.withColumn("sequence_id", F.col("_seq") + F.floor(nth / F.col("_n")).cast("long"))
        .withColumn("offset", F.col("_off") + F.pmod(nth, F.col("_n")) * F.col("_s"))
        .select(*df.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of all documents with their places."""
    # outer, as a filter on empty lists would run the tokenizer a second time
    cutup = pieces(docs.select("doc_id", "text"), load(path)).select("doc_id", F.explode_outer("pieces").alias("p"))
    narrow = cut(cutup.select("doc_id", "p.piece", "p.start", "p.length", F.crc32("p.ids").alias("ids_crc32")))
    return pack(narrow, "length", ["doc_id", "piece"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence and place."""
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the documents that are left."""
    return pack_documents(docs)
