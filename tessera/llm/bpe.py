"""Tokenisation by an automaton compiled from the merges of a BPE model.

The automaton reads tokens. It begins as one state with a loop for each base
symbol and takes in the merges in order. The gadget for a merge (u, v) -> w
gives w an arc from each state that has one for u, leading where v leads, and
sends u to a copy of its target without the arc for v: after u, v can't stand
alone any more. What it accepts in the end are the correct tokenisations, one
for each string and each of them with correct prefixes only. So a word is
encoded from left to right with one live state at each place.

The copies share their rows: a row is its parent's row as it was at the time
of copying, less the arcs that were removed since. Rows are looked up in the
removals and kept once they are known.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.batches import slices
from tessera.llm.store import table

SHIFT = 20
#: Letters before it are the same in every version of Unicode; but for one, lower case makes one letter of each.
SETTLED = "\u0250"
#: Stands for the end of a word among its letters.
END = "\0"
#: Words, and pieces between white space, kept by a worker, twice at most; bounds its memory.
KEPT, KEPT_PIECES = 150_000, 80_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level models."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = [], 0x100
    for b in range(256):
        letters.append(chr(b if b in plain else extra))
        extra += b not in plain
    return letters


class Automaton:
    """States and arcs over token ids.

    target[t]: the state behind every arc for t. parent[q], copied[q]: the
    row that q was copied from, and when. removed[q][t]: when q lost its
    arc for t. left[t]: the first half of t, which decides from which
    states t has an arc; made[t]: when t came to be.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        size = max(vocab.values(), default=-1) + 1
        self.target, self.left, self.made = [0] * size, [-1] * size, [0] * size
        self.parent, self.copied = [-1], [0]
        self.removed: list[dict[int, int]] = [{}]
        owners = [size]
        arcs = set()
        for when, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in arcs or self.left[w] >= 0:
                raise ValueError(f"{a + b!r} is made by more than one merge")
            arcs.add(w)
            self.left[w], self.made[w] = u, when
            behind = self.target[v]
            if not self.has_arc(self.target[u], v):
                raise ValueError(f"merge {when} can never apply")
            old = self.target[u]
            if owners[old] > 1 or behind == old:
                owners[old] -= 1
                self.parent.append(old)
                self.copied.append(when)
                self.removed.append({})
                owners.append(1)
                self.target[u] = len(self.parent) - 1
            self.removed[self.target[u]][v] = when
            # w leads where v led before this merge, so that row had to stay as it was
            owners[self.target[w]] -= 1
            self.target[w] = behind
            owners[behind] += 1

    def lost(self, state: int) -> dict[int, int]:
        """All arcs that the row of state lacks by their removal, its parents' included, and when they went."""
        out, until = {}, 1 << 60
        while state >= 0:
            for part, when in self.removed[state].items():
                if when <= until:
                    out.setdefault(part, when)
            until = min(until, self.copied[state])
            state = self.parent[state]
        return out

    def has_arc(self, state: int, token: int, lost: dict[int, int] | None = None) -> bool:
        """Whether the row of state holds an arc for token."""
        lost = self.lost(state) if lost is None else lost
        needed = 1 << 60
        while token >= 0:
            # an arc lost by a part bars what is made from that part later on, or by the same merge (u, u)
            if lost.get(token, needed + 1) <= needed:
                return False
            needed = self.made[token]
            token = self.left[token]
        return True


class Encoder:
    """Encodes pre-split words with an automaton; remembers rows.

    From each place the longest token comes first, then its prefixes, and a
    place from which no token leads on is left for good: a place has one live
    state, so it is tried once.
    """

    def __init__(self, automaton: Automaton, word_end: str):
        self.automaton = automaton
        self.tokens = {t.removesuffix(word_end) + END if t.endswith(word_end) else t: i for t, i in automaton.vocab.items()}
        # each beginning of a token, with the token that it is or -1
        self.starts = {t[:k]: -1 for t in self.tokens for k in range(1, len(t))} | self.tokens
        self.sizes = [0] * len(automaton.target)
        self.shorter = [-1] * len(automaton.target)
        for t, i in self.tokens.items():
            self.sizes[i] = len(t)
            self.shorter[i] = next((self.tokens[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.tokens), -1)
        self.rows: dict[int, int] = {}
        self.lost: dict[int, dict[int, int]] = {}

    def arc(self, state: int, token: int) -> int:
        """The state behind the arc for token, or -1; kept in rows."""
        if len(self.rows) > KEPT:
            self.rows.clear()
        lost = self.lost.get(state)
        if lost is None:
            lost = self.lost[state] = self.automaton.lost(state)
        to = self.rows[state << SHIFT | token] = self.automaton.target[token] if self.automaton.has_arc(state, token, lost) else -1
        return to

    def longest(self, symbols: str, at: int) -> int:
        """The longest token at a place, or -1."""
        starts, found, end = self.starts.get, -1, at + 1
        while (token := starts(symbols[at:end])) is not None:
            if token >= 0:
                found = token
            if end == len(symbols):
                break
            end += 1
        return found

    def encode(self, symbols: str) -> list[int]:
        """Token ids of one word, given as letters for its bytes."""
        symbols += END
        rows, sizes, shorter = self.rows.get, self.sizes, self.shorter
        out: list[int] = []
        states, places, dead = [0], [0], set()
        token = self.longest(symbols, 0)
        while True:
            state, at = states[-1], places[-1]
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    to = rows(state << SHIFT | token)
                    if to is None:
                        to = self.arc(state, token)
                    if to >= 0:
                        break
                token = shorter[token]
            else:
                dead.add(at)
                if not out:
                    raise ValueError(f"no tokens for {symbols!r}")
                token = shorter[out.pop()]
                states.pop()
                places.pop()
                continue
            out.append(token)
            if end == len(symbols):
                return out
            states.append(to)
            places.append(end)
            token = self.longest(symbols, end)


class Known(dict):
    """Remembers what make returns for short strings.

    What was asked for since the last but one clearing is kept, so frequent
    strings stay and memory is bounded by twice most.
    """

    def __init__(self, make, most: int):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 48:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()


class Model:
    """A model file of the tokenizers library with word ends, ready to use.

    It splits as the file says (special tokens, NFC, white space, lower case,
    words) and leaves the rest to the automaton.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("a BPE model with word ends is needed")
        self.word_end = model["end_of_word_suffix"]
        self.vocab = dict(model["vocab"])
        self.automaton = Automaton(self.vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: The file without its vocabulary: how the library splits text.
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.splitter = json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}})
        self.labels = {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}

    def start(self) -> None:
        """Prepares what a worker needs besides the tables."""
        self.encoder = Encoder(self.automaton, self.word_end)
        self.library = Tokenizer.from_str(self.splitter)
        self.split = regex.compile(self.pattern).findall
        self.letters = byte_letters()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if self.specials else lambda t: [t]
        self.odd = regex.compile("[\x1c-\x1f]").search
        self.words = Known(self.word, KEPT)
        self.pieces = Known(self.piece, KEPT_PIECES)

    def word(self, word: str) -> bytes:
        """Ids of a word after splitting, in the letters of its bytes, as 32-bit numbers."""
        return array("i", self.encoder.encode(word)).tobytes()

    def spelt(self, text: str) -> str:
        """Text in lower case, one letter at a time, in the letters of its bytes."""
        return "".join([self.letters[b] for b in "".join(map(str.lower, text)).encode()])

    def piece(self, piece: str) -> bytes:
        """Ids of a piece of text between white space."""
        # most pieces are letters and at most one sign after them; letters of ASCII are their bytes
        body, sign = (piece[:-1], piece[-1]) if piece[-1] in ",.;:!?" else (piece, "")
        if body.isascii():
            if body.isalpha():
                low = body.lower()
                return self.words[low] + self.words[sign] if sign else self.words[low]
        elif body.isalpha() and max(body) < SETTLED and "İ" not in body and unicodedata.is_normalized("NFC", body):
            low = self.spelt(body)
            return self.words[low] + self.words[sign] if sign else self.words[low]
        out = []
        for part in self.cut(piece):
            if part in self.specials:
                out.append(array("i", [self.specials[part]]).tobytes())
            elif part.isascii() and part.isprintable():
                out += map(self.words.__getitem__, self.split(part.lower()))
            elif part:  # the library's own tables say what is a letter and which is its lower case
                low = self.library.normalizer.normalize_str(part)
                out += [self.words[word] for word, _ in self.library.pre_tokenizer.pre_tokenize_str(low)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 32-bit numbers."""
        # four characters are white space to Python but not to the pattern
        pieces = regex.findall(r"\S+", text) if self.odd(text) else text.split()
        self.words.trim()
        self.pieces.trim()
        return b"".join(map(self.pieces.__getitem__, pieces))


def load(path: str | None = None) -> Model:
    """The model in a file on the driver; by default the public one with word ends."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return Model(f.read())


def encode(df: DataFrame, model: Model, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the array<int> column out, the token ids of the whole text.

    A null or empty text has no ids. A column named out is replaced. The tables go to each executor once;
    their size follows the model file, not the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        if not hasattr(m, "encoder"):
            m.start()
        for texts in slices(batches):
            coded = [m.encode(t.as_py() or "") for t in texts]
            ends = np.cumsum([0, *map(len, coded)], dtype=np.int64) // 4
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)

    return df.withColumn(out, run(F.col(text)))


def decode(df: DataFrame, model: Model, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the string column out: the arcs' labels, joined by a space.

    This is how a model file without a decoder is decoded. Word ends and
    special tokens are kept; null or empty ids give an empty text, and null ids
    and those without a label are left out. A column named out is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.labels)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        label = shared.value.get
        for rows in slices(batches):
            flat, ends = rows.flatten().fill_null(-1).to_numpy(), np.cumsum(rows.value_lengths().fill_null(0).to_numpy())
            yield pa.array([" ".join(t for i in part.tolist() if (t := label(i)) is not None) for part in np.split(flat, ends[:-1])] if len(rows) else [], pa.string())

    return df.withColumn(out, run(F.col(ids)))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    model = load()
    docs = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
