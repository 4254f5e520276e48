"""Tokenisation, packing, quality rules and sharding against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, quality, sharding

ODD = ["<|endoftext|>a<|startoftext|>", "ΑΣ ΟΔΟΣ İi'll don't 12á \x1cx\ty <|endoftext|>", "日本語 テスト🎉🎉", "a" * 400, "é café", "  two  spaces \n and \n\n lines ", "aaaa oooo thethe!!!! ..."]


def random_texts():
    rnd = random.Random(3)
    return ["".join(rnd.choice("aeoitnshr éß'12.") for _ in range(rnd.randint(0, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def model():
    m = bpe.load()
    m.start()
    return m


def test_automaton_agrees_with_the_library(model, documents):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in [t for _, t in documents[:60]] + ODD + random_texts():
        ids = np.frombuffer(model.encode(text), np.int32).tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids
        assert " ".join(model.labels[i] for i in ids) == lib.decode(ids, skip_special_tokens=False)


def test_small_automaton_accepts_only_correct_tokenisations():
    merges = [("a", "b"), ("ab", "a"), ("b", "a"), ("a", "a"), ("aa", "b"), ("aa", "aa")]
    vocab = {t: i for i, t in enumerate(["a", "b", *dict.fromkeys(x + y for x, y in merges)])}
    merges = [m for i, m in enumerate(merges) if m[0] + m[1] not in [x + y for x, y in merges[:i]]]
    automaton = bpe.Automaton(vocab, [m for m in merges if m != ("aa", "b")])

    def merged(text):
        parts = list(text)
        for u, v in [m for m in merges if m != ("aa", "b")]:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    def accepted(text, state=0):
        if not text:
            yield []
        for t, i in vocab.items():
            if text.startswith(t) and i < len(automaton.target) and automaton.has_arc(state, i):
                for rest in accepted(text[len(t) :], automaton.target[i]):
                    yield [t, *rest]

    vocab.pop("aab", None)
    for n in range(1, 9):
        for bits in range(2**n):
            text = "".join("ab"[bits >> k & 1] for k in range(n))
            assert list(accepted(text)) == [merged(text)], text


def test_encode_and_decode_edges(spark, edge, model):
    rows = bpe.decode(bpe.encode(edge, bpe.load()), bpe.load()).collect()
    by = {(r.doc_id, r.text): r for r in rows}
    assert by[(0, None)].ids == [] and by[(0, None)].decoded == "" and by[(1, "")].ids == []
    assert len(rows) == edge.count() and set(edge.columns) < set(rows[0].asDict())
    assert bpe.encode(edge.limit(0), bpe.load()).count() == 0


def test_query_digests(spark, sf_dir, documents):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe.op8_bpe(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for d, text in documents[::9]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_byte_model_agrees_with_the_library(documents):
    m = packing.load()
    m.start()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [t for _, t in documents[:60]] + ODD + random_texts():
        assert np.frombuffer(m.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, sf_dir, documents):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op9_packing(spark, sf_dir).collect()
    used = check_packed(rows, 1024)
    bound = -(-sum(r.length for r in rows) // 1024)
    assert used <= bound + 3
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, text in documents[::7]:
        ids = np.array(lib.encode(text, add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want = [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[d]) == want


def test_plan_is_best_on_small_cases():
    def fewest(items, capacity):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity:
                    bins[k] += items[i]
                    go(i + 1, bins)
                    bins[k] -= items[i]
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    rnd = random.Random(5)
    for n in range(120):
        items = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))), reverse=True)
        made = packing.plan(dict(Counter(items)), 20)
        taken = Counter()
        for times, filling in made.patterns:
            assert sum(s * n for s, n in filling) <= 20
            for s, n in filling:
                taken[s] += times * n
        assert taken == Counter(items)
        want = fewest(items, 20)
        assert sum(t for t, _ in made.patterns) == made.sequences == want
        assert made.bound <= want <= made.best_fit
        if packing.plan(dict(Counter(items)), 20, packing.Search(1, 1, 1, 1, 1, ())).proven:
            assert packing.plan(dict(Counter(items)), 20, packing.Search(1, 1, 1, 1, 1, ())).sequences == want
    assert packing.plan({}, 20) == ([], 0, 0, 0, True)
    with pytest.raises(ValueError):
        packing.plan({21: 1}, 20)


def test_search_beats_best_fit():
    made = packing.plan({6: 1, 5: 2, 4: 2, 3: 2}, 15)
    assert (made.sequences, made.proven) == (2, True)
    # the longest that fits leaves 7 + 2, 6 + 3 and 5 + 4 apart
    made = packing.plan({8: 1, 6: 1, 5: 1, 4: 2, 3: 1}, 15)
    assert made.sequences == made.bound == 2


def test_dominated_fillings_are_left_out():
    assert packing.dominates(((7, 1),), ((4, 1), (3, 1))) and not packing.dominates(((4, 1), (3, 1)), ((7, 1),))
    assert packing.dominates(((5, 1), (2, 1)), ((3, 1), (2, 2))) and not packing.dominates(((4, 2),), ((5, 1), (2, 1)))
    found, whole, _ = packing.fillings({6: 1, 5: 1, 4: 1, 2: 1}, 7, 7)
    assert found == [((5, 1), (2, 1)), ((6, 1),)] and whole
    assert packing.fillings({6: 1, 4: 1}, 7, 0)[:2] == ([], True)


def test_lengths_are_checked(spark):
    for bad in (None, 0, 1025):
        df = spark.createDataFrame([(1, bad), (2, 5)], "k bigint, length bigint")
        with pytest.raises(ValueError):
            packing.pack(df, "length", ["k"], [])


def test_packing_edges(spark, edge):
    rows = packing.pack_documents(edge).collect()
    check_packed(rows, 1024)
    assert sum(r.length == 1 for r in rows) == 2  # the null and the empty text
    assert packing.pack_documents(edge.limit(0)).count() == 0


def plain_quality(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_quality_counts(spark, sf_dir, documents, edge):
    got = {r.doc_id: r for r in quality.op10_quality(spark, sf_dir).collect()}
    for d, text in documents:
        r, want = got[d], plain_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    for r in quality.judge(edge).collect():
        assert tuple(r.quality[:5]) == plain_quality(r.text)
    assert quality.judge(edge.limit(0)).count() == 0


def test_coverage_is_of_characters_in_repeated_windows():
    text = " ".join([f"w{i}" for i in range(40)] + ["a", "bb", "ccc", "dddd", "e"] + [f"v{i}" for i in range(40)] + ["a", "bb", "ccc", "dddd", "e"])
    row, spans = quality.measure(text, (5, 6))
    assert spans == [22, 0] and row[4] == 10


def test_sharding_law(spark, sf_dir, documents):
    rows = sharding.op2_sharding(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    texts = dict(documents)
    slots = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_shares(spark):
    keys = spark.range(20000).withColumnRenamed("id", "k")
    counts = Counter(r.shard for r in sharding.assign(keys, "k", [1.0, 2.0, 1.0]).collect())
    assert abs(counts[1] / 20000 - 0.5) < 0.02
    even = Counter(r.shard for r in sharding.assign(keys, "k", 40).collect())
    assert max(even.values()) < 1.25 * 500 and min(even.values()) > 0.75 * 500
    fewer = {r.k: r.shard for r in sharding.assign(keys, "k", 7).collect()}
    more = {r.k: r.shard for r in sharding.assign(keys, "k", 8).collect()}
    assert all(more[k] in (fewer[k], 7) for k in fewer)


def test_sharding_edges(spark, edge):
    out = sharding.assign(edge, "doc_id", 5)
    assert out.count() == edge.count() and out.where("shard IS NULL").count() == 0
    with pytest.raises(ValueError):
        sharding.assign(edge, "doc_id", 0)
    with pytest.raises(ValueError):
        sharding.assign(edge, "doc_id", [1.0, 0.0])


def test_control_characters_beside_white_space(model):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["\x1c hi\n", " \x1d", "\t\x1e\x1f \n", "\n a\x1cb ", "\x1c"]:
        assert np.frombuffer(model.encode(text), np.int32).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_very_long_texts():
    m = packing.load()
    m.start()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [" " * 1_500_000, "a" + " " * 120_000 + "bc \n" + "\n" * 20_000 + "d", "\t" * 60_000 + "x" * 60_000, " " * 200_000 + "<|endoftext|> a"]:
        assert np.frombuffer(m.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_every_code_point_as_in_the_library(model):
    """What is a letter, a number or lower case follows the library's own tables, of whatever Unicode version."""
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        # each beside a letter and alone; runs that differ show which
        texts = [" ".join(f"a{chr(c)}B{chr(c)} {chr(c)}" for c in points[i : i + 256]) for i in range(at, min(at + 4096, len(points)), 256)]
        want = lib.encode_batch(texts, add_special_tokens=False)
        for text, w in zip(texts, want):
            assert np.frombuffer(model.encode(text), np.int32).tolist() == w.ids, hex(ord(text[1]))


def test_ids_without_a_label_are_left_out(spark, model):
    df = spark.createDataFrame([([320, 999_999, None, 320],), ([],), (None,)], "ids array<int>")
    a = model.labels[320]
    assert [r.decoded for r in bpe.decode(df, model).collect()] == [f"{a} {a}", "", ""]
