"""Near-duplicates, lines and components against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import components, lines, simhash


def plain_print(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """prints: (key, number); the smallest key reachable by 3 bits, for each row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return [least[find(i)] for i in range(len(prints))]


def test_query(spark, sf_dir, documents):
    prints = [(d, plain_print(t)) for d, t in documents]
    want = {d: (f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, sf_dir).collect()}
    assert got == want


def test_edges(spark, edge):
    rows = simhash.cluster(edge).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == edge.count()
    assert by[1].component_id == by[2].component_id == by[0].component_id == 0 and by[1].fingerprint == 0
    assert by[9].component_id == 8 and by[None].component_id is None
    assert simhash.cluster(edge.limit(0)).count() == 0


def close_numbers(n, seed, spots):
    rnd = np.random.default_rng(seed)
    base = int(rnd.integers(0, 2**63))
    out = set()
    while len(out) < n:
        x = base
        for b in rnd.choice(spots, int(rnd.integers(0, 7)), replace=False):
            x ^= 1 << int(b)
        out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


def test_large_entries_are_cut_again(spark):
    numbers = close_numbers(2600, 1, range(0, 64, 2)) + close_numbers(40, 2, range(64))
    df = spark.createDataFrame([(x,) for x in numbers], "fingerprint bigint")
    links = simhash.link(df, held=16)
    # entries of over 2048 numbers exist only in the first cut
    stars = {r.node: r.root for r in components.connect(links).collect()}
    want = plain_components([(x, x & (1 << 64) - 1) for x in numbers])
    assert [stars.get(x, x) for x in numbers] == want


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(4)
    chain = list(range(200))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, x) for x in range(1001, 1300)] + [(5000, 5000), (7, 7)]
    got = {r.node: r.root for r in components.connect(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, **{i: 1000 for i in range(1001, 1300)}}
    assert components.connect(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def word_distance_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_lines(docs, bounds):
    rows = sorted({(d, n, tuple(line.encode().split())) for d, t in docs for n, line in enumerate((t or "").split("\n")) if len(line.encode().split()) >= bounds.min_words})
    first, out = {}, {}
    for d, n, w in rows:
        if w in first:
            out[d, n] = ("exact", *first[w])
        else:
            first[w] = (d, n)
    order = sorted(first.items(), key=lambda x: x[1])
    stay = []
    for w, at in order:
        if len(w) >= bounds.near_words:
            hit = next((b for v, b in stay if abs(len(v) - len(w)) <= 1 and word_distance_one(v, w)), None)
            if hit:
                out[at] = ("near", *hit)
            else:
                stay.append((w, at))
    return out


def found(df):
    return {(r.doc_id, r.line_no): (r.kind, r.keeper_doc_id, r.keeper_line_no) for r in df.collect()}


def test_lines_of_documents(spark, sf_dir, documents):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(lines.find(df)) == plain_lines(documents, lines.BOUNDS)


def test_lines_with_edits(spark):
    rnd = random.Random(6)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(9, 14))] for _ in range(12)]
    docs = []
    for d in range(150):
        text = []
        for _ in range(rnd.randint(0, 4)):
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 2)):
                i = rnd.randrange(len(w))
                w[i : i + rnd.randint(0, 1)] = [rnd.choice("xyz")] * rnd.randint(0, 1)
            text.append(" ".join(w))
        docs.append((d, "\n".join(text)))
    got = found(lines.find(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert got == plain_lines(docs, lines.BOUNDS)
    assert {k for k, *_ in got.values()} == {"exact", "near"}


def test_lines_of_any_length_within_one_edit(spark, monkeypatch):
    """Without the switch by length, and with each variant as a frequent one."""
    rnd = random.Random(8)
    docs = [(d, "\n".join(" ".join(rnd.choices("abcd" if rnd.random() < 0.5 else "abcdefghij", k=rnd.randint(1, 12))) for _ in range(rnd.randint(0, 5)))) for d in range(80)]
    docs += [(d, f"the number {d} is in the middle of it") for d in range(100, 140)] + [(99, "the number is in the middle of it")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bounds = lines.Bounds(near_words=1)
    want = plain_lines(docs, bounds)
    assert found(lines.find(df, bounds)) == want
    monkeypatch.setattr(lines, "PART", 1)
    monkeypatch.setattr(lines, "SHARE", 1 << 40)
    real = lines.frequent_variants
    hot = []
    monkeypatch.setattr(lines, "frequent_variants", lambda held: hot.extend(real(held, 2)) or hot)
    assert found(lines.find(df, bounds)) == want and len(hot) > 5


def test_chains_end_at_lines_that_stay(spark):
    """Each line is one word from the one before: every other one stays."""
    chain = [[f"{'new' if i < n else 'old'}{i}" for i in range(6)] for n in range(6)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(chain)], "doc_id bigint, text string")
    assert found(lines.find(df)) == {(1, 0): ("near", 0, 0), (3, 0): ("near", 2, 0), (5, 0): ("near", 4, 0)}


def test_line_edges(spark, edge):
    out = lines.remove(edge, lines.find(edge))
    rows = out.collect()
    assert len(rows) == edge.count() and set(edge.columns) < set(out.columns)
    by = {(r.doc_id, r.text): r._lines for r in rows}
    assert by[(0, None)].n_lines == 0 and by[(1, "")].n_lines == 1
    assert found(lines.find(edge.limit(0))) == {}
    twice = spark.createDataFrame([(1, "a b c d e"), (2, "a  b c d e\nnew words are in here")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in lines.remove(twice, lines.find(twice)).collect()} == {1: "a b c d e", 2: "new words are in here"}


def test_bit_63_counts_once():
    """Differences in bit 63 and others, in runs of up to SMALL and of more."""
    apart = [(63,), (63, 0), (63, 40), (63, 62), (63, 30, 2), (63, 62, 61), (5, 9, 11), (63, 30, 2, 1), (63, 62, 61, 60), tuple(range(40, 64))]
    for fill in (0, simhash.SMALL):
        for spots in apart:
            base = 0x123456789ABCDEF
            other = base ^ sum(1 << b for b in spots)
            # far from both and from each other
            rest = [base ^ (0xFFF << 12 * i % 48) ^ (0x3FF << 48) ^ (i << 58) for i in range(1, fill + 1)]
            numbers = np.array(sorted([base, other, *rest]), np.uint64).view(np.int64)
            a, b = simhash.links_of_runs(np.zeros(len(numbers), np.int64), numbers, 3)
            pair = tuple(sorted(int(x) for x in np.array([base, other], np.uint64).view(np.int64)))
            assert (pair in set(zip(a.tolist(), b.tolist()))) == (len(spots) <= 3)


def test_short_lines_and_scripts_without_spaces(spark):
    texts = ["All rights reserved.\none two three", "x\nAll  rights reserved.", "同じ長い文が空白なしで続く\nshe sells red shells here", "同じ長い文が空白なしで続く\nshe sells blue shells here", " \n\nx", "a b c d", "a b c e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((r.doc_id, r.line_no, r.kind, r.keeper_doc_id, r.keeper_line_no) for r in lines.find(df).collect())
    assert got == [(1, 1, "exact", 0, 0), (3, 0, "exact", 2, 0), (3, 1, "near", 2, 1), (4, 2, "exact", 1, 0)]


def clashing(of, column):
    """A step whose 64-bit hashes in column are all alike, as if they had collided."""

    def run(batches):
        for batch in of(batches):
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, column, pa.array([5] * len(batch), pa.int64()))

    return run


def test_lines_whose_hashes_collide_stay_apart(spark, monkeypatch, sf_dir, documents):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    want = plain_lines([d for d in documents if d[0] < 60], lines.BOUNDS)
    real = lines.explode_lines
    for column in ("h1", "h2"):
        monkeypatch.setattr(lines, "explode_lines", lambda bounds, c=column: clashing(real(bounds), c))
        assert found(lines.find(df)) == want


def test_query_of_lines_against_plain_lines(spark, sf_dir, documents):
    """Every document's counts and what is left of it."""
    gone = plain_lines(documents, lines.BOUNDS)
    got = {r.doc_id: r for r in lines.op4_lines(spark, sf_dir).collect()}
    assert sorted(got) == sorted(d for d, _ in documents)
    for d, text in documents:
        all_lines = (text or "").split("\n")
        kinds = [gone.get((d, i), (None,))[0] for i in range(len(all_lines))]
        left = "\n".join(x for x, k in zip(all_lines, kinds) if k is None)
        r = got[d]
        n = len(all_lines) if text is not None else 0
        assert (r.n_lines, r.n_exact, r.n_near, r.n_kept) == (n, kinds.count("exact"), kinds.count("near"), n - len(kinds) + kinds.count(None))
        assert r.left_sha256 == hashlib.sha256(left.encode()).hexdigest()
