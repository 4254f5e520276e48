"""The pipeline against its stages applied by plain Python."""

import corpus_pipeline
from test_duplicates import plain_lines
from test_near import plain_kept
from test_words import check_packed, plain_quality

from tessera.llm import lines, packing, pii, quality


def plain_share(text, n):
    """The share of word characters that stand in windows of n words found twice or more."""
    words = text.split()
    spots = {}
    for i in range(len(words) - n + 1):
        spots.setdefault(tuple(words[i : i + n]), []).append(i)
    inside = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(n)}
    return sum(len(words[i]) for i in inside) / max(1, sum(map(len, words)))


def plain_good(text):
    n_words, chars, symbols, _, n_repeat = plain_quality(text)
    if n_words < 50 or 100 * n_repeat > 50 * n_words or symbols > 0.1 * n_words:
        return False
    rows, seen, dup = text.split("\n"), set(), 0
    for row in rows:
        dup += len("".join(row.split())) if row in seen else 0
        seen.add(row)
    return dup <= 0.3 * chars and all(plain_share(text, n) <= most for n, most in quality.RULES.coverage.items())


def expected(documents):
    docs = [(d, t) for d, t in documents if plain_good(t)]
    gone = plain_lines(docs, lines.BOUNDS)
    cut = []
    for d, t in docs:
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        if left == t or left.encode().split():
            cut.append((d, left))
    kept = set(plain_kept(cut))
    return [(d, pii.pseudonymise(t, pii.KEY)[0]) for d, t in cut if d in kept]


def test_run(spark, sf_dir, documents):
    model = packing.load()
    model.start()
    want = {d: len(model.encode(t)) // 4 + 1 for d, t in expected(documents)}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    check_packed(rows, 1024)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
