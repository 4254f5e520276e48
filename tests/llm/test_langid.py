"""Language identification: codes, counts and accuracy on documents held out."""

import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid


def test_accuracy_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    rows = langid.op11_language(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.99 * len(tested)
    wrong = [r for r in rows if lang[r.doc_id] and r.lang_pred != lang[r.doc_id]]
    assert np.mean([r.score for r in rows]) > 0.8 and all(r.second for r in wrong)


def test_learns_only_from_labels_and_text_given(spark):
    docs = spark.createDataFrame([(i, t, n) for i in range(120) for t, n in [("aba abab baba", "x"), ("cdc dcd cdcd", "y"), ("efe fefe", "z")]], "doc_id bigint, text string, lang string")
    docs = docs.withColumn("doc_id", F.monotonically_increasing_id()).withColumn("found", F.lit(7)).withColumn("score", F.lit(8))
    model = langid.fit(docs, "doc_id")
    assert model.languages == ["x", "y", "z"] and model.code.shape == (3, 3)
    texts = [(0, "abab"), (1, "CDC!"), (2, "f e f e fefe"), (3, None), (4, ""), (5, "12 !?\n"), (6, "ab" * 300_000), (7, "qqq www"), (8, "aba abab baba cdc dcd cdcd")]
    got = langid.predict(spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("score", F.lit(8)), model, out="f").orderBy("doc_id").collect()
    assert [r.f.lang for r in got][:7] == ["x", "y", "z", "und", "und", "und", "x"]
    assert [r.f.score for r in got[3:6]] == [0, 0, 0] and got[3].f.second is None and got[6].f.score > 0.9
    assert got[7].f.ambiguous and got[8].f.ambiguous and {got[8].f.lang, got[8].f.second} == {"x", "y"} and not got[6].f.ambiguous
    assert [r.score for r in got] == [8] * 9


def test_few_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", "x"), (2, "abd", "x"), (None, "q", "y"), (3, None, "y"), (4, "q", None)], "doc_id bigint, text string, lang string")
    one = langid.fit(docs, "doc_id")
    assert one.languages == ["x"]
    assert [r.f.lang for r in langid.predict(docs, one, out="f").collect()] == ["x", "x", "x", "und", "x"]
    none = langid.fit(docs.limit(0), "doc_id")
    assert [r.f.lang for r in langid.predict(docs, none, out="f").collect()] == ["und"] * 5
    assert langid.predict(docs.limit(0), one, out="f").count() == 0
    two = langid.fit(docs.union(docs.selectExpr("doc_id + 10", "'zzz zz'", "'z'")), "doc_id")
    assert [r.f.lang for r in langid.predict(docs.selectExpr("'zzz zz' AS text"), two, out="f").collect()] == ["z"] * 5
    with pytest.raises(ValueError):
        langid.fit(docs.union(docs.selectExpr("doc_id + 10", "'zz'", "'z'")), "doc_id", settings=langid.Settings(labels=1))


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 8, 9, 30):
        code = langid.codewords(n).astype(int)
        least = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        assert least >= (2 ** (n - 2) if n <= 7 else 4) and (np.abs(code.sum(axis=0)) < n).all()


def test_grams_stay_inside_their_text():
    settings = langid.Settings()
    texts = ["Ab, c", None, "", "1x1", "déjà-vu", " q"]
    h, starts, letters = langid.hashed(texts, settings)
    begin, end = langid.spans(starts, 3, len(h))
    assert letters.tolist() == [3, 0, 0, 1, 6, 1]
    for i, t in enumerate(texts):
        alone, s, _ = langid.hashed([t], settings)
        b, e = langid.spans(s, 3, len(alone))
        assert h[begin[i] : end[i]].tolist() == alone[b[0] : e[0]].tolist()
    assert end[0] - begin[0] == len(" ab c ") - 2
    again = langid.hashed(["ab ... C"], settings)
    assert again[0][: end[0]].tolist() == h[: end[0]].tolist()
