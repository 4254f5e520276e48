"""Columns named like an operator's own come through unchanged."""

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bands, bpe, chat, langid, lines, multiset, negatives, packing, pii, quality, ranks, sharding, simhash, urls

OWN = ["_k", "_K_", "_pii", "_key", "_gone", "_exact", "_lines", "_quality", "_found", "_block", "_at", "_first", "_head", "_row", "_in_block", "_In_rank", "_in_start", "_of_block", "_g0", "_s", "_from", "_to", "_n", "_seq", "_off", "_rank"]


def with_own(df, leave=()):
    """df with a column for each name, that holds the name."""
    return df.select("*", *(F.lit(c).alias(c) for c in OWN if c not in leave))


def unchanged(out, n, leave=()):
    rows = out.select(*(c for c in OWN if c not in leave)).distinct().collect()
    assert [list(r) for r in rows] == [[c for c in OWN if c not in leave]] and out.count() == n


def test_operators(spark):
    texts = ["say jo@mail.org twice, in five or more words", "say jo@mail.org twice, in five or more words\nand on", None]
    docs = with_own(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    unchanged(sharding.assign(docs, "doc_id", 3), 3)
    unchanged(lines.remove(docs.drop("_lines"), lines.find(docs)), 3, ["_lines"])
    unchanged(pii.replace(docs, b"k"), 3)
    unchanged(quality.judge(docs), 3)
    unchanged(ranks.number_rows(docs, ["doc_id"], ["text"], [F.col("text")], "no"), 3)
    unchanged(multiset.with_next(docs, "doc_id", ["text"], ["text"]), 3)
    unchanged(packing.pack(docs.withColumn("length", F.lit(9).cast("long")), "length", ["doc_id"], [F.col("doc_id")]), 3)


def test_more_operators(spark):
    docs = with_own(spark.createDataFrame([(i, t) for i, t in enumerate(["one text of words", "http://a.net/x", None])], "doc_id bigint, text string"))
    unchanged(urls.judge(docs, "text"), 3)
    unchanged(bpe.decode(bpe.encode(docs, bpe.load()), bpe.load()), 3)
    model = langid.fit(docs.withColumn("lang", F.lit("x")), "doc_id")
    unchanged(langid.predict(docs, model), 3)
    assert simhash.cluster(docs).count() == 3
    part = F.array(F.struct(F.lit("text").alias("type"), "text", F.lit("r").alias("ref"), F.lit(1).cast("long").alias("n_tokens")))
    chats = docs.withColumn("parts", part).withColumn("conv_id", F.lit(1)).withColumn("turn", F.col("doc_id")).withColumn("role", F.lit("user"))
    assert chat.format_chats(chats).count() == 1
    vectors = docs.withColumn("id", F.col("doc_id")).withColumn("label", F.col("doc_id")).withColumn("v", F.array(F.lit(1), F.lit(2)))
    assert negatives.mine(vectors, F.col("id") >= 0).count() == 0
    points = docs.selectExpr("*", "doc_id AS own", "10 * doc_id AS u", "doc_id AS weight", "doc_id AS p").drop("_k")
    assert bands.nearest_in_band(points, points, ["doc_id"]).count() == 3


def test_stages(spark):
    words = " ".join(f"w{i}" for i in range(80))
    docs = with_own(spark.createDataFrame([(1, words), (2, "mail jo@mail.org " + words[::-1])], "doc_id bigint, text string"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        unchanged(out, 2)
