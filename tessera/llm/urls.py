"""URL filtering by rules and by character language models, in SQL operations only.

Two smoothed variable-order Markov models are counted, on the distinct URLs
that rules accept and on those that rules reject. A character's probability
mixes the counts after two, one and no characters, each order backed by the
next shorter one. A URL's score is the mean over its characters of the
difference of the two log-likelihoods, and the threshold lies half-way
between the mean scores of the two training sets.

The alphabet has a fixed number of symbols, so the table of three-character
grams has at most ALPHABET ** 3 rows, whatever the corpus: it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.names import set_aside
from tessera.llm.store import cut, table

# The rules of the query (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Characters of the models besides a to z, 0 for all digits, ^ before the URL and * for all others.
SIGNS = ":/.?#=&_%-~+"
OTHERS = "[^a-z0:/.?#=&_%~+-]"
ALPHABET = 26 + len(SIGNS) + 3
BACKING = 4.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-case host after ://, and the path after it; empty for other texts and null."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def add_rule(df: DataFrame, url: str, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds the strings host, path, rule and _by_rule (its verdict), the last two null where no rule fits.

    A rule fits its host and all subdomains, for paths that begin with its
    path. The longest wins, among equally long ones the first by alphabet.
    """
    host, path = host_and_path(F.col(url))
    df = df.withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("_by_rule", verdict)


def symbols(url: Column) -> Column:
    """The URL in the models' alphabet, after two marks of the beginning."""
    low = F.regexp_replace(F.translate(url, UPPER, LOWER), "[0-9]", "0")
    return F.concat(F.lit("^^"), F.regexp_replace(low, OTHERS, "*"))


def grams(df: DataFrame, url: str) -> DataFrame:
    """A row with the column gram for each character: it and the two before it."""
    s = df.withColumn("_s", symbols(F.col(url))).where("length(_s) > 2")
    return s.withColumn("gram", F.explode(F.expr("transform(sequence(1, length(_s) - 2), i -> substring(_s, i, 3))"))).drop("_s")


def gram_scores(urls: DataFrame, url: str, accepted: Column, rejected: Column) -> DataFrame:
    """The log-likelihood difference of each gram of urls; rows (gram, score)."""
    counts = grams(urls, url).groupBy("gram").agg(F.count_if(accepted).cast("double").alias("n0"), F.count_if(rejected).cast("double").alias("n1"))
    ab, b, bc, c = F.substring("gram", 1, 2), F.substring("gram", 2, 1), F.substring("gram", 2, 2), F.substring("gram", 3, 1)
    logs = []
    for n in ("n0", "n1"):  # at most ALPHABET ** 3 rows
        total = lambda *by, n=n: F.sum(n).over(Window.partitionBy(*by))
        p1 = (total(c) + 1.0) / (total(F.lit(0)) + float(ALPHABET))
        p2 = (total(bc) + BACKING * p1) / (total(b) + BACKING)
        p3 = (F.col(n) + BACKING * p2) / (total(ab) + BACKING)
        logs.append(F.log(p3))
    return counts.select("gram", (logs[0] - logs[1]).alias("score"))


def judge(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and score.

    The verdict is the rule's or, without one, block where the score lies
    below the threshold. URLs without characters, null ones, and all URLs if
    rules accept or reject none, are allowed. Equal URLs count once in the
    models and get equal scores. Columns of df with the names of those added
    are replaced, without regard to letter case; url must not be one
    of them, nor have the name of an own column (ValueError).
    An URL of any length is scored whole, as one row for each character while
    it is.
    """
    added = ["host", "path", "rule", "verdict", "score"]
    if url.lower() in {*added, "_url", "_by_rule", "_limit", "_of"}:
        raise ValueError("name the column of URLs otherwise")
    safe, back = set_aside(df.select(*(c for c in df.columns if c.lower() not in added)), "_url", "_by_rule", "_limit", "_of")
    ruled = add_rule(safe.withColumn("_of", F.col(url)), "_of", rules)
    distinct = cut(ruled.select(F.col("_of").alias("_url"), F.col("_by_rule").alias("_v")).where("_url IS NOT NULL").distinct())
    model = cut(gram_scores(distinct, "_url", F.col("_v") == "allow", F.col("_v") == "block"))
    scored = grams(distinct, "_url").join(F.broadcast(model), "gram").groupBy("_url", "_v").agg(F.avg("score").alias("score"))
    scores = cut(scored)
    mean = lambda v: F.avg(F.when(F.col("_v") == v, F.col("score")))
    limit = scores.agg(((mean("allow") + mean("block")) / 2).alias("_limit"))
    joined = ruled.join(scores.drop("_v"), F.col("_of") == F.col("_url"), "left").crossJoin(F.broadcast(limit))  # one row
    verdict = F.coalesce("_by_rule", F.when(F.col("score") < F.col("_limit"), "block").otherwise("allow"))
    return back(joined.withColumn("verdict", verdict).select(*safe.columns, *added))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
