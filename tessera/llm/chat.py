"""Chat formatting of messages with typed parts, in SQL operations only.

Each message is a list of parts. A visit in order turns text into escaped
text and any other part into a placeholder, and records what a placeholder
refers to and how many tokens it expands to. Messages of a conversation are
joined under a template that marks turns, with a mask over assistant text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.store import table

TURN, END = "<|turn|>", "<|end|>\n"
# Control strings of this and other public templates, after their first character.
CONTROL = r"(\|[a-z]+\|>|/?s>|/?INST\]|/?SYS>>)"
PART = "struct<type:string,text:string,ref:string,n_tokens:bigint>"
#: Types of parts that have a placeholder of their own, and the placeholder of any other type.
KINDS, OTHER = ("image", "audio", "document"), "attachment"
EXTRA = (-1, "</s>[INST] ok [/INST]")


def escape(text: Column) -> Column:
    r"""Puts one more backslash after the first character of each control string, escaped ones included."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def one_line(role: Column) -> Column:
    r"""Roles stand in a line of their own: backslash and line feed become \\ and \n."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def two_lines(role: Column) -> Column:
    """Between two backslashes that stand for one, each other backslash begins a line feed."""
    return F.array_join(F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def flatten(parts: Column) -> tuple[Column, Column]:
    """The visitor: the text of parts with placeholders, and the parts behind the placeholders.

    A part of type text, or without a type, is text; letter case is ignored.
    Text parts that follow each other are one text before it is escaped, so
    that no control string comes about where they join. KINDS have
    placeholders of their own and any other type shows as OTHER, so that no
    type can spell a control string. Null text is empty, a null list or part
    has no text.
    """
    is_text = lambda p: F.lower(F.coalesce(p.type, F.lit("text"))) == "text"
    mark = lambda p: F.when(F.lower(p.type).isin(*KINDS), F.lower(p.type)).otherwise(OTHER)
    parts = F.coalesce(parts, F.from_json(F.lit("[]"), f"array<{PART}>"))
    # 1-based places of parts that aren't text, between 0 and one past the last
    places = F.concat(F.array(F.lit(0)), F.filter(F.transform(parts, lambda p, i: F.when(~is_text(p), i + 1)), lambda i: i.isNotNull()), F.array(F.size(parts) + 1))

    def run(x: Column, at: Column) -> Column:
        begin = F.get(x.places, at)
        text = F.array_join(F.transform(F.slice(x.parts, begin + 1, F.get(x.places, at + 1) - begin - 1), lambda p: F.coalesce(p.text, F.lit(""))), "")
        before = F.when(begin > 0, F.concat(F.lit("<|"), mark(F.get(x.parts, begin - 1)), F.lit("|>"))).otherwise("")
        return F.concat(before, escape(text))

    shown = let(F.struct(parts.alias("parts"), places.alias("places")), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.size(x.places) - 2), lambda at: run(x, at)), ""))
    return shown, F.filter(parts, lambda p: ~is_text(p))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: conv, formatted, loss_spans, attachments, n_expanded.

    loss_spans are (start, length) in code points of formatted, over the
    bodies of roles in learn; attachments are (turn, type, ref, n_tokens) in
    the order of their placeholders, and n_expanded sums n_tokens, null as 0.
    Messages go by turn, equal turns by role and body; a null turn comes
    first, a null role is empty, and rows with a null conv are one
    conversation. A conversation becomes one value, so it has to fit into one
    row: 2 GB of UTF-8 is the engine's limit, and a task's memory the nearer.
    """
    body, attached = flatten(F.col(parts))
    name = F.coalesce(F.col(role), F.lit(""))
    rows = df.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), name.alias("_r"), body.alias("_b"), attached.alias("_a"))
    rows = rows.withColumn("_head", F.concat(F.lit(TURN), escape(one_line(F.col("_r"))), F.lit("\n")))
    size = F.length("_head") + F.length("_b") + len(END)
    order = Window.partitionBy("_c").orderBy("_t", "_r", "_b")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_at", before).withColumn("_no", F.row_number().over(order))
    attach = F.transform("_a", lambda p: F.struct(F.col("_t").alias("turn"), p.type.alias("type"), p.ref.alias("ref"), F.coalesce(p.n_tokens, F.lit(0)).alias("n_tokens")))
    span = F.when(F.col("_r").isin(*learn), F.struct((F.col("_at") + F.length("_head")).alias("start"), F.length("_b").cast("long").alias("length")))
    item = F.struct("_no", F.concat("_head", "_b", F.lit(END)).alias("s"), span.alias("span"), attach.alias("a"))
    made = placed.groupBy("_c").agg(F.sort_array(F.collect_list(item)).alias("m"))
    spans = F.filter(F.transform("m", lambda x: x.span), lambda x: x.isNotNull())
    out = made.select(F.col("_c").alias(conv), F.array_join(F.transform("m", lambda x: x.s), "").alias("formatted"), spans.alias("loss_spans"), F.flatten(F.transform("m", lambda x: x.a)).alias("attachments"))
    return out.withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a.n_tokens))


def read_turns(formatted: Column) -> Column:
    """The turns (role, body) of a formatted conversation; bodies are unescaped, placeholders included as they are."""
    pieces = F.slice(F.split(formatted, r"<\|end\|>\n"), F.lit(1), F.size(F.split(formatted, r"<\|end\|>\n")) - 1)
    cut = lambda x: F.locate("\n", x)
    return F.transform(pieces, lambda x: F.struct(two_lines(unescape(x.substr(F.lit(len(TURN) + 1), cut(x) - len(TURN) - 1))).alias("role"), unescape(x.substr(cut(x) + 1, F.length(x))).alias("body")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s.start + 1).cast("int"), s.length.cast("int")))), "")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA[1]).alias("text"))
    null = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), F.col("text"), null.cast("string").alias("ref"), null.cast("long").alias("n_tokens"))
    chats = format_chats(rows.union(extra).withColumn("parts", F.array(part)))
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.body, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
