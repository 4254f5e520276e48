"""Names, phones and addresses in comparable form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def search_term(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def national_phone(text: Column) -> Column:
    """Digits with the country code 82 as 0; null where none are left."""
    d = digits(text)
    return F.nullif(F.when(d.startswith("82"), F.concat(F.lit("0"), F.substring(d, 3, 40))).otherwise(d), F.lit(""))


def strict_phone(text: Column, least: int = 9) -> Column:
    """Digits of texts that hold signs of phone numbers only and enough digits; else null."""
    return F.when(text.rlike(r"^[0-9+() .-]+$") & (F.length(digits(text)) >= least), national_phone(text))


def plain_name(text: Column) -> Column:
    """Letters and digits in lower case, for texts that are composed already."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


@F.pandas_udf(StringType())
def folded_name(texts: pd.Series) -> pd.Series:
    """Letters and digits after NFKC and case folding; for dimension tables, as no built-in composes."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum()))


def with_folded_name(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: letters and digits of text after NFKC and case folding; texts of ASCII and Hangul syllables don't leave the engine."""
    plain = F.col(text).rlike(r"^[\x09-\x0D\x20-\x7E가-힣]*$")
    quick = F.regexp_replace(F.lower(text), "[^0-9a-z가-힣]", "")
    return df.withColumn(out, F.when(plain, quick).otherwise(folded_name(F.when(~plain, F.col(text)))))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def without_tags(text: Column) -> Column:
    """Without bold tags, and the five named entities as characters."""
    out = F.regexp_replace(text, "</?b>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out
