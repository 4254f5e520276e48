"""Addresses, names and numbers of places in comparable form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of the city, and its 25 districts.
CITY = ("서울특별시", "서울시", "서울")
DISTRICTS = "강남구 강동구 강북구 강서구 관악구 광진구 구로구 금천구 노원구 도봉구 동대문구 동작구 마포구 서대문구 서초구 성동구 성북구 송파구 양천구 영등포구 용산구 은평구 종로구 중구 중랑구".split()
#: A street's name ends in one of two words, and the building's number, with or without a second one, follows it.
STREET, NUMBER = "[0-9가-힣·]*[0-9가-힣·][로길]", "[1-9][0-9]*"
#: What may follow the number: counted things, which are floors, rooms or blocks of a building.
COUNT = "제? ?[0-9]+ ?"
FLOOR, ROOM, BLOCK = f"(?:지하|지상)?{COUNT}층|b ?[0-9]+ ?층|옥탑층", f"{COUNT}호", f"(?:{COUNT}|[a-z] ?)동"
DETAIL = f"(?:{FLOOR}|{ROOM}|{BLOCK})"
#: Stands for a parenthesis with its content.
ASIDE = "\x01"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    """NFKC and case folding, for which there is no built-in function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def with_entity_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: text after NFKC and case folding, white space collapsed; null if nothing is left. Signs stay.

    Texts of ASCII and Hangul syllables alone are lower-cased by the engine;
    only others go through Python.
    """
    plain = F.col(text).rlike(r"^[\x09-\x0D\x20-\x7E가-힣]*$")
    made = F.when(plain, F.lower(text)).otherwise(_composed(F.when(~plain, F.col(text))))
    return df.withColumn(out, F.nullif(F.trim(F.regexp_replace(made, r"(?U)\s+", " ")), F.lit("")))


def without_asides(text: Column) -> Column:
    """Text with ASIDE for each outermost parenthesis, however deep others nest in it; null if one is open, unopened or holds nothing but space."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("held"), F.lit(True).alias("ok"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        opens, closes = c == "(", c == ")"
        inside = s.depth > 0
        depth = s.depth + F.when(opens, 1).when(closes, -1).otherwise(0)
        held = F.when(inside & ~opens & ~closes, s.held | (F.trim(c) != "")).when(opens & ~inside, F.lit(False)).otherwise(s.held)
        ok = s.ok & ~(closes & (~inside | ((depth == 0) & ~s.held)))
        out = F.when(closes & (depth == 0), F.concat(s.out, F.lit(ASIDE))).when(inside | opens | closes, s.out).otherwise(F.concat(s.out, c))
        return F.struct(depth.alias("depth"), held.alias("held"), ok.alias("ok"), out.alias("out"))

    done = lambda s: F.when(s.ok & (s.depth == 0), s.out)
    return F.when(text.contains("(") | text.contains(")"), F.aggregate(F.split(text, ""), start, step, done)).otherwise(text)


def ignorable(suffix: Column) -> Column:
    """Whether what follows a building's number is only floors, rooms, blocks and text in parentheses, which may be nested."""
    return F.coalesce(without_asides(F.trim(suffix)).rlike(f"^(?:(?:, ?)?(?:{ASIDE}|{DETAIL}) ?)*$"), F.lit(False))


def road_address(entity: Column) -> Column:
    """The struct (district, road, main, sub) of a road address in the city, from entity text; null if any part is otherwise.

    The first two words name the city and a district; the rest begins with a
    street and a number.
    """
    word = lambda i: F.get(F.split(entity, " ", 3), F.lit(i))
    rest = f"^({STREET}) ?({NUMBER})(?:-({NUMBER}))?(.*)$"
    part = lambda i: F.regexp_extract(word(2), rest, i)
    made = F.struct(word(1).alias("district"), part(1).alias("road"), part(2).cast("int").alias("main"), F.nullif(part(3), F.lit("")).cast("int").alias("sub"))
    named = word(0).isin(*CITY) & word(1).isin(DISTRICTS)
    return F.when(named & word(2).rlike(rest) & ignorable(part(4)), made)


def address_core(entity: Column) -> Column:
    """Letters and digits of an address without city and district; null without a letter or without a digit."""
    parts = F.split(entity, " ")
    city = F.get(parts, F.lit(0)).isin(*CITY)
    parts = F.when(city, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    district = F.coalesce(F.get(parts, F.lit(0)).endswith("구"), F.lit(False))
    parts = F.when(district, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    core = F.regexp_replace(F.array_join(parts, ""), r"[^\p{L}\p{N}]", "")
    return F.when(core.rlike(r"\p{L}") & core.rlike(r"\p{Nd}"), core)


def truncated(text: Column, most: int) -> Column:
    """At most so many characters; blank text is null."""
    return F.nullif(F.substring(F.trim(text), 1, most), F.lit(""))


def station_name(text: Column) -> Column:
    """Without white space, in lower case, without the word for station at the end."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)\s", "")), "역$", "")


def exit_number(ref: Column, *texts: Column) -> Column:
    """The number of an exit: ref if it is one, else the first in one of the texts before the word for exit."""
    found = F.when(F.trim(ref).rlike(r"^[0-9]{1,2}(-[0-9]{1,2})?$"), F.trim(ref))
    for t in texts:
        found = F.coalesce(found, F.nullif(F.regexp_extract(t, r"([0-9]{1,2}(?:-[0-9]{1,2})?)\s*번?\s*(?:출구|출입구)", 1), F.lit("")))
    return found


# Forms of the fields of population and flow files.
FORMS = {
    "date": r"^[0-9]{8}$",
    "hour": r"^([01][0-9]|2[0-3])$",
    "code": r"^[0-9]{8}$",
    "cell": r"^[가-힣]{2}[0-9]{8}$",
    "decimal": r"^[0-9]+(\.[0-9]+)?$",
}


def well_formed(text: Column, form: str) -> Column:
    """Whether a text has one of FORMS; a date has to be one of the calendar."""
    ok = text.rlike(FORMS[form])
    if form == "date":
        ok = ok & F.try_to_timestamp(text, F.lit("yyyyMMdd")).isNotNull()
    return F.coalesce(ok, F.lit(False))
