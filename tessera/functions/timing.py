"""Ages, freshness and calendars as column expressions."""

from __future__ import annotations

from collections.abc import Collection
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.params import Freshness


def minutes_between(later: Column, earlier: Column) -> Column:
    """With microseconds, as a double."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 6e7


def freshness(observed: Column, now: Column, p: Freshness = Freshness()) -> Column:
    """fresh, delayed, stale, or n/a without an observation; one from the future is stale."""
    age = minutes_between(now, observed)
    return F.when(observed.isNull(), "n/a").when(age < -p.skew_min, "stale").when(age <= p.fresh_min, "fresh").when(age <= p.delayed_min, "delayed").otherwise("stale")


def whole_age(observed: Column, now: Column, p: Freshness = Freshness()) -> Column:
    """Minutes rounded up, 0 at least; null too far in the future."""
    age = minutes_between(now, observed)
    return F.when(age >= -p.skew_min, F.greatest(F.lit(0), F.ceil(age)).cast("int"))


def iso_weekday(day: Column) -> Column:
    return F.weekday(day) + 1


def half_up_level(score: Column) -> Column:
    """floor(x + 0.5), kept within levels 1 to 4; null for null."""
    return F.when(score.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(4), F.floor(score + 0.5).cast("int"))))


def hhmm_minute(code: Column) -> Column:
    """Minute of the day for HH or HHMM; null otherwise."""
    ok = code.rlike("^([01][0-9]|2[0-3])([0-5][0-9])?$")
    minute = F.when(F.length(code) == 4, F.substring(code, 3, 2).cast("int")).otherwise(0)
    return F.when(ok, F.substring(code, 1, 2).cast("int") * 60 + minute)


def zoned_time(text: Column) -> Column:
    """ISO 8601 text with an offset as a moment; null without one."""
    zoned = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})$")
    seconds = F.regexp_replace(text, "^(.{16})(?=[Z+-])", "$1:00")  # which may be left out
    return F.when(zoned, F.try_to_timestamp(F.regexp_replace(seconds, "([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")))


#: Fixed value: minutes inside an hour at which flows are recorded.
FLOW_MINUTES = (0, 20, 40)


def flow_minute(code: Column) -> Column:
    """Minute of the day for the codes of flow files, which are hours or thirds of them; null otherwise."""
    minute = hhmm_minute(code)
    return F.when((minute % 60).isin(*FLOW_MINUTES), minute)


def hour_of(minute: Column) -> Column:
    return F.floor(minute / 60).cast("int")


def local_day(at: Column, zone: str = "Asia/Seoul") -> Column:
    """The calendar day of a moment where it was observed."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def minute_list(every: int, offset: int = 0) -> str:
    """The minutes of each hour as a schedule of five fields."""
    if every < 1 or 60 % every:
        raise ValueError("the interval divides an hour")
    if not 0 <= offset < every:
        raise ValueError("the offset lies inside the interval")
    return ",".join(map(str, range(offset, 60, every))) + " * * * *"


def months_between(first: str, last: str, earliest: str | None = None) -> list[str]:
    """All months YYYYMM from first to last, both included."""
    for m in (first, last):
        if len(m) != 6 or not (m.isascii() and m.isdecimal()) or not 1 <= int(m[4:]) <= 12:
            raise ValueError(f"{m!r} isn't a month")
    if first > last or (earliest and first < earliest):
        raise ValueError("the months are out of order")
    count = lambda m: 12 * int(m[:4]) + int(m[4:]) - 1
    return [f"{n // 12:04d}{n % 12 + 1:02d}" for n in range(count(first), count(last) + 1)]


def day_types(first: date, last: date, holidays: Collection[date]) -> list[tuple[date, int, str]]:
    """(day, ISO weekday, type) for each day: working_day, saturday, sunday, public_holiday or long_holiday."""
    from tessera.operators.baseline import holiday_types

    special = holiday_types(holidays)
    days = [first + timedelta(i) for i in range((last - first).days + 1)]
    return [(d, d.isoweekday(), special.get(d) or ("saturday" if d.isoweekday() == 6 else "sunday" if d.isoweekday() == 7 else "working_day")) for d in days]
