"""Baselines by day type and hour with shrinkage, and anomalies against them."""

from __future__ import annotations

import math
from collections.abc import Collection
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.timing import iso_weekday
from tessera.params import Anomaly, Baseline


def holiday_types(holidays: Collection[date]) -> dict[date, str]:
    """Days that a calendar of holidays makes special: long_holiday in a block of three days off or more that holds one, public_holiday otherwise."""
    held, out, one = set(holidays), {}, timedelta(days=1)
    off = lambda d: d in held or d.isoweekday() >= 6
    for day in held:
        first = last = day
        while off(first - one):
            first -= one
        while off(last + one):
            last += one
        n = (last - first).days + 1
        out |= {first + i * one: "long_holiday" for i in range(n)} if n >= 3 else {day: "public_holiday"}
    return out


def nominal_type(weekday: Column) -> Column:
    return F.when(weekday == 6, "saturday").when(weekday == 7, "sunday").otherwise("working_day")


def temporal_baseline(history: DataFrame, cutoff: str, weekday: int, p: Baseline = Baseline(), holidays: Collection[date] | None = None, target: date | None = None) -> DataFrame:
    """For each (cell_id, hour) of history (observed_date, value, masked), the expected value on an ISO weekday.

    Days in the window before cutoff weigh two to the minus age by half-life;
    masked values count as mask_value, all in log1p. Buckets from fine to
    coarse are the weekday, its type (weekday or weekend) and all days. The
    first with min_n days is shrunk toward the next coarser one by its
    effective number; without one the coarsest stands. One pass sums all
    of them.

    With holidays, substitute ones included, the target day counts (cutoff by
    default) and day types are working_day, saturday, sunday, public_holiday
    and long_holiday: the exact bucket is of weekday and type. A target of the
    last two takes the holiday window and half-life, and before all days the
    bucket of its weekday with the type it would have without holidays; an
    empty bucket is passed over as a parent.

    raw_n, effective_n and masked_share, the share of masked rows, are of the
    chosen bucket before it is shrunk; fallback_depth is its place, 0 for the
    finest. A cell, day and hour must have one row (see history_faults).
    """
    window, half_life, special = p.window_days, p.half_life_days, False
    if holidays is not None:
        target = target or date.fromisoformat(cutoff)
        if target.isoweekday() != weekday:
            raise ValueError("the target isn't on that weekday")
        types = holiday_types(holidays)
        if special := target in types:
            window, half_life = p.holiday_window_days, p.holiday_half_life_days
    day = F.lit(cutoff).cast("date")
    age = F.date_diff(day, F.col("observed_date"))
    rows = history.where((age > 0) & (age <= window))
    x = F.log1p(F.when(F.col("masked"), F.lit(p.mask_value)).otherwise(F.col("value")))
    w = F.exp(-math.log(2.0) * age / half_life)
    wd = iso_weekday(F.col("observed_date"))
    member = {"exact": wd == weekday, "type": (wd >= 6) == F.lit(weekday >= 6), "hour": F.lit(True)}
    if holidays is not None:
        kind = nominal_type(wd)
        for name in sorted(set(types.values())):
            kind = F.when(F.col("observed_date").isin([d for d in sorted(types) if types[d] == name]), name).otherwise(kind)
        of = F.lit(types[target]) if special else nominal_type(F.lit(weekday))
        member = {"exact": (wd == weekday) & (kind == of), "type": kind == of}
        if special:
            member["nominal"] = (wd == weekday) & (kind == nominal_type(F.lit(weekday)))
        member["hour"] = F.lit(True)
    rows = rows.select("cell_id", "hour", "masked", x.alias("x"), w.alias("w"), *[m.alias(f"is_{k}") for k, m in member.items()])
    sums = []
    for k in member:
        on = lambda v, k=k: F.sum(F.when(F.col(f"is_{k}"), v).otherwise(0.0))
        sums += [F.count_if(F.col(f"is_{k}")).alias(f"n_{k}"), F.count_if(F.col(f"is_{k}") & F.col("masked")).alias(f"masked_{k}"), on(F.col("w")).alias(f"w_{k}"), on(F.col("w") * F.col("w")).alias(f"ww_{k}"), on(F.col("w") * F.col("x")).alias(f"x_{k}"), on(F.col("w") * F.col("x") * F.col("x")).alias(f"xx_{k}")]
    b = rows.groupBy("cell_id", "hour").agg(*sums)
    for k in member:
        b = b.withColumn(f"mean_{k}", F.try_divide(f"x_{k}", f"w_{k}")).withColumn(f"var_{k}", F.greatest(F.lit(0.0), F.try_divide(f"xx_{k}", f"w_{k}") - F.col(f"mean_{k}") * F.col(f"mean_{k}"))).withColumn(f"neff_{k}", F.try_divide(F.col(f"w_{k}") * F.col(f"w_{k}"), F.col(f"ww_{k}")))

    def shrunk(k: str, parent: str) -> tuple[Column, Column]:
        a = F.col(f"neff_{k}") / (F.col(f"neff_{k}") + p.prior_n)
        mean = a * F.col(f"mean_{k}") + (1.0 - a) * F.col(f"mean_{parent}")
        gap = F.col(f"mean_{k}") - F.col(f"mean_{parent}")
        return mean, a * F.col(f"var_{k}") + (1.0 - a) * F.col(f"var_{parent}") + a * (1.0 - a) * gap * gap

    def pick(of: dict[str, Column]) -> Column:
        out = of["hour"]
        for k in reversed([k for k in member if k != "hour"]):
            out = F.when(F.col(f"n_{k}") >= p.min_n, of[k]).otherwise(out)
        return out

    means, variances = {"hour": F.col("mean_hour")}, {"hour": F.col("var_hour")}
    means["exact"], variances["exact"] = shrunk("exact", "type")
    means["type"], variances["type"] = shrunk("type", "hour")
    if special:
        means["nominal"], variances["nominal"] = shrunk("nominal", "hour")
        near, some = shrunk("type", "nominal"), F.col("n_nominal") > 0
        means["type"], variances["type"] = F.when(some, near[0]).otherwise(means["type"]), F.when(some, near[1]).otherwise(variances["type"])
    return b.select(
        "cell_id",
        "hour",
        pick({k: F.lit(k) for k in member}).alias("bucket"),
        pick({k: F.col(f"n_{k}") for k in member}).alias("raw_n"),
        pick({k: F.col(f"neff_{k}") for k in member}).alias("effective_n"),
        F.expm1(pick(means)).alias("expected"),
        F.sqrt(pick(variances)).alias("dispersion"),
        pick({k: F.try_divide(f"masked_{k}", f"n_{k}") for k in member}).alias("masked_share"),
        pick({k: F.lit(i) for i, k in enumerate(member)}).alias("fallback_depth"),
    )


def history_faults(history: DataFrame) -> DataFrame:
    """Rows of history that teach nothing sound, with fault, the first of: cell, hour, masked_with_value, no_value, value, repeated."""
    v = F.col("value")
    again = history.groupBy("cell_id", "observed_date", "hour").count().where("count > 1").drop("count").withColumn("_again", F.lit(True))
    rows = history.join(again, ["cell_id", "observed_date", "hour"], "left")
    masked = F.coalesce(F.col("masked"), F.lit(False))
    fault = (
        F.when(F.col("cell_id").isNull() | (F.trim(F.col("cell_id").cast("string")) == ""), "cell")
        .when(~F.coalesce(F.col("hour").between(0, 23), F.lit(False)), "hour")
        .when(masked & v.isNotNull(), "masked_with_value")
        .when(~masked & v.isNull(), "no_value")
        .when(~masked & ~F.coalesce((v >= 0) & (v < F.lit(float("inf"))), F.lit(False)), "value")
        .when(F.col("_again"), "repeated")
    )
    return rows.withColumn("fault", fault).where("fault IS NOT NULL").drop("_again")


def anomaly(value: Column, expected: Column, dispersion: Column, p: Anomaly = Anomaly()) -> Column:
    """How far log1p(value) lies from the expectation, by dispersion where there is some, within the cap."""
    gap = F.log1p(value) - F.log1p(expected)
    scaled = F.when(dispersion >= p.min_dispersion, gap / dispersion).otherwise(gap)
    return F.greatest(F.lit(-p.cap), F.least(F.lit(p.cap), scaled))
