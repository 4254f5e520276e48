"""Trials of models and sources: paired promotion, weekly stability, same-day screens, held-out repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import params
from tessera.operators import audit, flows, stats

POINT = ["cafe_id", "observed_at", "slot"]
SEGMENTS = ("overall", "covered", "fringe")


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def passed(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows (check, passed) from one row; an undefined condition fails."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), holds(c).alias("passed")) for n, c in checks.items()])))


def promotion(baseline: DataFrame, challenger: DataFrame, p: params.Promotion = params.Promotion()) -> DataFrame:
    """Checks (check, passed) whether a challenger may replace the baseline; `promoted` says whether all pass.

    Both have the columns cafe_id, observed_at, slot, truth, score, level and
    coverage. Metrics are over points that both predict: the mean of the
    slots' rank correlations, and the share of levels at most one off.
    Coverage segments are the baseline's. Points that one side lacks, other
    truths under one key and repeated keys fail identical_primary_rows; points
    without a slot count for levels only.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*POINT).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.max(F.struct("truth", "score", "level", "coverage")).alias(name))

    b, c = side(baseline, "b"), side(challenger, "c").withColumnsRenamed({k: f"_{k}" for k in POINT})
    both = b.join(c, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in POINT]), "full")
    valid = {s: F.col(f"{s}.score").isNotNull() & F.col(f"{s}.level").isNotNull() for s in "bc"}
    same = F.col("b").isNotNull() & F.col("c").isNotNull() & (F.col("b_n") == 1) & (F.col("c_n") == 1) & F.col("b.truth").eqNullSafe(F.col("c.truth"))
    counts = both.agg(F.count_if(~holds(same)).alias("unlike"), F.count_if(valid["b"] & ~valid["c"]).alias("lost"))

    segment = F.when(F.col("b.coverage").isin(*SEGMENTS[1:]), F.array(F.lit(SEGMENTS[0]), F.col("b.coverage"))).otherwise(F.array(F.lit(SEGMENTS[0])))
    rows = both.where(valid["b"] & valid["c"]).select(F.explode(segment).alias("segment"), "slot", F.col("b.truth").alias("truth"), *[F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in "bc" for k in ("score", "level")])
    near = lambda s: F.avg((F.abs(F.col(f"{s}_level") - F.col("truth")) <= 1).cast("double"))
    table = rows.groupBy("segment").agg(*[F.round(near(s), 9).alias(f"{s}_near") for s in "bc"])
    for s in "bc":
        rho = stats.spearman(rows.where("slot <> ''"), ["segment", "slot"], f"{s}_score", "truth")
        table = table.join(rho.groupBy("segment").agg(F.round(F.avg("rho"), 9).alias(f"{s}_rho")), "segment", "left")
    metrics = [f"{s}_{m}" for s in "bc" for m in ("rho", "near")]
    flat = table.agg(*[F.max(F.when(F.col("segment") == g, F.col(m))).alias(f"{g}_{m}") for g in SEGMENTS for m in metrics])
    gain = {(g, m): F.col(f"{g}_c_{m}") - F.col(f"{g}_b_{m}") for g in SEGMENTS for m in ("rho", "near")}
    steady = lambda g: (gain[g, "rho"] >= -p.max_regression) & (gain[g, "near"] >= -p.max_regression)
    fringe = gain["fringe", "rho"].isNotNull() & gain["fringe", "near"].isNotNull() & ((gain["fringe", "rho"] > 0) | (gain["fringe", "near"] > 0))
    checks = {
        "identical_primary_rows": F.col("unlike") == 0,
        "no_coverage_loss": F.col("lost") == 0,
        "overall_spearman": (F.col("overall_c_rho") >= p.min_spearman) & (gain["overall", "rho"] >= 0),
        "overall_adjacent_accuracy": (F.col("overall_c_near") >= p.min_adjacent) & (gain["overall", "near"] >= 0),
        "covered_no_serious_regression": steady("covered"),
        "fringe_no_serious_regression": steady("fringe"),
        "fringe_improvement_evidence": fringe,
    }
    checks["promoted"] = reduce(Column.__and__, map(holds, checks.values()))
    # one row each
    return passed(counts.crossJoin(flat), checks)


def weekly_stability(moves: DataFrame, centroids: DataFrame, p: params.Stability = params.Stability()) -> DataFrame:
    """One row for each hour and pair of days a week apart: likeness of balances, tails, purposes and directions.

    Flows have an observed_date. Zones of one day only are counted as
    unmatched and left out of the rest. An undefined correlation is null.
    """
    pair = ["first_date", "hour"]
    heading = flows.direction(moves, centroids, ["observed_date"]).drop("eligible")
    m = flows.net_flow(moves, ["observed_date"]).where(F.col("hour").isin(*p.hours)).join(heading, ["observed_date", "zone_id", "hour"], "left")
    fields = ["inbound", "outbound", "net", "coverage", "strength", "bearing"]
    a = m.select(F.col("observed_date").alias("first_date"), "hour", "zone_id", *[F.col(f).alias(f"a_{f}") for f in fields])
    b = m.select(F.date_sub("observed_date", 7).alias("first_date"), "hour", "zone_id", *[F.col(f).alias(f"b_{f}") for f in fields])
    joined = a.join(b, [*pair, "zone_id"], "full")
    met = F.col("a_net").isNotNull() & F.col("b_net").isNotNull()
    unmatched = joined.groupBy(*pair).agg(F.count_if(~met).alias("unmatched"))

    w = Window.partitionBy(*pair)
    z = joined.where(met).withColumn("_tail", F.ceil(F.count(F.lit(1)).over(w) * F.lit(p.tail)))
    for s in "ab":
        for f in fields[:3]:
            z = stats.average_rank(z, pair, f"{s}_{f}", f"_{s}_{f}")
        for name, order in (("top", F.desc(f"{s}_net")), ("bottom", F.asc(f"{s}_net"))):
            z = z.withColumn(f"_{s}_{name}", F.row_number().over(w.orderBy(order, "zone_id")) <= F.col("_tail"))
    steady = [(F.col(f"{s}_coverage") >= p.known_share) & (F.col(f"{s}_strength") >= p.strength) & F.col(f"{s}_bearing").isNotNull() for s in "ab"]
    eligible = holds(steady[0] & steady[1])
    angle = F.when(eligible, audit.angle_gap(F.col("a_bearing"), F.col("b_bearing")))
    out = z.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("zones"),
        *[F.round(stats.pearson(F.col(f"_a_{f}"), F.col(f"_b_{f}")), 9).alias(f"{f}_rho") for f in fields[:3]],
        *[F.round(F.count_if(F.col(f"_a_{t}") & F.col(f"_b_{t}")) / F.count_if(F.col(f"_a_{t}") | F.col(f"_b_{t}")), 9).alias(f"{t}_jaccard") for t in ("top", "bottom")],
        F.round(F.count_if(eligible) / F.count(F.lit(1)), 9).alias("eligible_share"),
        F.round(F.median(angle), 6).alias("angle_median"),
        F.round(F.percentile(angle, F.lit(0.9)), 6).alias("angle_p90"),
        F.round(F.avg((angle <= 45).cast("double")), 9).alias("within_45"),
        F.round(F.median(F.when(eligible, F.abs(F.col("a_strength") - F.col("b_strength")))), 9).alias("strength_change"),
    )
    q = moves.groupBy("observed_date", F.col("arrival_hour").alias("hour"), "purpose").agg(F.sum("flow").alias("flow")).where(F.col("hour").isin(*p.hours))
    first = q.select(F.col("observed_date").alias("first_date"), "hour", "purpose", F.col("flow").alias("p"))
    later = q.select(F.date_sub("observed_date", 7).alias("first_date"), "hour", "purpose", F.col("flow").alias("q"))
    js = stats.js_distance(first.join(later, [*pair, "purpose"], "full").na.fill(0.0, ["p", "q"]), pair, "p", "q")
    return out.join(unmatched, pair).join(js.withColumn("js_distance", F.round("js_distance", 9)), pair)


def stability_verdict(pairs: DataFrame, p: params.Stability = params.Stability()) -> DataFrame:
    """One row over weekly_stability's: scalar (supported, conditional, not_supported), purpose and vector verdicts.

    Unmatched zones and undefined correlations leave the scalar verdict unsupported.
    """
    middle = {c: F.median(c) for c in ("net_rho", "inbound_rho", "outbound_rho", "top_jaccard", "bottom_jaccard", "js_distance")}
    whole = reduce(Column.__and__, [F.count(c) == F.count(F.lit(1)) for c in ("net_rho", "inbound_rho", "outbound_rho")]) & (F.sum("unmatched") == 0)
    tails = (middle["top_jaccard"] >= p.tail_jaccard) & (middle["bottom_jaccard"] >= p.tail_jaccard)
    supported = whole & tails & (middle["net_rho"] >= p.net_median) & (F.min("net_rho") >= p.net_least) & (middle["inbound_rho"] >= p.flow_median) & (middle["outbound_rho"] >= p.flow_median)
    conditional = whole & (middle["net_rho"] >= p.conditional_median) & (F.min("net_rho") >= p.conditional_least)
    stable = (middle["js_distance"] <= p.purpose_median) & (F.percentile("js_distance", F.lit(0.9)) <= p.purpose_p90)
    angles = (F.count("angle_median") == F.count(F.lit(1))) & (F.max("angle_median") <= p.angle_median) & (F.max("angle_p90") <= p.angle_p90)
    usable = angles & (F.min("eligible_share") >= p.eligible_share) & (F.min("within_45") >= p.within_45) & (F.max("strength_change") <= p.strength_change)
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("unmatched").alias("unmatched"),
        *[F.round(c, 9).alias(f"{n}_median") for n, c in middle.items()],
        F.min("net_rho").alias("net_rho_least"),
        F.when(holds(supported), "supported").when(holds(conditional), "conditional").otherwise("not_supported").alias("scalar"),
        F.when(holds(stable), "stable").otherwise("not_stable").alias("purpose"),
        F.when(holds(usable), "usable").otherwise("not_usable").alias("vector"),
    )


def paired_cells(stock: DataFrame, hours: tuple[int, ...]) -> DataFrame:
    """Cells of a zone at each hour wanted, beside the hour before (step -1) or after it (step 1).

    Sides are 0, the earlier hour, and 1, the later one: n0 and n1 rows, k0
    and k1 known people, m0 and m1 masked rows. A cell that one side lacks has n of 0 there.
    """
    ends = [(h, step, side, h + (step if (step > 0) == bool(side) else 0)) for h in hours for step in (-1, 1) for side in (0, 1)]
    at = F.array(*[F.struct(F.lit(h).alias("at"), F.lit(step).alias("step"), F.lit(side).alias("side"), F.lit(t).alias("t")) for h, step, side, t in ends])
    rows = stock.select("observed_date", "zone_id", "cell_id", "hour", "masked", "population", F.inline(at)).where("hour = t")
    known = F.when(F.col("masked"), 0.0).otherwise(F.coalesce("population", F.lit(0.0)))
    columns = []
    for s in (0, 1):
        on = F.col("side") == s
        columns += [F.count_if(on).alias(f"n{s}"), F.sum(F.when(on, known).otherwise(0.0)).alias(f"k{s}"), F.count_if(on & F.col("masked")).alias(f"m{s}")]
    return rows.groupBy("observed_date", F.col("at").alias("hour"), "step", "zone_id", "cell_id").agg(*columns)


def same_day(stock: DataFrame, moves: DataFrame, p: params.SameDay = params.SameDay()) -> DataFrame:
    """One row for each day, hour and variant: rank correlations of flows with stocks, and the gates.

    Stocks are rows (observed_date, zone_id, cell_id, hour, masked,
    population). A variant assumes a number of people in a masked cell and in
    one that is absent in one of two hours. rho: net flow with the stock's
    change to the next hour; rho_before: with that from the hour before;
    rho_gross: in and outbound flow with the stock. A zone is compared if it
    has flows and rows at all three hours. Gates: the share of flow zones
    compared, the likeness of adjacent hours' cells, and no repeated cell.
    """
    key = ["observed_date", "hour"]
    cells = paired_cells(stock, p.hours)
    held = cells.groupBy(*key, "step", "cell_id").agg((F.sum("n0") > 0).alias("_0"), (F.sum("n1") > 0).alias("_1"))
    like = held.groupBy(*key, "step").agg((F.count_if(F.col("_0") & F.col("_1")) / F.count(F.lit(1))).alias("j")).groupBy(*key).agg(F.round(F.min("j"), 9).alias("cell_jaccard"))
    repeats = cells.groupBy(*key).agg(F.count_if((F.col("n0") > 1) | (F.col("n1") > 1)).alias("repeated"))

    absent = [F.count_if(F.col(f"n{s}") == 0).alias(f"a{s}") for s in (0, 1)]
    zones = cells.groupBy(*key, "step", "zone_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"{c}{s}").alias(f"{c}{s}") for s in (0, 1) for c in "nkm"], *absent)
    parts = ["n", *[f"{c}{s}" for s in (0, 1) for c in "nkma"]]
    step = lambda c, s: F.max(F.when(F.col("step") == s, F.col(c)))
    wide = zones.groupBy(*key, "zone_id").agg(*[step(c, s).alias(f"{c}_{'next' if s > 0 else 'last'}") for c in parts for s in (-1, 1)])
    full = reduce(Column.__and__, [F.col(f"n{s}_{d}") > 0 for s in (0, 1) for d in ("last", "next")])
    net = flows.net_flow(moves, ["observed_date"]).where(F.col("hour").isin(*p.hours)).select(*key, "zone_id", "net", (F.col("inbound") + F.col("outbound")).alias("gross"))
    both = net.join(wide.where(full), [*key, "zone_id"], "left")
    share = both.groupBy(*key).agg(F.round(F.count("n_next") / F.count(F.lit(1)), 9).alias("code_coverage"))

    variants = F.array(*[F.struct(F.lit(f"mask{m:g}_absent{a:g}").alias("variant"), F.lit(m).alias("_m"), F.lit(a).alias("_a")) for m, a in p.variants])
    at = lambda s, d: F.col(f"k{s}_{d}") + F.col("_m") * F.col(f"m{s}_{d}") + F.col("_a") * F.col(f"a{s}_{d}")
    rows = both.where("n_next IS NOT NULL").select("*", F.inline(variants))
    rows = rows.withColumns({"_next": at(1, "next") - at(0, "next"), "_last": at(1, "last") - at(0, "last"), "_stock": F.col("k0_next") + F.col("_m") * F.col("m0_next")})
    group = [*key, "variant"]
    for c in ("net", "gross", "_next", "_last", "_stock"):
        rows = stats.average_rank(rows, group, c, f"r{c}")
    rho = lambda x, y: F.round(stats.pearson(F.col(f"r{x}"), F.col(f"r{y}")), 9)
    out = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("zones"),
        rho("net", "_next").alias("rho"),
        rho("net", "_last").alias("rho_before"),
        rho("gross", "_stock").alias("rho_gross"),
        F.sum("n_next").alias("cells"),
        F.sum("a0_next").alias("absent_now"),
        F.sum("a1_next").alias("absent_next"),
    )
    gates = (F.col("code_coverage") >= p.code_coverage) & (F.col("cell_jaccard") >= p.cell_jaccard) & (F.col("repeated") == 0)
    return out.join(share, key).join(like, key).join(repeats, key).withColumn("gates", gates).drop("repeated")


def same_day_verdict(rows: DataFrame, p: params.SameDay = params.SameDay()) -> DataFrame:
    """One row a day over same_day's: the primary variant's verdict, and one lower if variants disagree.

    They disagree if an hour's rho varies by more than a bound or their
    verdicts differ. A day whose gates fail is rejected.
    """
    name = f"mask{p.variants[0][0]:g}_absent{p.variants[0][1]:g}"
    middle, positive, whole = F.median("rho"), F.count_if(F.col("rho") > 0), F.count("rho") == len(p.hours)
    screening = whole & (positive == len(p.hours)) & (middle >= p.screening_median)
    conditional = whole & (middle >= p.conditional_median) & (positive >= p.conditional_positive)
    verdict = F.when(holds(screening), "screening").when(holds(conditional), "conditional").otherwise("not_supported")
    each = rows.groupBy("observed_date", "variant").agg(verdict.alias("verdict"), F.round(middle, 9).alias("median"), F.min("rho").alias("least"), positive.alias("positive"), F.count("rho").alias("defined"))
    primary = F.col("variant") == name
    day = each.groupBy("observed_date").agg(F.count_distinct("verdict").alias("_v"), *[F.max(F.when(primary, F.col(c))).alias(c) for c in ("verdict", "median", "least", "positive", "defined")])
    ranges = rows.groupBy("observed_date", "hour").agg(F.when(F.count("rho") == len(p.variants), F.max("rho") - F.min("rho")).alias("_r"), F.bool_and("gates").alias("_g"))
    spread = ranges.groupBy("observed_date").agg(F.round(F.max("_r"), 9).alias("rho_range"), F.bool_and("_g").alias("_g"))
    out = day.join(spread, "observed_date").withColumn("sensitive", holds(F.col("rho_range") > p.rho_range) | (F.col("_v") > 1))
    lower = F.when(F.col("verdict") == "screening", "conditional").otherwise("not_supported")
    final = F.when(~holds(F.col("_g")), "rejected").when(F.col("sensitive"), lower).otherwise(F.col("verdict"))
    return out.select("observed_date", F.col("verdict").alias("base_verdict"), "median", "least", "positive", "defined", "rho_range", "sensitive", final.alias("verdict"))


def held_out(rows: DataFrame, roles: DataFrame, p: params.Repeats = params.Repeats(), day: params.SameDay = params.SameDay()) -> DataFrame:
    """One row over same_day's: whether its relation repeats on the days whose role is held_out.

    Other days, such as that of the discovery, don't count. A day that is
    missing, rejected or without all its rhos leaves the result unsupported.
    """
    days = same_day_verdict(rows, day).join(roles, "observed_date").where("role = 'held_out'")
    name = f"mask{day.variants[0][0]:g}_absent{day.variants[0][1]:g}"
    pooled = rows.where(F.col("variant") == name).join(roles.where("role = 'held_out'"), "observed_date").agg(
        F.count("rho").alias("defined"), F.round(F.median("rho"), 9).alias("median"), F.min("rho").alias("least"), F.count_if(F.col("rho") > 0).alias("positive"))
    one = days.agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("verdict") == "rejected").alias("rejected"),
        F.count_if(F.col("base_verdict") == "screening").alias("screening_days"),
        F.count_if(F.col("base_verdict").isin("screening", "conditional")).alias("conditional_days"),
        holds(F.bool_or("sensitive")).alias("sensitive"),
    ).crossJoin(pooled)  # one row each
    whole = (F.col("days") == p.days) & (F.col("rejected") == 0) & (F.col("defined") == p.days * len(day.hours))
    supported = whole & (F.col("screening_days") == p.days) & (F.col("median") >= p.supported_median) & (F.col("least") > 0)
    conditional = whole & (F.col("conditional_days") >= p.conditional_days) & (F.col("median") >= p.conditional_median) & (F.col("positive") >= p.conditional_positive)
    base = F.when(holds(supported), "supported").when(holds(conditional), "conditional").otherwise("not_supported")
    final = F.when(~F.col("sensitive"), F.col("base_verdict")).when(F.col("base_verdict") == "supported", "conditional").otherwise("not_supported")
    return one.withColumn("base_verdict", base).withColumn("verdict", final)
