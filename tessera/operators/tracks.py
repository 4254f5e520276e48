"""Lines out of ways: runs of points, canonical direction, and runs stitched end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import forget, written


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs(points: Column, inside: Callable[[Column], Column] | None = None) -> Column:
    """The parts of an array of points between those that are null or not inside, of two points at least.

    A point that repeats the one before it is left out.
    """
    seen = F.transform(points, lambda p: F.when(inside(p), p)) if inside else points

    def cut(x: Column) -> Column:
        gaps = F.concat(F.array(F.lit(0)), F.filter(F.transform(x, lambda p, i: F.when(p.isNull(), i + 1)), lambda i: i.isNotNull()), F.array(F.size(x) + 1))
        part = lambda g, k: F.slice(x, F.get(g, k) + 1, F.get(g, k + 1) - F.get(g, k) - 1)
        parts = once(gaps, lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - 2), lambda k: part(g, k)))
        return F.filter(parts, lambda run: F.size(run) >= 2)

    unlike = once(seen, lambda x: F.filter(x, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(x, i - 1))))
    return once(unlike, cut)


def canonical(points: Column) -> Column:
    """The points in the direction that comes first by order."""
    return F.least(points, F.reverse(points))


def canonical_ring(points: Column) -> Column:
    """A closed run from its least point on, in the direction that comes first."""

    def turned(p: Column) -> Column:
        ring = F.slice(p, 1, F.size(p) - 1)
        start = F.array_position(ring, F.array_min(ring)).cast("int")
        return F.concat(F.slice(ring, start, F.size(ring)), F.slice(ring, 1, start))

    return F.least(turned(points), turned(F.reverse(points)))


def line_parts(members: DataFrame, ways: DataFrame, wanted: Column, inside: Callable[[Column], Column] | None = None) -> DataFrame:
    """Distinct canonical runs (line_id, points) of the ways that lines have as members.

    members: (line_id, way_id and what wanted tells by); ways: (way_id,
    points). Members without a way, and ways without a run, give nothing.
    """
    met = members.where(wanted).select("line_id", "way_id").distinct().join(ways, "way_id")
    parts = met.select("line_id", F.explode(runs(F.col("points"), inside)).alias("points"))
    return parts.select("line_id", canonical(F.col("points")).alias("points")).distinct()


def successors(darts: DataFrame) -> DataFrame:
    """(dart, to): the dart that goes on where one ends, if exactly one other part ends there.

    A part is two darts, one for each direction: 2 * part and 2 * part + 1.
    """
    degree = darts.groupBy("line_id", F.col("tail").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    joint = degree.where("n = 2").select("line_id", "at")
    out = darts.select("line_id", F.col("tail").alias("at"), F.col("dart").alias("to")).join(joint, ["line_id", "at"])
    ends = darts.select("line_id", F.col("head").alias("at"), "dart")
    return ends.join(out, ["line_id", "at"]).where(F.col("to") != F.col("dart").bitwiseXOR(F.lit(1).cast("long"))).select("dart", "to")


def ranked(hops: DataFrame) -> DataFrame:
    """(dart, last, rank, low) for hops (dart, to), by jumps of doubled length. A written table.

    last is the end of the dart's chain and rank the darts from it to there,
    itself included. Darts on a ring have no last; low is the least of them.
    Unfinished darts alone go on; when as many steps are done as there are
    unfinished darts, those can only be on rings.
    """
    state = written(hops.select("dart", "to", F.col("dart").alias("last"), F.lit(1).cast("long").alias("rank"), F.col("dart").alias("low")))
    done, steps = [], 1
    while True:
        finished = written(state.where("to IS NULL"))
        done.append(finished)
        left = state.where("to IS NOT NULL")
        n = left.count()
        if steps >= n:
            done.append(written(left))
            forget(state)
            break
        ahead = state
        for f in done[:-1]:
            ahead = ahead.union(f)
        ahead = ahead.select(F.col("dart").alias("to"), F.col("to").alias("_to"), F.col("last").alias("_last"), F.col("rank").alias("_rank"), F.col("low").alias("_low"))
        after = written(left.join(ahead, "to").select("dart", F.col("_to").alias("to"), F.col("_last").alias("last"), (F.col("rank") + F.col("_rank")).alias("rank"), F.least("low", "_low").alias("low")))
        forget(state)
        state, steps = after, 2 * steps
    out = done[0]
    for f in done[1:]:
        out = out.union(f)
    out = written(out.select("dart", F.when(F.col("to").isNull(), F.col("last")).alias("last"), "rank", "low"))
    forget(*done)
    return out


def stitched(parts: DataFrame) -> DataFrame:
    """Runs (line_id, points, parts, closed) out of parts (line_id, points): those that meet end to end, where no third ends, are one.

    Chains are found by list ranking, so rounds follow the logarithm of the
    longest one. Paths have the direction that comes first; rings begin at
    their least point. Equal parts count once, in whichever direction. closed
    says whether a run ends where it begins.
    """
    whole = parts.select("line_id", canonical(F.col("points")).alias("points")).where("size(points) >= 2").distinct()
    whole = written(whole.withColumn("part", F.monotonically_increasing_id()))
    first, last = F.get("points", F.lit(0)), F.element_at("points", -1)
    forward = whole.select("line_id", (F.col("part") * 2).alias("dart"), first.alias("tail"), last.alias("head"))
    darts = written(forward.union(forward.select("line_id", F.col("dart") + 1, F.col("head"), F.col("tail"))))
    hops = written(darts.select("dart").join(successors(darts), "dart", "left"))
    rank = ranked(hops)
    rings = rank.where("last IS NULL").select("dart", "low")
    opened = hops.join(rings, "dart").select("dart", F.when(F.col("to") != F.col("low"), F.col("to")).alias("to"))  # cut before its least dart
    again = ranked(opened)
    chains = rank.where("last IS NOT NULL").select("dart", "last", "rank", F.lit(False).alias("ring")).union(again.select("dart", "last", "rank", F.lit(True)))
    # a chain stands twice, once for each direction; that with the first direction of its least part is taken
    taken = chains.groupBy("last").agg(F.min("dart").alias("low")).where("low % 2 = 0").select("last")
    rows = chains.join(taken, "last").withColumn("part", F.shiftright("dart", 1)).join(whole, "part")
    way = F.when(F.col("dart") % 2 == 0, F.col("points")).otherwise(F.reverse("points"))
    made = rows.groupBy("line_id", "last", "ring").agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("at"), way.alias("points")))).alias("x"))
    joined = F.flatten(F.transform("x", lambda x, i: F.when(i == 0, x.points).otherwise(F.slice(x.points, 2, F.size(x.points)))))
    made = made.select("line_id", joined.alias("points"), F.size("x").alias("parts"), "ring")
    out = made.select("line_id", F.when(F.col("ring"), canonical_ring(F.col("points"))).otherwise(canonical(F.col("points"))).alias("points"), "parts")
    out = written(out.withColumn("closed", F.get("points", F.lit(0)) == F.element_at("points", -1)))
    forget(whole, darts, hops, rank, again)
    return out
