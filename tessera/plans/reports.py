"""Statistics, evaluation and service reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stats, temporal
from tessera.plans.registry import query, sql_of
from tessera.sources.adapters import AS_OF, load

RANKS = """r AS (SELECT hotspot_id, rank() OVER (PARTITION BY hotspot_id ORDER BY level) + (count(*) OVER (PARTITION BY hotspot_id, level) - 1) / CAST(2 AS DOUBLE) AS rx,
  rank() OVER (PARTITION BY hotspot_id ORDER BY ppltn_min) + (count(*) OVER (PARTITION BY hotspot_id, ppltn_min) - 1) / CAST(2 AS DOUBLE) AS ry FROM snapshots),
rho AS (SELECT hotspot_id, count(*) AS n, CASE WHEN (count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry)) > 0
  THEN (count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / sqrt((count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry))) END AS rho FROM r GROUP BY hotspot_id)"""


def rhos(spark, sf_dir):
    return stats.spearman(load(spark, sf_dir, "snapshots"), ["hotspot_id"], "level", "ppltn_min")


@query(f"WITH {RANKS} SELECT hotspot_id, n, round(rho, 9) AS rho FROM rho")
def spearman_by_group(spark, sf_dir):
    return rhos(spark, sf_dir).withColumn("rho", F.round("rho", 9))


@query(f"WITH {RANKS} SELECT count(rho) AS defined, round(avg(rho), 9) AS macro, round(median(rho), 9) AS middle, round(min(rho), 9) AS least FROM rho")
def macro_spearman(spark, sf_dir):
    return rhos(spark, sf_dir).agg(F.count("rho").alias("defined"), F.round(F.avg("rho"), 9).alias("macro"), F.round(F.median("rho"), 9).alias("middle"), F.round(F.min("rho"), 9).alias("least"))


@query("SELECT event_id, rank() OVER (PARTITION BY hotspot_id ORDER BY level) + (count(*) OVER (PARTITION BY hotspot_id, level) - 1) / CAST(2 AS DOUBLE) AS avg_rank FROM snapshots")
def avg_rank(spark, sf_dir):
    return stats.average_rank(load(spark, sf_dir, "snapshots"), ["hotspot_id"], "level", "avg_rank").select("event_id", "avg_rank")


@query("""WITH c AS (SELECT slot, observed_area_level AS a, reliability_level AS b, count(*) AS n FROM truths GROUP BY 1, 2, 3), ma AS (SELECT slot, a, sum(n) AS n FROM c GROUP BY 1, 2), mb AS (SELECT slot, b, sum(n) AS n FROM c GROUP BY 1, 2),
e AS (SELECT ma.slot, sum(ma.n * mb.n * (1 - pow((a - b) / CAST(3 AS DOUBLE), 2))) AS e FROM ma JOIN mb ON ma.slot = mb.slot GROUP BY ma.slot),
o AS (SELECT slot, sum(n) AS n, sum(n * (1 - pow((a - b) / CAST(3 AS DOUBLE), 2))) AS o, count(DISTINCT a) AS da, count(DISTINCT b) AS db FROM c GROUP BY slot)
SELECT o.slot, CAST(o.n AS BIGINT) AS n, round(CASE WHEN o.n >= 2 AND da > 1 AND db > 1 AND e / (o.n * o.n) < 1 THEN (o / o.n - e / (o.n * o.n)) / (1 - e / (o.n * o.n)) END, 9) AS kappa FROM o JOIN e ON o.slot = e.slot""")
def weighted_kappa(spark, sf_dir):
    return stats.weighted_kappa(load(spark, sf_dir, "truths"), ["slot"], "observed_area_level", "reliability_level").withColumn("kappa", F.round("kappa", 9))


@query("""WITH t AS (SELECT destination_id, purpose, sum(CASE WHEN arrival_hour < 12 THEN flow ELSE 0 END) AS a, sum(CASE WHEN arrival_hour >= 12 THEN flow ELSE 0 END) AS b FROM od_flows GROUP BY 1, 2),
s AS (SELECT destination_id, a / sum(a) OVER (PARTITION BY destination_id) AS p, b / sum(b) OVER (PARTITION BY destination_id) AS q FROM t), m AS (SELECT *, (p + q) / 2 AS m FROM s)
SELECT destination_id, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2)), 9) AS js_distance FROM m GROUP BY destination_id""")
def js_distance(spark, sf_dir):
    early = F.col("arrival_hour") < 12
    t = load(spark, sf_dir, "od_flows").groupBy("destination_id", "purpose").agg(F.sum(F.when(early, F.col("flow")).otherwise(0.0)).alias("a"), F.sum(F.when(~early, F.col("flow")).otherwise(0.0)).alias("b"))
    return stats.js_distance(t, ["destination_id"], "a", "b").withColumn("js_distance", F.round("js_distance", 9))


@query("SELECT hotspot_id, round(sum(w * ppltn_min) / sum(w), 6) AS mean, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_n FROM (SELECT *, exp(-ln(2) * (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(observed_at)) / 8.64e10 / 7) AS w FROM snapshots) x GROUP BY hotspot_id")
def weighted_stats(spark, sf_dir):
    from tessera.functions.timing import minutes_between

    w = F.exp(-F.ln(F.lit(2.0)) * minutes_between(F.expr(AS_OF), F.col("observed_at")) / 1440.0 / 7.0)
    mean, _, n = stats.weighted_stats(F.col("w"), F.col("ppltn_min"))
    return load(spark, sf_dir, "snapshots").withColumn("w", w).groupBy("hotspot_id").agg(F.round(mean, 6).alias("mean"), F.round(n, 6).alias("effective_n"))


@query("SELECT hotspot_id, round(quantile_cont(ppltn_min, 0.5), 6) AS p50, round(quantile_cont(ppltn_min, 0.95), 6) AS p95, max(ppltn_min) AS most FROM snapshots GROUP BY hotspot_id")
def lag_distribution(spark, sf_dir):
    return load(spark, sf_dir, "snapshots").groupBy("hotspot_id").agg(F.round(F.percentile("ppltn_min", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("ppltn_min", F.lit(0.95)), 6).alias("p95"), F.max("ppltn_min").alias("most"))


@query("""WITH g AS (SELECT (epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY hotspot_id ORDER BY observed_at, event_id))) / 6e7 AS m FROM snapshots), b AS (SELECT CASE WHEN m <= 15 THEN 15 WHEN m <= 30 THEN 30 WHEN m <= 60 THEN 60 WHEN m <= 120 THEN 120 ELSE -1 END AS edge FROM g WHERE m IS NOT NULL), e AS (SELECT unnest([15, 30, 60, 120, -1]) AS edge)
SELECT e.edge, count(b.edge) AS n FROM e LEFT JOIN b ON b.edge = e.edge GROUP BY e.edge""")
def lag_buckets(spark, sf_dir):
    from pyspark.sql import Window

    from tessera.functions.timing import minutes_between

    before = F.lag("observed_at").over(Window.partitionBy("hotspot_id").orderBy("observed_at", "event_id"))
    m = load(spark, sf_dir, "snapshots").select(minutes_between(F.col("observed_at"), before).alias("m")).where("m IS NOT NULL")
    edge = F.when(F.col("m") <= 15, 15).when(F.col("m") <= 30, 30).when(F.col("m") <= 60, 60).when(F.col("m") <= 120, 120).otherwise(-1)
    counts = m.groupBy(edge.alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(15,), (30,), (60,), (120,), (-1,)], "edge int").join(F.broadcast(counts), "edge", "left").na.fill(0, ["n"])


sql_of("strata_grouping_sets", "SELECT part, day, count(*) AS n, CAST(sum(level) AS BIGINT) AS levels FROM (SELECT CAST(hotspot_id % 4 AS INT) AS part, CAST(observed_at AS DATE) AS day, level FROM snapshots) x GROUP BY GROUPING SETS ((), (part), (day), (part, day))")
sql_of("win_rate", """WITH m AS (SELECT abs(ppltn_min - 5000) AS a, abs(ppltn_max - 5250) AS b FROM snapshots) SELECT CAST(sum(CASE WHEN abs(a - b) <= 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS ties, CAST(sum(CASE WHEN a < b - 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN a > b + 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS losses FROM m""")
sql_of("missing_hotspots", f"SELECT h.hotspot_id FROM hotspots h LEFT JOIN (SELECT DISTINCT hotspot_id FROM snapshots WHERE observed_at > {AS_OF} - INTERVAL 6 HOUR) s ON s.hotspot_id = h.hotspot_id WHERE h.is_polled AND s.hotspot_id IS NULL")


@query("SELECT cycle_id, started_at, round((epoch_us(started_at) - epoch_us(lag(started_at) OVER (ORDER BY started_at))) / 6e7, 9) AS gap_min FROM cycles")
def cadence_gaps(spark, sf_dir):
    """Minutes since the cycle before; cycles number a few for each hour, so one task can order them."""
    from pyspark.sql import Window

    from tessera.functions.timing import minutes_between

    before = F.lag("started_at").over(Window.orderBy("started_at"))
    return load(spark, sf_dir, "cycles").select("cycle_id", "started_at", F.round(minutes_between(F.col("started_at"), before), 9).alias("gap_min"))


@query("""WITH c AS (SELECT *, (epoch_us(completed_at) - epoch_us(started_at)) / 6e7 AS m FROM cycles) SELECT count(*) AS cycles, CAST(sum(CASE WHEN failed = 0 THEN 1 ELSE 0 END) AS BIGINT) AS complete, round(sum(saved) / CAST(sum(targets) AS DOUBLE), 9) AS success, round(quantile_cont(m, 0.5), 9) AS p50_min, round(quantile_cont(m, 0.95), 9) AS p95_min, round(max(m), 9) AS max_min FROM c""")
def slo_report(spark, sf_dir):
    from tessera.functions.timing import minutes_between

    c = load(spark, sf_dir, "cycles").withColumn("m", minutes_between(F.col("completed_at"), F.col("started_at")))
    return c.agg(
        F.count(F.lit(1)).alias("cycles"),
        F.count_if(F.col("failed") == 0).alias("complete"),
        F.round(F.sum("saved") / F.sum("targets"), 9).alias("success"),
        F.round(F.percentile("m", F.lit(0.5)), 9).alias("p50_min"),
        F.round(F.percentile("m", F.lit(0.95)), 9).alias("p95_min"),
        F.round(F.max("m"), 9).alias("max_min"),
    )


@query("""WITH m AS (SELECT s.event_id, c.cycle_id, row_number() OVER (PARTITION BY s.event_id ORDER BY c.started_at DESC, c.cycle_id DESC) AS rn FROM snapshots s JOIN cycles c ON s.fetched_at BETWEEN c.started_at AND c.completed_at) SELECT s.event_id, m.cycle_id FROM snapshots s LEFT JOIN m ON m.event_id = s.event_id AND m.rn = 1""")
def cycle_attribution(spark, sf_dir):
    """Each snapshot's latest cycle that was running when it was fetched."""
    return temporal.running_cycle(load(spark, sf_dir, "snapshots"), load(spark, sf_dir, "cycles"), F.expr(AS_OF))


@query(f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-29', INTERVAL 1 DAY)) AS DATE) AS day), h AS (SELECT day, isodow(day) >= 6 OR day IN (DATE '2024-01-01', DATE '2024-02-09', DATE '2024-02-12') AS is_off, day IN (DATE '2024-01-01', DATE '2024-02-09', DATE '2024-02-12') AS holiday FROM d),
i AS (SELECT *, date_diff('day', DATE '2024-01-01', day) - row_number() OVER (ORDER BY day) AS island FROM h WHERE is_off), b AS (SELECT day, count(*) OVER (PARTITION BY island) AS days, max(CASE WHEN holiday THEN 1 ELSE 0 END) OVER (PARTITION BY island) AS held FROM i)
SELECT day, days FROM b WHERE days >= 3 AND held = 1""")
def holiday_blocks(spark, sf_dir):
    """Runs of three days or more off that hold a holiday."""
    return blocks_of(spark, "2024-01-01", "2024-02-29", ["2024-01-01", "2024-02-09", "2024-02-12"])


def blocks_of(spark, first: str, last: str, holidays: list[str], least: int = 3):
    from pyspark.sql import Window

    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")
    held = F.col("day").isin([F.lit(h).cast("date") for h in holidays])
    off = days.withColumn("holiday", held).where(F.col("holiday") | (F.weekday("day") >= 5))
    island = F.date_diff(F.col("day"), F.lit(first).cast("date")) - F.row_number().over(Window.orderBy("day"))
    run = Window.partitionBy("island")
    marked = off.withColumn("island", island).withColumn("days", F.count(F.lit(1)).over(run)).withColumn("_held", F.max("holiday").over(run))
    return marked.where((F.col("days") >= least) & F.col("_held")).select("day", "days")


@query("""WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, rn <= 2 AS accepted FROM r""")
def rate_limit(spark, sf_dir, cap: int = 2):
    """Whether an event is among the first of its user in its hour."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.row_number().over(w) <= cap).alias("accepted"))


@query("""WITH e AS (SELECT event_id, user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, bad ORDER BY n) AS run FROM e), c AS (SELECT *, CASE WHEN bad THEN row_number() OVER (PARTITION BY user_id, bad, run ORDER BY n) ELSE 0 END AS streak FROM g),
f AS (SELECT user_id, min(CASE WHEN streak >= 2 THEN n END) AS opened FROM c GROUP BY user_id) SELECT c.event_id, CAST(c.streak AS INT) AS streak, coalesce(c.n > f.opened, false) AS skipped FROM c JOIN f ON c.user_id = f.user_id""")
def circuit_replay(spark, sf_dir, limit: int = 2):
    """Failures in a row for each user, and whether an event comes after the limit was reached."""
    from pyspark.sql import Window

    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("bad"))
    good = F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(line)
    e = e.withColumn("_run", good).withColumn("streak", F.sum(F.col("bad").cast("int")).over(Window.partitionBy("user_id", "_run").orderBy("ts", "event_id")).cast("int"))
    reached = F.coalesce(F.max(F.col("streak") >= limit).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return e.select("event_id", "streak", reached.alias("skipped"))


@query("SELECT event_id, hour(ts + INTERVAL 9 HOUR) IN (7, 8, 9, 17, 18, 19) AND isodow(CAST(ts + INTERVAL 9 HOUR AS DATE)) < 6 AND CAST(ts + INTERVAL 9 HOUR AS DATE) <> DATE '2024-01-01' AS commute FROM events")
def commute_flag(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul")
    day = F.to_date(local)
    flag = F.hour(local).isin(7, 8, 9, 17, 18, 19) & (F.weekday(day) < 5) & (day != F.lit("2024-01-01").cast("date"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", flag.alias("commute"))
