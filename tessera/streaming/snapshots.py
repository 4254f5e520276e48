"""Streams of observations: validity, duplicates, latest state, limits and scores.

Batch tables keep times without zone; a stream's event time has to be a
TIMESTAMP, so it is cast at this border.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def read_events(spark: SparkSession, path: str, schema: str = EVENT, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def split_valid(events: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their content as raw text, so that a bad one never stops the stream."""
    flagged = events.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    raw = F.to_json(F.struct(*events.columns))
    return flagged.where("_ok").drop("_ok"), flagged.where("NOT _ok").select(raw.alias("raw"))


def first_writes(events: DataFrame, keys: list[str], time: str = "ts", horizon: str = "2 hours") -> DataFrame:
    """The first row for each key that arrives within the horizon; state older than that is dropped."""
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and type; a window is final when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_state(events: DataFrame, key: str) -> DataFrame:
    """The latest row of each key by event time, whatever the order of arrival; for complete or update mode."""
    row = F.struct("ts", "event_id", "value", "event_type")
    return events.groupBy(key).agg(F.max(row).alias("r")).select(key, "r.*")


def limited(events: DataFrame, seconds: int, cap: int, late: str = "1 hour") -> DataFrame:
    """Counts by user and bucket of so many seconds, with how many were accepted; buckets that ended before the watermark are rejected, and their state goes."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n", F.least("n", F.lit(cap)).alias("accepted"))


def on_target(events: DataFrame, wanted: str, found: str) -> DataFrame:
    """Rows that are about what was asked for; others are answers to another question."""
    return events.where(F.coalesce(F.col(wanted) == F.col(found), F.lit(False)))


def cycle_row(batch: DataFrame, cycle_id: int, targets: int, ok: str) -> DataFrame:
    """One row about a cycle: targets, saved, failed and status, which is complete, partial or failed; what never came has failed."""
    n = batch.agg(F.count_if(F.coalesce(F.col(ok), F.lit(False))).alias("saved"))
    status = F.when(F.col("saved") >= targets, "complete").when(F.col("saved") > 0, "partial").otherwise("failed")
    return n.select(F.lit(cycle_id).alias("cycle_id"), F.lit(targets).alias("targets"), "saved", F.greatest(F.lit(targets) - F.col("saved"), F.lit(0)).alias("failed"), status.alias("status"))


def insert_new(target: str, keys: list[str], on_new: Callable[[DataFrame], None] | None = None, *, part: str | None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends rows whose keys target doesn't hold yet, once for each key.

    A batch that is run again after a failure adds nothing twice; a null in a
    key equals a null. on_new gets the target if rows were added, and isn't
    called otherwise. part is a column that follows from the keys, such as a
    day: target is partitioned by it, and only the batch's parts are read.
    None reads the whole target with each batch, which suits small ones only.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        fresh = batch.dropDuplicates(keys)
        if there:
            held = spark.read.parquet(target)
            if part:
                days = [r[0] for r in batch.select(part).distinct().collect()]  # a batch's few days
                held = held.where(F.col(part).isin([d for d in days if d is not None]) | (F.col(part).isNull() if None in days else F.lit(False)))
            held = held.select(*[F.col(k).alias(f"_held_{i}") for i, k in enumerate(keys)])
            on = [F.col(k).eqNullSafe(F.col(f"_held_{i}")) for i, k in enumerate(keys)]
            fresh = fresh.join(held, on, "left_anti")
        fresh = fresh.persist()
        try:
            if not fresh.isEmpty():
                writer = fresh.write.mode("append")
                (writer.partitionBy(part) if part else writer).parquet(target)
                if on_new:
                    on_new(spark.read.parquet(target))
        finally:
            fresh.unpersist()

    return write


def start(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Runs write on each micro-batch; without every, on all that is there and then ends."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
