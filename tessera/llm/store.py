"""Tables written to the shared folder, to cut lineage.

The folder is the one named by ``spark.checkpoint.dir``. Where it is unset, a
local session gets a folder of its own and any other session an error, as
executors of a cluster can't see each other's local disks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_DIR
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Later stages start from files, so a lost executor costs no recomputation
    of what came before, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the files of tables made by cut() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
