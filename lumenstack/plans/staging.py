"""Tables written to the folder that all executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names; a local one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="lumenstack-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder that the cluster names and read again, so that files are inspected once.
    It is removed when the session or the program ends."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, counters: dict, figures: dict[str, Column]) -> DataFrame:
    """staged(df), and in counters the figures of its rows, taken while they are written."""
    seen = Observation(f"{name} {uuid.uuid4().hex}")
    out = staged(df.observe(seen, *(c.alias(k) for k, c in figures.items())), name)
    found = seen.get
    counters |= {k: counters.get(k, 0) + (found.get(k) or 0) for k in figures}
    return out


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
