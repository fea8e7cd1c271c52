"""Shared helpers: staged tables, the shared folder, byte-level text rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a folder
    under /tmp serves in local mode, where there is one machine; a cluster must set it.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/cinderlake/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation of what lies
    before), gives later joins exact sizes, and lets several consumers read one
    result.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)


#: Rows of a few numbers that are worth a broadcast: some megabytes at most.
FEW_ROWS = 1 << 16


def hint_for(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The hint to broadcast what has as many rows of a few numbers as ``df``, a staged table, if these are few, else none.

    Spark guesses sizes from files, and many small files look large to it.
    """
    return F.broadcast if df.count() <= FEW_ROWS else lambda x: x


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` does that for pure ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, least: int = 8) -> int:
    """Partitions for a shuffle that is dealt by number: the session's own setting."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
