"""Storing intermediates so that lineage ends and lost executors cost nothing."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a table that is sent to all executors; beyond it a join is shuffled.
BROADCAST_ROWS = 1_000_000

#: After so many stored frames the driver drops what earlier plans left, if its heap has grown to half its limit.
STORED_A_CLEANUP = 2


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once to spark.checkpoint.dir.

    The driver holds the plans, broadcast tables and shuffles of earlier steps until its garbage is collected, and its heap
    grows to its limit before that; so now and then it is collected here.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    out = df.checkpoint()
    sc._strandweave_stored = getattr(sc, "_strandweave_stored", 0) + 1
    heap = sc._jvm.Runtime.getRuntime()
    if sc._strandweave_stored % STORED_A_CLEANUP == 0 and 2 * heap.totalMemory() > heap.maxMemory():
        sc._jvm.System.gc()
    return out


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many parts as tasks run at once; for rows of which each becomes many."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, stored and counted; to be broadcast where it has at most limit rows."""
    kept = stored(df)
    return F.broadcast(kept) if kept.count() <= limit else kept


def by_read(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left and right joined by read_id, both shuffled.

    Cells are derived from reads within a plan, and Spark guesses their size from the compressed file of the reads; by that guess
    it would send all cells to the driver and to every executor.
    """
    return left.hint("merge").join(right, "read_id", how)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' places from 1 on in that order, as `name`: dealt by ranges, stored, counted within each and offset by the ranges before."""
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range").orderBy(*order)
    # A row a range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.row_number().over(within)).drop("_range", "_before")
