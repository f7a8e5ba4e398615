"""Floor seeks: of each asked number, the last of a sorted list's values that does not exceed it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.storage import stored


def floor_seek(values: DataFrame, asks: DataFrame, value: str = "value", ask: str = "ask", parts: int | None = None) -> DataFrame:
    """asks with floor, the greatest value at or below `ask` (null where there is none), and index, its place among the
    distinct values from 0 on, or 0 below the first one.

    Values and asks are dealt together by ranges of the number, values before asks of the same, and asks among themselves
    by a hash of their row, so equal asks can fill many ranges. A range then counts and carries within itself; the last
    value and the count of the ranges before it come from one row a range. Null values are left out; a null ask has
    neither floor nor index.
    """
    spark = values.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = values.select(F.col(value).alias("_key")).where("_key is not null").distinct().select("_key", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_salt"))
    row = F.struct(*asks.columns).alias("_row")
    asked = asks.where(F.col(ask).isNotNull()).select(F.col(ask).cast(listed.schema["_key"].dataType).alias("_key"), F.lit(1).alias("_kind"), F.xxhash64(*asks.columns).alias("_salt"), row)
    order = ["_key", "_kind", "_salt"]
    dealt = listed.unionByName(asked, allowMissingColumns=True).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("_kind") == 0, F.col("_key"))
    ranges = dealt.groupBy("_range").agg(F.max(own).alias("_last"), F.count(own).alias("_n"))
    # A row a range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(ranges.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carry"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    met = dealt.withColumn("_floor", F.last(own, ignorenulls=True).over(within)).withColumn("_count", F.count(own).over(within)).where("_kind = 1").join(carried, "_range")
    found = met.select("_row.*", F.coalesce("_floor", "_carry").alias("floor"), F.greatest(F.col("_before") + F.col("_count") - 1, F.lit(0)).cast("long").alias("index"))
    none = asks.where(F.col(ask).isNull())
    return found.unionByName(none, allowMissingColumns=True)
