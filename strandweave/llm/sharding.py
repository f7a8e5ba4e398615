"""Sharding by rendezvous hashing of record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import stored


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest weighted score for key.

    Each shard's score is -weight / ln(u) with u in (0, 1) from XXH64 of (key, shard).  A shard's score does
    not depend on the other shards, so an added shard takes rows only into itself, a removed one gives up
    only its own, and a changed weight moves only rows to or from that shard.  A null key hashes as a key
    of its own.  Shards of weight 0 get nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0")), F.lit(shard)), 11)
            u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
            scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("order")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["order"]).cast("int")


def shard(df: DataFrame, key_col: str, weights: Sequence[float], shard_col: str = "shard") -> DataFrame:
    """df with a shard number; a map-side projection that moves no rows."""
    return df.withColumn(shard_col, rendezvous(F.col(key_col), weights))


def numbered_slots(df: DataFrame, shard_col: str, order: Sequence[str], slot_col: str = "slot") -> DataFrame:
    """Gapless positions from 0 within each shard, without sorting a shard in one task.

    The rows are stored with the number of the task that made them; rows are numbered within (task, shard),
    and the counts of the tasks before give the offset.  Work for a task is bounded by an input split, however
    many rows share a key.  An empty input gives an empty result; repeated rows get a slot each.
    """
    kept = stored(df.withColumn("_task", F.spark_partition_id()))
    before = Window.partitionBy(shard_col).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        kept.groupBy("_task", shard_col)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_task", shard_col, "_offset")
    )
    within = Window.partitionBy("_task", shard_col).orderBy(*order)
    return (
        kept.withColumn("_row", F.row_number().over(within))
        .join(offsets, ["_task", shard_col])
        .withColumn(slot_col, (F.col("_offset") + F.col("_row") - 1).cast("long"))
        .drop("_task", "_offset", "_row")
    )


def shard_documents(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is `key`: the id and the shard count decide.  Nulls: a null text has size 1 and the checksum of
    no bytes; a null id is one key.  Equal ids go to one shard.  Other columns are ignored.
    Repeated rows get a slot each; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    keyed = df.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, [1.0] * shards).alias("shard"),
        rendezvous(key, [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return numbered_slots(keyed, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
