"""Exact deduplication that a hot group of copies cannot stall, in DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored

#: The characters that comparison ignores.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

#: Above any id less another, and above that.
_ID, _LONGEST = Decimal(10**19), Decimal(10**20)


def normalised(text: Column) -> Column:
    """text without the six ASCII white-space characters."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _preference(chars: Column, doc_id: Column) -> Column:
    """One number that orders by most code points, then smallest id; it fits a hash aggregate's buffer. A null id comes last."""
    by_id = F.coalesce(F.lit(_ID) - doc_id.cast("decimal(19,0)"), F.lit(0).cast("decimal(38,0)"))
    return (chars.cast("decimal(10,0)") * F.lit(_LONGEST) + by_id).cast("decimal(38,0)")


def _preferred_id(preference: Column) -> Column:
    rest = F.pmod(preference, F.lit(_LONGEST))
    return F.when(rest > 0, (F.lit(_ID) - rest).cast("long"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, hot_share: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when identical after `normalised`.  Copies meet in three steps, each of which groups by
    the digest and the whole normalised text: within a task (the partial aggregate), within a salt, and over the
    winners of the salts.  So a digest that a third of all rows share reaches one task as one row a salt.

    The way back from rows to groups takes the digest, SHA-256 of what was compared.  Groups of at least
    1/hot_share of all rows, at most hot_share of them by counting, are broadcast; the others are joined.

    Nulls: a null text is empty; a null id is kept only if all ids of its group are null, and then
    keep_id is null.  Rows that share text and id are all `kept` if that id is.  An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"), normalised(F.col(text_col)).alias("content"))
    rows = rows.withColumn("digest", F.sha2("content", 256))
    merged = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "content")
        .agg(F.max(_preference(F.col("chars"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("n"))
        .groupBy("digest", "content")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    )
    groups = stored(merged.select(F.unhex("digest").alias("digest"), _preferred_id(F.col("best")).alias("keep_id"), "group_size"))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") * hot_share >= max(total, 2 * hot_share)
    hot = groups.where(is_hot).select(F.col("digest").alias("hot_digest"), F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    cold = groups.where(~is_hot).select(F.col("digest").alias("cold_digest"), "keep_id", "group_size")

    keyed = rows.select("doc_id", F.unhex("digest").alias("digest")).join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    # Rows of hot groups are done; they get a key of their own, which spreads them and matches nothing.
    keyed = keyed.withColumn("key", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary")))
    found = keyed.join(cold, F.col("key") == F.col("cold_digest"), "left")
    found = found.withColumn("keep_id", F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")))
    return found.select(
        "doc_id",
        "keep_id",
        F.coalesce("hot_size", "group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
