"""An incremental profile over a stream of reads. Counts of a pileup add up, so this is the batch profile kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def stream_counts(reads: DataFrame) -> DataFrame:
    """pos, allele and n of a streaming frame with off and seq; the state is bounded by positions times letters."""
    letters = reads.select("off", F.posexplode(F.split("seq", "")).alias("_i", "allele")).where("allele <> ''")
    return letters.groupBy((F.col("off") + F.col("_i")).cast("int").alias("pos"), "allele").agg(F.count(F.lit(1)).alias("n"))


def start_profile(reads: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the counts in the in-memory table `name`; for reports of bounded size."""
    return stream_counts(reads).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
