"""Exact token-length histogram with suffix sums for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import frames as fr


def token_lengths(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in fr.batches_of(batches):
            _, ends = bpe.encode_table(table, path)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(np.diff(ends))], names=["doc_id", "n_tokens"])

    return fr.with_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens", range_width: int = 4096) -> DataFrame:
    """One row for each length L that occurs, as a context limit.

    n_docs have exactly L tokens, docs_at_least have L or more and docs_over more than L; tokens_over is what the
    longer ones hold in all; tokens_within_limit is the sum of min(length, L) over all documents, tokens_cut the
    rest; quantile is the share of documents of at most L tokens.

    Suffix sums come in two levels, over ranges of lengths and then within a range, so no task sorts the whole
    histogram.  Nulls count as length 0.  An empty table gives no rows.
    """
    bins = lengths.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    bins = fr.stored(bins.withColumn("band", F.floor(F.col("n_tokens") / range_width)))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bins.groupBy("band").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    totals = bands.agg(F.sum("docs"), F.sum("tokens")).first()
    docs, tokens = (F.lit(int(x or 0)) for x in totals)
    bands = bands.select("band", F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"))
    longer = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = bins.join(bands, "band").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_above") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).alias("docs_over"),
        (F.col("tokens_above") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(longer), F.lit(0))).alias("tokens_over"),
    )
    within = tokens - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return out.select(
        "n_tokens",
        "n_docs",
        (F.col("docs_over") + F.col("n_docs")).alias("docs_at_least"),
        "docs_over",
        "tokens_over",
        within.alias("tokens_within_limit"),
        (tokens - within).alias("tokens_cut"),
        ((docs - F.col("docs_over")) / docs).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for stated context limits, from the histogram alone."""
    spark = histogram.sparkSession
    stated = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context_limit long"))
    sums = histogram.select(F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("l"), F.when(F.col("n_tokens") > x, F.col("n_docs")).otherwise(0).alias("over"), (F.least(F.col("n_tokens"), F.lit(int(x))) * F.col("n_docs")).alias("within")) for x in limits])).alias("x"))
    return stated.join(sums.groupBy(F.col("x.l").alias("context_limit")).agg(F.sum("x.over").alias("docs_over"), F.sum("x.within").alias("tokens_within_limit")), "context_limit", "left")
