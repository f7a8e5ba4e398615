"""A corpus pipeline of five stages over the documents table.

Each stage takes what the one before kept.  Rows are taken as documents with an id of their own: where an id
occurs more than once, a stage that drops documents decides by id, and rows that share text and id are one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import exact_dedup, packing, quality, simhash, suffix_array
from strandweave.llm.frames import broadcast_if_small, stored
from strandweave.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Words of the language model's n-grams. On labelled documents two do as well as three, which take more disk than a stage has.
ORDER = 2

#: Most bytes of texts that go to a Python worker at once.  Spark's own 64 MB (10,000 documents, if that is less) lie three
#: times in an executor for each core: in the JVM's vectors, on their way, and in the worker.
BATCH = "4m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(stage: Stage) -> Stage:
    """The stage, with batches of at most BATCH from now on in its session: what it returns runs later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The documents but for those of whose id no row is kept (decided: doc_id, kept); a null id counts as an id."""
    gone = stored(decided.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("kept").alias("kept")).where("not kept").select("gone_id"))
    gone = broadcast_if_small(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti").select(*COLUMNS)


@_small_batches
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text does not reject."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return _keep(docs, quality.classify(docs, trusted, order=ORDER, rounds=1))


@_small_batches
def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return _keep(docs, exact_dedup.exact_groups(docs))


@_small_batches
def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of texts of similarity 0.8 or more, on shingles of five words."""
    groups = simhash.near_groups(docs, width=5, similarity=0.8)
    return _keep(docs, groups.withColumn("kept", F.expr("doc_id <=> component_id")))


@_small_batches
def repeat_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of length 50 that a smaller document has too; n_chars is counted anew."""
    cut = suffix_array.remove_repeated_bytes(docs, length=50, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


@_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, TOKENIZER, size=2048, end_id=1)


STAGES = [("quality", quality_filter), ("exact_dedup", exact_filter), ("near_dedup", near_filter), ("suffix_dedup", repeat_filter), ("packing", pack)]

#: SQL can express neither the language model nor SimHash nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
