"""Importance resampling of documents towards a target's distribution of hashed n-grams.

Arrow's kernels split texts into words, number the distinct ones (dictionary_encode) and number the distinct pairs of an
n-gram and the word after it, so an n-gram of k + 1 words is a pair of shifted indices.  A pair's CRC follows from the
CRCs of its halves, once for each distinct pair; buckets are taken back to all places, and a document's weight is a
segment sum of its buckets' gains.  The counts of all documents and of the target meet as one row a bucket: their
number is a parameter, not a function of the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames as fr

#: Runs of bytes between words: all of ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are worked on together.
PIECE_BYTES = 1 << 18


@cache
def _after(bit: int) -> np.ndarray:
    """What 2**bit zero bytes make of the CRC state, as four tables of 256: the state is a polynomial over GF(2)."""
    if bit == 0:
        low = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            low = np.where(low & 1, (low >> 1) ^ np.uint32(0xEDB88320), low >> 1).astype(np.uint32)
        byte = np.arange(256, dtype=np.uint32)
        return np.stack([low, byte, byte << np.uint32(8), byte << np.uint32(16)])
    half = _after(bit - 1)
    return np.stack([_through(half, _through(half, np.arange(256, dtype=np.uint32) << np.uint32(8 * k))) for k in range(4)])


def _through(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 255] ^ table[1][(state >> 8) & 255] ^ table[2][(state >> 16) & 255] ^ table[3][state >> 24]


def crc_joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of two byte strings in a row, from their CRCs and the size of the second one."""
    first = first.copy()
    for bit in range(int(size.max(initial=0)).bit_length()):
        on = np.flatnonzero((size >> bit) & 1)
        first[on] = _through(_after(bit), first[on])
    return first ^ second


def words_of(texts: pa.Array, separators: str) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What stands between separators, all texts' end to end, as a dictionary, and where each text's begin (with the end)."""
    lists = pc.split_pattern_regex(texts, separators)
    words = pc.list_flatten(lists)
    full = pc.not_equal(words, pa.scalar("", words.type))
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
    return words.filter(full).dictionary_encode(), before[ends]


def _spelled(words: pa.Array) -> list[bytes]:
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    text = words.buffers()[2].to_pybytes() if words.buffers()[2] is not None else b""
    return [text[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def buckets_of(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The texts' numbers of words; for n-grams of 1 to longest words, their buckets by place and where each text's begin (with the end)."""
    words, docs = words_of(pc.ascii_lower(texts), SEPARATORS)
    place = words.indices.to_numpy().astype(np.int64)
    spelled = _spelled(words.dictionary)
    sizes = np.array([len(w) for w in spelled], np.int64)
    alone = np.array([zlib.crc32(w) for w in spelled], np.uint32)
    # A later word of an n-gram comes with the blank before it.
    later = crc_joined(np.full(len(spelled), zlib.crc32(b" "), np.uint32), alone, sizes)
    n, radix = np.diff(docs), max(len(spelled), 1)
    gram, crc, found = place, alone, []
    for k in range(1, longest + 1):
        if k > 1:
            # gram holds the n-grams of k - 1 words by their first word's place.
            pairs = pa.array(gram[:-1] * radix + place[k - 1 :]).dictionary_encode()
            gram = pairs.indices.to_numpy().astype(np.int64)
            head, tail = np.divmod(pairs.dictionary.to_numpy(), radix)
            crc = crc_joined(crc[head], later[tail], sizes[tail] + 1)
        taken = (crc % np.uint32(buckets)).astype(np.int32)[gram]
        # Those that reach over the end of a text go.
        inside = np.ones(len(taken), bool)
        for back in range(1, k):
            inside[(docs[1:] - back)[(n >= back) & (docs[1:] - back < len(taken))]] = False
        found.append((taken[inside], np.append(0, np.cumsum(np.maximum(n - k + 1, 0)))))
    return n, found


def bucket_counts(df: DataFrame, longest: int, buckets: int, text_col: str = "text") -> DataFrame:
    """bucket and n: how many n-grams of all texts fall into each; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for table in fr.batches_of(batches, PIECE_BYTES):
            for chunk in table.column("text").chunks:
                for bucket, _ in buckets_of(chunk, longest, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["bucket", "n"])

    text = df.select(F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return text.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(df: DataFrame, target: DataFrame, longest: int, buckets: int, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """floor(1000 * log of how much likelier a bucket is in the target), as whole numbers; counts are raised by one."""
    own = bucket_counts(df, longest, buckets, text_col).withColumnRenamed("n", "s")
    aim = bucket_counts(target, longest, buckets, target_col).withColumnRenamed("n", "t")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in own.join(aim, "bucket", "full").collect():  # a row a bucket at most
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    total = s.sum() + buckets, t.sum() + buckets
    return np.floor(1000 * np.log((t + 1) * total[0] / ((s + 1) * total[1]))).astype(np.int64)


def weights(df: DataFrame, gain: np.ndarray, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of gains over a text's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in fr.batches_of(batches, PIECE_BYTES):
            for batch in table.to_batches():
                n, found = buckets_of(batch.column("text"), longest, len(gain))
                weight, features = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                for bucket, at in found:
                    # Every text's segment ends in a zero, so that none is empty.
                    weight += np.add.reduceat(np.insert(gain[bucket], at[1:], 0), at[:-1] + np.arange(len(n)))
                    features += np.diff(at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return fr.with_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel variate) of a key, from the first 32 bits of its SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, stored, with _rank from 1 in that order: sorted by ranges, each numbered apart, with offsets from counts of ranges."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("_place", pa.array(np.arange(at + 1, at + 1 + batch.num_rows)))
            at += batch.num_rows

    kept = fr.stored(rows.mapInArrow(number, rows.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ") + ", _place bigint"))
    # A row a range.
    sizes = kept.groupBy("_range").agg(F.max("_place").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_range", before.alias("_before")))
    return kept.join(offsets, "_range").withColumn("_rank", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def resample(df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, longest: int = 3, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row.

    Words are runs of digits, letters a to z (A to Z count as these) and characters beyond ASCII; features are all runs
    of 1 to `longest` words, in `buckets` buckets by CRC-32.  The score is the weight plus Gumbel noise of the id, so the
    highest scores are a sample without replacement by importance.  Of the N rows of least_words words or more, the
    N * percent / 100 (rounded down) of highest scores are drawn and ranked from 1; ties go to the smaller id.

    A null text has no words and weight 0.  A row with a null id has no score and is not drawn, nor counted in N.
    Repeated rows are rows each, with one score.  An empty target gives gains by the documents alone, an empty table no
    rows.  Other columns are ignored.
    """
    scored = weights(df, gains(df, target, longest, buckets, text_col, target_col), longest, id_col, text_col)
    scored = fr.stored(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = scored.where(able).count() * percent // 100
    order = ranked(scored.where(able), [F.desc("score"), F.asc("doc_id")])
    rank = F.when(F.col("_rank") <= drawn, F.col("_rank"))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return order.withColumn("rank", rank).drop("_rank").unionByName(rest)
