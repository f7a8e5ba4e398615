"""Reads derived from the orders table: four planted haplotypes over 120 positions, single and paired reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.storage import spread

LENGTH = 120

#: The planted differences from the base, as (positions, shift of the base, deleted positions).
PLANTED = {1: ((12, 37, 55, 80, 108), 1, ()), 2: ((20, 37, 62, 90), 2, ()), 3: ((30, 75, 100), 1, (48, 49, 50, 51))}


def base_index(pos: Column) -> Column:
    return (pos * pos + 3 * pos + pos % 7) % 4


def letter(index: Column) -> Column:
    return F.substring(F.lit("ACGT"), (index % 4 + 1).cast("int"), F.lit(1))


def planted_allele(haplotype: Column, pos: Column) -> Column:
    """The letter of a planted haplotype, without noise."""
    out = letter(base_index(pos))
    for h, (snps, shift, gone) in PLANTED.items():
        out = F.when((haplotype == h) & pos.isin(*snps), letter(base_index(pos) + shift)).otherwise(out)
        if gone:
            out = F.when((haplotype == h) & pos.isin(*gone), F.lit("-")).otherwise(out)
    return out


def haplotype_of(customer: Column) -> Column:
    k = customer % 20
    return F.when(k < 10, 0).when(k < 15, 1).when(k < 18, 2).otherwise(3)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, ck, mate, off and fin (inclusive): one segment or two a read."""
    rid = F.col("o_orderkey")
    s = ((rid * 37) % 61).cast("int")
    single = F.array(F.struct(F.lit(0).alias("mate"), s.alias("off"), (s + 59).alias("fin")))
    paired = F.array(F.struct(F.lit(0).alias("mate"), s.alias("off"), (s + 24).alias("fin")), F.struct(F.lit(1).alias("mate"), (s + 35).alias("off"), (s + 59).alias("fin")))
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    return orders.select(rid.alias("read_id"), F.col("o_custkey").alias("ck"), F.inline(F.when(rid % 3 == 0, single).otherwise(paired)))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, l_off, l_end, r_off and r_end (inclusive) of each read; a single one has -1 and -2 on the right."""
    rid = F.col("o_orderkey")
    s = ((rid * 37) % 61).cast("int")
    single = rid % 3 == 0
    ends = F.when(single, s + 59).otherwise(s + 24), F.when(single, -1).otherwise(s + 35), F.when(single, -2).otherwise(s + 59)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(rid.alias("read_id"), s.alias("l_off"), *(c.alias(n) for c, n in zip(ends, ("l_end", "r_off", "r_end"), strict=True)))


def _noisy(read_id: Column, ck: Column, pos: Column) -> Column:
    noise = (read_id * 7919 + pos * 104729 + read_id * pos) % 1009
    b = base_index(pos)
    out = F.when(noise < 2, F.lit("N"))
    for limit, shift in ((7, 1), (11, 2), (14, 3), (24, 0)):
        out = out.when(noise < limit, letter(b + shift))
    return out.otherwise(planted_allele(haplotype_of(ck), pos))


def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, pos and allele of every cell; a projection of the segments without any shuffle."""
    cells = segments(spark, sf_dir).withColumn("pos", F.explode(F.sequence("off", "fin")))
    return cells.select("read_id", "pos", _noisy(F.col("read_id"), F.col("ck"), F.col("pos")).alias("allele"))


def segment_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, mate, off and seq: the letters of each segment, without a shuffle."""
    seq = F.array_join(F.transform(F.sequence("off", "fin"), lambda p: _noisy(F.col("read_id"), F.col("ck"), p)), "")
    return segments(spark, sf_dir).select("read_id", "mate", "off", seq.alias("seq"))


def pair_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, l, l_off, r and r_off; r_off is -1 for a single read."""
    mates = segment_reads(spark, sf_dir).groupBy("read_id").agg(*[F.max(F.when(F.col("mate") == m, F.col(c))).alias(n) for m, c, n in ((0, "seq", "l"), (0, "off", "l_off"), (1, "seq", "r"), (1, "off", "r_off"))])
    return mates.select("read_id", "l", "l_off", F.coalesce("r", F.lit("")).alias("r"), F.coalesce("r_off", F.lit(-1)).alias("r_off"))


def long_bounds(read_id: Column) -> tuple[Column, Column]:
    """The first and last position that a long read reaches."""
    return (read_id % 10).cast("int"), (LENGTH - 1 - read_id % 7).cast("int")


def long_pileup(spark: SparkSession, sf_dir: str, padded: bool = True) -> DataFrame:
    """The same reads over all positions; up to 9 at each end are N, left out unless padded."""
    rid = F.col("o_orderkey")
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(rid.alias("read_id"), F.col("o_custkey").alias("ck")))
    first, last = long_bounds(F.col("read_id"))
    cells = orders.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(LENGTH - 1)) if padded else F.sequence(first, last)))
    ends = ~F.col("pos").between(first, last)
    return cells.select("read_id", "pos", F.when(ends, F.lit("N")).otherwise(_noisy(F.col("read_id"), F.col("ck"), F.col("pos"))).alias("allele"))


def _long_letters(read_id: pa.Array, ck: pa.Array) -> np.ndarray:
    """A row of letters for each read of these orders, as `long_pileup` has them."""
    pos = np.arange(LENGTH)
    base, acgt = (pos * pos + 3 * pos + pos % 7) % 4, np.frombuffer(b"ACGT", dtype=np.uint8)
    planted = np.tile(acgt[base], (4, 1))
    for h, (snps, shift, gone) in PLANTED.items():
        planted[h, list(snps)] = acgt[(base[list(snps)] + shift) % 4]
        planted[h, list(gone)] = ord("-")
    noisy = np.stack([np.full(LENGTH, ord("N"), dtype=np.uint8), *(acgt[(base + shift) % 4] for shift in (1, 2, 3, 0))])
    rid = read_id.fill_null(0).to_numpy(zero_copy_only=False)
    if len(rid) and max(int(rid.max()), -int(rid.min())) > 10**15:
        raise OverflowError("a read's number is too large for the noise")
    k = np.fmod(ck.fill_null(19).to_numpy(zero_copy_only=False), 20)
    out = planted[np.searchsorted((10, 15, 18), k, side="right")]
    noise = np.fmod(rid[:, None] * 7919 + pos * 104729 + rid[:, None] * pos, 1009)
    known = ~np.asarray(read_id.is_null())
    rows, columns = np.nonzero((noise < 24) & known[:, None])
    out[rows, columns] = noisy[np.searchsorted((2, 7, 11, 14), noise[rows, columns], side="right"), columns]
    first, last = np.fmod(rid, 10), LENGTH - 1 - np.fmod(rid, 7)
    out[((pos < first[:, None]) | (pos > last[:, None])) & known[:, None]] = ord("N")
    return out


def long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id and seq: the same reads as padded strings, a row an order; worked out in numpy, without a shuffle."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("read_id"), F.col("o_custkey").cast("long").alias("ck")))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.ascontiguousarray(_long_letters(batch["read_id"], batch["ck"]))
            ends = np.arange(len(letters) + 1, dtype=np.int32) * LENGTH
            seq = pa.StringArray.from_buffers(len(letters), pa.py_buffer(ends), pa.py_buffer(letters))
            yield pa.RecordBatch.from_arrays([batch["read_id"], seq], ["read_id", "seq"])

    return orders.mapInArrow(made, "read_id long, seq string")


def truth(spark: SparkSession) -> DataFrame:
    """haplotype, pos and allele of the planted sequences: 4 times 120 rows."""
    grid = spark.range(4).select(F.col("id").cast("int").alias("haplotype")).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(LENGTH - 1))))
    return grid.withColumn("allele", planted_allele(F.col("haplotype"), F.col("pos")))
