"""From clusters of reads to haplotypes and their frequencies."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.alleles import hamming
from strandweave.operators.pileup import consensus, weighted_profile
from strandweave.storage import small, stored

log = logging.getLogger(__name__)


def cluster_haplotypes(cells: DataFrame, assignment: DataFrame, majors: DataFrame, start: int = 0, end: int = 1_000_000, floor: float = 0.01) -> DataFrame:
    """clique_id, pos and allele: the weighted consensus of each cluster.

    Where no allele's share exceeds floor, nothing is covered, or outside [start, end], it is the major one.
    """
    shares = stored(weighted_profile(cells, assignment.select("read_id", "clique_id", "k"), by=["clique_id"]))  # a few letters a cluster and position
    own = consensus(shares, value="freq", least=floor, by=["clique_id"]).withColumnRenamed("major", "own")
    grid = assignment.select("clique_id").distinct().join(F.broadcast(majors.agg(F.collect_list(F.struct("pos", "major")).alias("at"))), F.lit(True)).select("clique_id", F.inline("at"))
    joined = grid.join(own, ["clique_id", "pos"], "left")
    use = (F.col("own") != "N") & F.col("pos").between(start, end)
    return joined.select("clique_id", "pos", F.when(use, F.col("own")).otherwise(F.col("major")).alias("allele"), "major")


def mask_low_support(haplotypes: DataFrame, depth: DataFrame, empty_sources: DataFrame, least_depth: int = 5, least_count: int = 15) -> DataFrame:
    """Letters other than the major one become it under least_depth reads, or where the source is the consensus and
    the letter has under least_count reads.  depth has clique_id, pos, depth and count of the own letter."""
    marked = haplotypes.join(depth, ["clique_id", "pos"], "left").join(empty_sources.select("clique_id").withColumn("empty", F.lit(True)), "clique_id", "left")
    weak = (F.coalesce("depth", F.lit(0)) < least_depth) | (F.col("empty").isNotNull() & (F.coalesce("count", F.lit(0)) < least_count))
    return marked.select("clique_id", "pos", F.when(weak, F.col("major")).otherwise(F.col("allele")).alias("allele"), "major")


def strings(haplotypes: DataFrame) -> DataFrame:
    """clique_id, haplotype and snps (`pos:allele` of letters other than the major one)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "allele", "major")))
    snps = F.transform(F.filter(rows, lambda x: x["allele"] != x["major"]), lambda x: F.concat_ws(":", x["pos"].cast("string"), x["allele"]))
    return haplotypes.groupBy("clique_id").agg(F.array_join(F.transform(rows, lambda x: x["allele"]), "").alias("haplotype"), snps.alias("snps"))


def merge_equal(found: DataFrame) -> DataFrame:
    """One row for each haplotype string: the smallest clique and all clusters."""
    return found.groupBy("haplotype").agg(F.min("clique_id").alias("hap_id"), F.array_sort(F.collect_list("clique_id")).alias("cliques"), F.first("snps").alias("snps"))


def merge_near(rows: list[tuple[str, float]], radius: int = 1) -> list[tuple[str, float]]:
    """Most frequent first, each haplotype joins a kept one within radius, or is kept. For at most a hundred rows."""
    kept: list[list] = []
    for text, freq in sorted(rows, key=lambda r: (-r[1], r[0])):
        for other in kept:
            if len(other[0]) == len(text) and sum(a != b for a, b in zip(other[0], text, strict=True)) <= radius:
                other[1] += freq
                break
        else:
            kept.append([text, freq])
    return [(t, f) for t, f in kept]


def merge_near_rows(rows: DataFrame, radius: int = 1) -> DataFrame:
    """The same over rows (haplotype, frequency) of any number: the kept haplotypes with the sums of what joined them.

    Haplotypes within radius of each other have one of radius + 1 pieces in common, so they meet by these.  Rounds then
    settle those that nothing undecided precedes: kept without a kept one before them within radius, else joined. Equal
    haplotypes count as one, at the highest of their frequencies.
    """
    order = F.struct((-F.col("top")).alias("top"), F.col("haplotype"))
    nodes = stored(rows.groupBy("haplotype").agg(F.sum("frequency").alias("frequency"), F.max("frequency").alias("top")).withColumn("place", order))
    size = F.length("haplotype")
    cut = lambda k: F.floor(size * k / (radius + 1)).cast("int")
    pieces = nodes.select("haplotype", "place", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), size.alias("size"), F.substring("haplotype", cut(k) + 1, cut(k + 1) - cut(k)).alias("piece")) for k in range(radius + 1)])))
    other = pieces.select(F.col("haplotype").alias("before"), F.col("place").alias("before_place"), "k", "size", "piece")
    near = pieces.join(other, ["k", "size", "piece"]).where((F.col("before_place") < F.col("place")) & (hamming(F.col("haplotype"), F.col("before")) <= radius))
    near = stored(near.select("haplotype", "before", "before_place").distinct())
    kept = nodes.select("haplotype", F.lit(None).cast("boolean").alias("kept"))
    state = stored(kept)
    while state.where("kept is null").limit(1).count():
        seen = near.join(state.where("kept is null").select("haplotype"), "haplotype", "left_semi").join(state.select(F.col("haplotype").alias("before"), F.col("kept").alias("before_kept")), "before")
        seen = seen.groupBy("haplotype").agg(F.coalesce(F.bool_or("before_kept"), F.lit(False)).alias("joins"), F.bool_or(F.col("before_kept").isNull()).alias("waits"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("joins"), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = stored(state.join(seen, "haplotype", "left").select("haplotype", new.alias("kept")))
    heads = state.where("kept").select(F.col("haplotype").alias("before"))
    target = near.join(heads, "before", "left_semi").groupBy("haplotype").agg(F.min_by("before", "before_place").alias("target"))
    joined = nodes.join(state.where("not kept").select("haplotype"), "haplotype", "left_semi").join(target, "haplotype").select(F.col("target").alias("haplotype"), "frequency")
    return nodes.join(state.where("kept").select("haplotype"), "haplotype", "left_semi").select("haplotype", "frequency").union(joined).groupBy("haplotype").agg(F.sum("frequency").alias("frequency"))


def read_likelihoods(cells: DataFrame, haplotypes: DataFrame, rate: float, n_is_mismatch: bool, length: int | None = None, cap: int = 999, longest: int = 2999) -> DataFrame:
    """read_id, hap_id, misses, size and h = (1 - rate)^(size - misses) * (rate / 3)^misses.

    haplotypes has hap_id, pos, allele and is small; size is the read's letters, or length where given.  h may be 0
    for want of precision, which means that a read tells nothing.
    """
    differ = (F.col("allele") != F.col("letter")) & (F.lit(n_is_mismatch) | (F.col("allele") != "N"))
    met = cells.join(small(haplotypes.select("hap_id", "pos", F.col("allele").alias("letter"))), "pos")
    sums = met.groupBy("read_id", "hap_id").agg(F.least(F.count_if(differ), F.lit(cap)).alias("misses"), F.least(F.count(F.lit(1)), F.lit(longest)).alias("size"))
    if length is not None:
        sums = sums.withColumn("size", F.lit(length).cast("long"))
    return sums.withColumn("h", F.pow(F.lit(1 - rate), F.col("size") - F.col("misses")) * F.pow(F.lit(rate / 3), F.col("misses")))


def likelihood_patterns(likelihoods: DataFrame) -> DataFrame:
    """Reads with equal likelihoods for all haplotypes, as one row (pattern, reads)."""
    rows = F.array_sort(F.collect_list(F.struct("hap_id", "h")))
    return likelihoods.groupBy("read_id").agg(rows.alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("reads"))


def em_step(patterns: DataFrame, freq: dict[int, float]) -> dict[int, float]:
    """New frequencies; a read of no likelihood is left out."""
    known = F.create_map(*[x for k, v in sorted(freq.items()) for x in (F.lit(k), F.lit(float(v)))])
    joint = F.transform("pattern", lambda p: F.struct(p["hap_id"].alias("hap_id"), (p["h"] * F.coalesce(known[p["hap_id"]], F.lit(0.0))).alias("w")))
    rows = patterns.select("reads", joint.alias("joint")).withColumn("total", F.aggregate("joint", F.lit(0.0), lambda s, x: s + x["w"])).where("total > 0")
    sums = rows.select("reads", "total", F.inline("joint")).groupBy("hap_id").agg(F.sum(F.col("reads") * F.col("w") / F.col("total")).alias("s")).collect()
    total = sum(r["s"] for r in sums) or 1.0
    return {k: 0.0 for k in freq} | {r["hap_id"]: r["s"] / total for r in sums}


def em_frequencies(likelihoods: DataFrame, tolerance: float = 1e-3, rounds: int = 10_000) -> dict[int, float]:
    """Frequencies from equal ones on, until the Euclidean change is at most tolerance; haplotypes are at most a hundred or so."""
    patterns = stored(likelihood_patterns(likelihoods))
    ids = [r["hap_id"] for r in patterns.select(F.explode("pattern.hap_id").alias("hap_id")).distinct().collect()]
    freq, change = {k: 1 / len(ids) for k in ids}, 0.0
    for _ in range(rounds):
        new = em_step(patterns, freq)
        change = sum((new[k] - freq[k]) ** 2 for k in freq) ** 0.5
        freq = new
        if change <= tolerance:
            return freq
    log.warning("frequencies still moved by %g after %d rounds", change, rounds)
    return freq


def true_frequencies(observed: DataFrame, eps: float = 0.002) -> DataFrame:
    """pos, allele, freq, alleles and corrected, the share without errors.

    observed has pos, allele, freq (over ACGT-) and alleles, how many letters of the position are real at least.
    More letters are real while the rank after them is above the observed letter's share; beyond four nothing is
    corrected.  The error is the mean of the other shares, eps at most.
    """
    shares = observed.groupBy("pos").agg(F.sort_array(F.collect_list("freq"), asc=False).alias("sorted"))
    rows = observed.join(shares, "pos")
    real = F.greatest("alleles", F.size(F.filter("sorted", lambda x: x > F.col("freq"))) + 1)
    rest = F.slice("sorted", F.col("real") + 1, 5)
    mean = F.coalesce(F.try_divide(F.aggregate(rest, F.lit(0.0), lambda s, x: s + x), F.lit(5) - F.col("real")), F.lit(0.0))
    error = F.least(mean, F.lit(eps))
    rows = rows.withColumn("real", real.cast("int"))
    return rows.select("pos", "allele", "freq", F.col("real").alias("alleles"), F.when(F.col("real") > 4, F.col("freq")).otherwise((F.col("freq") - error) / (1 - 5 * error)).alias("corrected"))


def vc_frequencies(snps: DataFrame, counts: DataFrame) -> DataFrame:
    """Corrected shares of called SNPs (pos, allele), over ACGT- without N."""
    letters = counts.where("allele <> 'N'").withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))
    at = snps.groupBy("pos").agg((F.count(F.lit(1)) + 1).cast("int").alias("alleles"))
    out = true_frequencies(letters.join(at, "pos").select("pos", "allele", "freq", "alleles"))
    return out.join(snps.select("pos", "allele"), ["pos", "allele"], "left_semi")


def impute(cells: DataFrame, matches: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """N cells of reads that have a haplotype get its letter; matches has read_id and hap_id."""
    known = cells.join(matches, "read_id", "left").join(small(haplotypes.select("hap_id", "pos", F.col("allele").alias("letter"))), ["hap_id", "pos"], "left")
    return known.select("read_id", "pos", F.when(F.col("allele") == "N", F.coalesce("letter", F.lit("N"))).otherwise(F.col("allele")).alias("allele"))


def filled(reads: list[bytes], found: list[bytes]) -> list[bytes]:
    """The reads, of one length, with their N from the first found haplotype that agrees with all of their other letters."""
    size = len(reads[0])
    letters = np.frombuffer(b"".join(reads), dtype=np.uint8).reshape(len(reads), size).copy()
    gone, waits = letters == ord("N"), np.ones(len(reads), dtype=bool)
    for text in found:
        own = np.frombuffer(text[:size], dtype=np.uint8)
        if len(own):
            fits = waits & (gone[:, : len(own)] | (letters[:, : len(own)] == own)).all(axis=1)
            letters[:, : len(own)] = np.where(fits[:, None] & gone[:, : len(own)], own, letters[:, : len(own)])
            waits &= ~fits
    whole = letters.tobytes()
    return [whole[k : k + size] for k in range(0, len(whole), size)]


def impute_strings(reads: DataFrame, found: list[str]) -> DataFrame:
    """read_id and value: `impute` for reads that are rows of padded letters (read_id, seq), of haplotypes in order of rank.

    Each read is filled where it is; no cell is made or shuffled. found has a hundred haplotypes or so at most.
    """
    known = [text.encode() for text in found]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["seq"].cast(pa.binary()).to_pylist()
            sizes: dict[int, list[int]] = {}
            for k, row in enumerate(rows):
                if row:
                    sizes.setdefault(len(row), []).append(k)
            for at in sizes.values():
                for k, row in zip(at, filled([rows[k] for k in at], known), strict=True):
                    rows[k] = row
            yield pa.RecordBatch.from_arrays([batch["read_id"], pa.array(rows, pa.binary()).cast(pa.string())], ["read_id", "value"])

    return reads.select(F.col("read_id").cast("long"), "seq").mapInArrow(fill, "read_id long, value string")
