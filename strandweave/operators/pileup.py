"""Pileups (read_id, pos, allele), profiles, consensus and reads' geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.alleles import ALPHABET, allele_index, merged_left, overlaps, split_code
from strandweave.storage import by_read


def explode_reads(reads: DataFrame, seq: str = "seq", off: str = "off") -> DataFrame:
    """One row for each letter of each read segment."""
    return reads.select("read_id", F.posexplode(F.split(seq, "")).alias("_i", "allele"), F.col(off).alias("_off")).select("read_id", (F.col("_off") + F.col("_i")).cast("int").alias("pos"), "allele").where("allele <> ''")


def coverage(pile: DataFrame, with_n: bool = True) -> DataFrame:
    """pos, allele and n; partial counts are combined before the shuffle, so a deep position costs little."""
    rows = pile if with_n else pile.where("allele <> 'N'")
    return rows.groupBy("pos", "allele").agg(F.count(F.lit(1)).alias("n"))


def profile(counts: DataFrame) -> DataFrame:
    """freq: each count's share of all letters at its position, N included."""
    total = F.sum("n").over(Window.partitionBy("pos"))
    return counts.withColumn("freq", F.when(total == 0, F.lit(0.0)).otherwise(F.col("n") / total))


def weighted_profile(pile: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """freq of alleles where each read counts 1 / k; weights has read_id, k and the columns of by."""
    by = by or []
    sums = by_read(pile, weights).groupBy(*by, "pos", "allele").agg(F.sum(F.lit(1.0) / F.col("k")).alias("weight"))
    return sums.withColumn("freq", F.col("weight") / F.sum("weight").over(Window.partitionBy(*by, "pos")))


def consensus(counts: DataFrame, deletions: bool = True, value: str = "n", least: float | None = None, by: list[str] | None = None) -> DataFrame:
    """pos and major: the allele of most reads, ties to the lowest index, N where nothing is covered.

    deletions: whether `-` may win. least: a smaller winning value gives N.
    """
    by = by or []
    wins = (F.col("allele") != "N") & (F.lit(deletions) | (F.col("allele") != "-"))
    best = F.max_by("allele", F.struct(F.col(value), -allele_index(F.col("allele")))).alias("major")
    top = F.max(value)
    out = counts.where(wins & (F.col(value) > 0)).groupBy(*by, "pos").agg(best, top.alias("top"))
    if least is not None:
        out = out.withColumn("major", F.when(F.col("top") < least, F.lit("N")).otherwise(F.col("major")))
    spine = counts.select(*by, "pos").distinct()
    return spine.join(out, [*by, "pos"], "left").select(*by, "pos", F.coalesce("major", F.lit("N")).alias("major"))


def consensus_string(majors: DataFrame, column: str = "major", by: list[str] | None = None) -> DataFrame:
    """One string; positions are bounded by the reference's length."""
    rows = F.array_sort(F.collect_list(F.struct("pos", column)))
    return majors.groupBy(*(by or [])).agg(F.array_join(F.transform(rows, lambda x: x[column]), "").alias("consensus"))


def profile_matrix(counts: DataFrame) -> DataFrame:
    """row_no, allele and line: counts of A, C, G, T and - at all positions, each followed by a tab."""
    spine = counts.select("pos").distinct()
    rows = spine.select("pos", F.posexplode(F.array(*[F.lit(a) for a in ALPHABET[:5]])).alias("row_no", "allele"))
    cells = rows.join(counts, ["pos", "allele"], "left").select("row_no", "allele", "pos", F.coalesce("n", F.lit(0)).alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit("\t"))), "")
    return cells.groupBy("row_no", "allele").agg(line.alias("line"))


def profile_columns(counts: DataFrame, letters: str = "ACGT-") -> DataFrame:
    """The profile's matrix with positions as rows: pos and line, the counts of the letters in order."""
    each = [F.sum(F.when(F.col("allele") == c, F.col("n")).otherwise(0)).cast("string") for c in letters]
    return counts.groupBy("pos").agg(F.concat_ws("\t", *each).alias("line"))


def sparse(pile: DataFrame, majors: DataFrame) -> DataFrame:
    """The cells that are not major (minors and N), with the minor's split code (null for N)."""
    rows = pile.join(F.broadcast(majors), "pos").where("allele <> major")
    code = F.when(F.col("allele") != "N", split_code(F.col("pos"), F.col("allele"), F.col("major")))
    return rows.select("read_id", "pos", "allele", "major", code.alias("v"))


def major_counts(pile: DataFrame, majors: DataFrame) -> DataFrame:
    return pile.join(F.broadcast(majors), "pos").groupBy("pos").agg(F.count_if(F.col("allele") == F.col("major")).alias("majors"))


def n_counts(pile: DataFrame) -> DataFrame:
    return pile.groupBy("pos").agg(F.count_if(F.col("allele") == "N").alias("n_reads"))


def merge_overlaps(pairs: DataFrame) -> DataFrame:
    """Overlapping mates become one read; others stay."""
    over = overlaps(F.col("l"), F.col("l_off"), F.col("r_off"))
    return pairs.select(
        "read_id",
        merged_left(F.col("l"), F.col("l_off"), F.col("r"), F.col("r_off")).alias("l"),
        "l_off",
        F.when(over, F.lit("")).otherwise(F.col("r")).alias("r"),
        F.when(over, F.lit(-1)).otherwise(F.col("r_off")).alias("r_off"),
    )


def shapes(pairs: DataFrame) -> DataFrame:
    """read_id and the inclusive ranges that a read covers; -1 and -2 stand for no right mate."""
    return pairs.select("read_id", "l_off", (F.col("l_off") + F.length("l") - 1).alias("l_end"), "r_off", F.when(F.col("r_off") >= 0, F.col("r_off") + F.length("r") - 1).otherwise(F.lit(-2)).alias("r_end"))


def known_letters(seq: Column) -> tuple[Column, Column]:
    """Where a padded read's first known letter is, and its letters without the N at both ends."""
    body = F.ltrim(seq, F.lit("N"))
    return (F.length(seq) - F.length(body)).cast("int"), F.rtrim(body, F.lit("N"))


def padded_shapes(reads: DataFrame) -> DataFrame:
    """Like `shapes`, of padded reads (read_id, seq); a read of N alone covers nothing, written as -1 to -1."""
    off, body = known_letters(F.col("seq"))
    known = F.length(body) > 0
    return reads.select("read_id", F.when(known, off).otherwise(-1).alias("l_off"), F.when(known, off + F.length(body) - 1).otherwise(-1).alias("l_end"), F.lit(-1).alias("r_off"), F.lit(-2).alias("r_end"))


def read_stats(pairs: DataFrame) -> DataFrame:
    """n_reads, n_single, n_paired, reference_length and single_read (more single reads than pairs)."""
    end = F.greatest(F.col("l_off") + F.length("l"), F.when(F.col("r_off") >= 0, F.col("r_off") + F.length("r")).otherwise(0))
    single = F.count_if(F.col("r_off") < 0)
    paired = F.count_if(F.col("r_off") >= 0)
    return pairs.agg(F.count(F.lit(1)).alias("n_reads"), single.alias("n_single"), paired.alias("n_paired"), F.max(end).cast("int").alias("reference_length")).withColumn("single_read", F.col("n_paired") < F.col("n_single"))


def fragment_length(pairs: DataFrame, length: int) -> DataFrame:
    """The smallest fragment length that more than nine tenths of the reads do not exceed; lengths are counted first."""
    size = F.when(F.col("r_off") >= 0, F.least(F.col("r_off") + F.length("r") - F.col("l_off"), F.lit(length - 1))).otherwise(F.length("l"))
    counts = pairs.groupBy(size.cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("size", running.alias("upto"), total.alias("all")).where("upto > 0.9 * all").agg(F.min("size").alias("fragment_length"))


def most_covered_position(depth: DataFrame, start: int = 0, end: int = 1_000_000) -> DataFrame:
    """The median of the positions of greatest depth; depth has pos and depth."""
    inside = depth.where(F.col("pos").between(start, end))
    top = inside.agg(F.max("depth").alias("most"))
    places = inside.join(F.broadcast(top), F.col("depth") == F.col("most")).agg(F.array_sort(F.collect_list("pos")).alias("at"))
    return places.select(F.element_at("at", (F.floor(F.size("at") / 2) + 1).cast("int")).alias("pos"))
