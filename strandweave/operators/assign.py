"""Reads and the cliques nearest to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.storage import ranked, small, stored


def clique_strings(members: DataFrame, majors: DataFrame) -> DataFrame:
    """clique_id, pos and allele at every position that any clique has: its own allele, or the major one.

    members has clique_id, pos, allele; a clique without members (the consensus) is a row of nulls.
    """
    places = members.where("pos is not null").select("pos").distinct().join(majors, "pos")
    ids = members.select("clique_id").distinct()
    grid = ids.join(F.broadcast(places.agg(F.collect_list(F.struct("pos", "major")).alias("at"))), F.lit(True)).select("clique_id", F.inline("at"))
    own = members.where("pos is not null").select("clique_id", "pos", "allele")
    return grid.join(own, ["clique_id", "pos"], "left").select("clique_id", "pos", F.coalesce("allele", "major").alias("allele"), F.col("allele").isNotNull().alias("is_snp"))


def assign_reads(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """read_id, clique_id and k: the nearest cliques of each read, and how many tie.

    The distance counts differing letters where the read has one; a clique's coincidences are its SNPs that the read
    covers (for a clique without SNPs, all positions).  Only cliques with more coincidences than distance, or that
    differ from it, take part.  Cliques are few, so reads stay where they are and meet them by position.
    """
    bare = strings.groupBy("clique_id").agg((F.max(F.col("is_snp").cast("int")) == 0).alias("bare"))
    table = strings.join(bare, "clique_id").select("clique_id", "pos", F.col("allele").alias("letter"), (F.col("is_snp") | F.col("bare")).cast("int").alias("counts"))
    met = cells.where("allele <> 'N'").join(small(table), "pos")
    sums = met.groupBy("read_id", "clique_id").agg(F.sum((F.col("allele") != F.col("letter")).cast("int")).alias("d"), F.sum("counts").alias("coincidences"))
    fit = sums.where("coincidences > 0 AND coincidences <> d")
    by_read = Window.partitionBy("read_id")
    nearest = fit.withColumn("least", F.min("d").over(by_read)).where("d = least")
    return nearest.select("read_id", "clique_id", F.count(F.lit(1)).over(by_read).alias("k"))


def cluster_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("clique_id").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.lit(1.0) / F.col("k")).alias("weight"))


def top_clusters(sizes: DataFrame, limit: int = 100, more_than: int = 10) -> DataFrame:
    """The heaviest clusters, of more than that many reads."""
    return sizes.where(F.col("reads") > more_than).orderBy(F.desc("weight"), "clique_id").limit(limit)


def low_quality_filter(cells: DataFrame, majors: DataFrame, snp_positions: DataFrame, share: float = 0.9, cap: int = 2999) -> DataFrame:
    """read_id and mistakes of the reads with fewest mistakes, the first ceil(share * n).

    A mistake is a letter other than the major one, outside N and the positions of cliques.  Reads are ranked by
    counting how many have each number of mistakes; only the reads of one number of mistakes need an order among them,
    and are numbered by ranges of their ids.
    """
    marks = majors.join(snp_positions.select("pos").distinct().withColumn("snp", F.lit(True)), "pos", "left")
    marked = cells.join(small(marks), "pos")
    wrong = (F.col("allele") != F.col("major")) & (F.col("allele") != "N") & F.col("snp").isNull()
    mistakes = stored(marked.groupBy("read_id").agg(F.least(F.count_if(wrong), F.lit(cap)).alias("mistakes")))
    counts = mistakes.groupBy("mistakes").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("mistakes").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("mistakes", "n", before.alias("before"), F.ceil(F.sum("n").over(Window.partitionBy()) * F.lit(share)).alias("limit"))
    whole = counts.where("before + n <= limit").select("mistakes")
    partly = counts.where("before < limit AND before + n > limit").select("mistakes", (F.col("limit") - F.col("before")).alias("room"))
    at_border = ranked(mistakes.join(F.broadcast(partly), "mistakes"), [F.col("read_id")], "place").where("place <= room")
    return mistakes.join(whole, "mistakes", "left_semi").select("read_id", "mistakes").union(at_border.select("read_id", "mistakes"))


def source_clique(haplotypes: DataFrame, members: DataFrame) -> DataFrame:
    """hap_id and clique_id: of the cliques whose SNPs a haplotype has all of, the largest, then the smallest id.

    haplotypes has hap_id, pos, allele; a clique without members matches any.
    """
    sizes = members.groupBy("clique_id").agg(F.count("pos").alias("size"))
    hits = haplotypes.join(members.where("pos is not null"), ["pos", "allele"]).groupBy("hap_id", "clique_id").agg(F.count(F.lit(1)).alias("hits"))
    full = hits.join(sizes, "clique_id").where("hits = size").select("hap_id", "clique_id", "size")
    empty = sizes.where("size = 0").agg(F.min("clique_id").alias("empty"))
    best = full.groupBy("hap_id").agg(F.max_by("clique_id", F.struct("size", -F.col("clique_id"))).alias("clique_id"))
    return haplotypes.select("hap_id").distinct().join(best, "hap_id", "left").join(F.broadcast(empty), F.lit(True), "left").select("hap_id", F.coalesce("clique_id", "empty").alias("clique_id"))
