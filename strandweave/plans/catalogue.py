"""The registered queries of the sequence engine, over reads derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave import metrics
from strandweave.functions import alleles, binomial, linkage_tests, pair_em
from strandweave.operators import assign, bitmaps, deletions, graph, haplotypes, linkage, pileup, seek
from strandweave.plans import oracles, pipelines
from strandweave.plans.samples import Sample, long_sample, short_sample
from strandweave.sources import fixture, intervals, text, writers
from strandweave.storage import small

LEAST, SHARE = 10, 0.02


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.coverage(fixture.pileup(spark, sf_dir))


def coverage_counts_no_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.coverage(fixture.pileup(spark, sf_dir), with_n=False)


def profile_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.profile(coverage_counts(spark, sf_dir)).withColumn("freq", F.round("freq", 9))


def consensus_with_del(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.consensus(coverage_counts(spark, sf_dir))


def consensus_no_del(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_sample(spark, sf_dir).majors


def consensus_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.consensus_string(consensus_with_del(spark, sf_dir))


def profile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.profile_matrix(short_sample(spark, sf_dir).counts)


def minors_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    return pileup.sparse(s.pile, s.majors).drop("major")


def major_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    return pileup.major_counts(s.pile, s.majors)


def n_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.n_counts(fixture.pileup(spark, sf_dir))


def split_encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    rows = s.counts.join(s.majors, "pos").where("allele <> major AND allele <> 'N'")
    rows = rows.withColumn("v", alleles.split_code(F.col("pos"), F.col("allele"), F.col("major")))
    return rows.select("pos", "allele", "n", "v", alleles.split_position(F.col("v")).alias("decoded_pos"), alleles.split_allele(F.col("v"), F.col("major")).alias("decoded"))


def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixture.pair_reads(spark, sf_dir)
    moved = F.when(F.col("r_off") >= 0, F.col("l_off") + 15 + F.col("read_id") % 20).otherwise(F.lit(-1)).cast("int")
    return pileup.merge_overlaps(pairs.withColumn("r_off", moved))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM-like records: mates of the derived reads, some not flagged as paired, some with a third record."""
    rid = F.col("read_id")
    single = rid % 3 == 0
    mates = fixture.segments(spark, sf_dir)
    extra = mates.where((rid % 13 == 0) & (F.col("mate") == 0)).withColumn("mate", F.lit(2))
    rows = mates.unionByName(extra)
    start = F.col("off") + 1
    mate_start = F.when(single, start).when(F.col("mate") == 1, F.col("off") - 34).otherwise(F.col("off") + 36)
    flag = F.when((rid % 11 == 0) | (single & (F.col("mate") != 2)), 0).otherwise(1)
    return rows.select((rid * 4 + F.col("mate")).alias("rec_id"), rid.alias("qname"), start.alias("pos"), mate_start.alias("pnext"), flag.alias("flag"))


def mate_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.pair_mates(_records(spark, sf_dir))


def cigar_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") + F.col("l_linenumber")
    a, b, c, e = (k % 4).cast("int"), (10 + k % 7).cast("int"), (1 + k % 3).cast("int"), (1 + k % 5).cast("int")
    cigar = F.format_string("%dS%dM%dI12M%dD%dM", a, b, c, e, 48 - a - b - c)
    seq = F.substring(F.lit("ACGTTGCATTAGC" * 6), (1 + F.col("l_partkey") % 13).cast("int"), F.lit(60))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", seq.alias("seq"), cigar.alias("cigar"))
    return rows.select("l_orderkey", "l_linenumber", text.project_cigar(F.col("seq"), F.col("cigar")).alias("projected"))


def interval_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s, e, x = 100 + k % 977, 2000 + k, 1 + k % 300
    name = F.concat(F.lit("chr"), (k % 22).cast("string"))
    written = F.when(k % 3 == 0, F.format_string("%s:%,d-%,d", name, s, e)).when(k % 3 == 1, F.format_string("%s:%d+%dbp", name, s, x)).otherwise(F.format_string("%s:%d-%d+%d", name, s, e, x))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, intervals.parse(written).alias("i")).select("o_orderkey", "i.contig", "i.start", "i.end")


def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "kb", "MB", "bp", "b", "k", "m", "q")]), (k % 8 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, intervals.quantity(F.concat(F.format_string("%,d", k), unit)).alias("value"))


def contig_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("chr1", "1", "CHR1", "chr2", "2", "chrM", "MT", "chrX", "x", "y9")
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_custkey") % 10 + 1).cast("int")).alias("name"))
    listed = spark.createDataFrame([("chr1",), ("2",), ("MT",), ("chrX",)], "contig string")
    counts = asked.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return intervals.resolve_contigs(counts, listed).join(counts, "name").select("name", "contig", "n")


def minor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_sample(spark, sf_dir).joint.where("a1 <> 'N' AND a2 <> 'N'").withColumnRenamed("n", "o22")


def common_reads_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    return linkage.common_reads(s.found(LEAST).select("p1", "p2").distinct(), s.cells, s.shapes)


def common_reads_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pairs of positions."""
    s = long_sample(spark, sf_dir)
    gone = s.inner.where("allele = 'N'")
    places = spark.range(fixture.LENGTH).select(F.col("id").cast("int").alias("pos"))
    pairs = places.select(F.col("pos").alias("p1")).join(places.select(F.col("pos").alias("p2")), F.col("p1") < F.col("p2"))
    return linkage.common_reads(pairs, gone, s.shapes)


def _linked(s: Sample) -> DataFrame:
    return s.table(s.found(LEAST))


def linkage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(short_sample(spark, sf_dir))


def edges_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _linked(short_sample(spark, sf_dir)).where("o22 / reads > 0.02")
    value = linkage_tests.ratio(*(F.col(c) for c in ("o11", "o12", "o21", "o22")), linkage_tests.SHORT_READ_ERROR)
    return rows.withColumn("ratio", F.round(value, 6)).where(value > 0.2)


def edges_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_sample(spark, sf_dir).tested(LEAST, SHARE).select("p1", "a1", "p2", "a2", "is_edge")


def linked_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_sample(spark, sf_dir).edges(LEAST, SHARE).withColumn("rel_freq", F.round(linkage.rel_freq(F.col("o22"), F.col("reads")), 9))


def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linkage.top_edges(_linked(short_sample(spark, sf_dir)), 20)
    return rows.select("p1", "a1", "p2", "a2", "o22", "reads", F.round("rel_freq", 9).alias("rel_freq"))


def second_minor_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    return linkage.prune_second_minors(s.found(LEAST), s.frequencies)


def frequent_minor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linkage.rotation_candidates(short_sample(spark, sf_dir).profile, least_share=0.2)
    return rows.withColumn("freq", F.round("freq", 9))


def _planted(s: Sample) -> DataFrame:
    """clique_id, pos, allele of the planted haplotypes' differences from the consensus; one row of nulls where none."""
    t = fixture.truth(s.pile.sparkSession)
    differ = t.join(s.majors, "pos").where("allele <> major").select(F.col("haplotype").alias("clique_id"), "pos", "allele")
    return t.select(F.col("haplotype").alias("clique_id")).distinct().join(differ, "clique_id", "left")


def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    own = _planted(s).where("pos is not null").select("clique_id", graph.vertex(F.col("pos"), F.col("allele")).alias("v"))
    both = own.union(own.select(F.lit(0).alias("clique_id"), "v"))
    cliques = both.groupBy(F.col("clique_id").cast("long").alias("clique_id")).agg(F.array_sort(F.collect_set("v")).alias("vs"))
    return graph.resolve_conflicts(cliques, s.frequencies).select("clique_id", F.array_join("vs", ",").alias("vs"))


def deletion_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletions.deletion_regions(fixture.segment_reads(spark, sf_dir), LEAST)


def deletion_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletions.deletion_edges(deletion_regions(spark, sf_dir))


def fragment_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.fragment_length(fixture.pair_reads(spark, sf_dir), fixture.LENGTH)


def most_covered_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.most_covered_position(coverage_counts(spark, sf_dir).groupBy("pos").agg(F.sum("n").alias("depth")))


def read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.read_stats(fixture.pair_reads(spark, sf_dir))


def _graph(s: Sample) -> DataFrame:
    rows = s.edges(LEAST, SHARE)
    return pipelines.stored(rows.select(graph.vertex(F.col("p1"), F.col("a1")).alias("u"), graph.vertex(F.col("p2"), F.col("a2")).alias("v")))


def snp_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_graph(short_sample(spark, sf_dir)))


def _cliques(edges: DataFrame) -> DataFrame:
    return pipelines.stored(graph.numbered(graph.maximal_cliques(edges)))


def maximal_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cliques(_graph(short_sample(spark, sf_dir))).select("clique_id", F.array_join("vs", ",").alias("vs"))


def merge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(short_sample(spark, sf_dir))
    return graph.merge_scores(_cliques(edges), edges)


def subset_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    cliques = _cliques(_graph(short_sample(spark, sf_dir)))
    more = cliques.where(F.size("vs") > 2).select(F.slice("vs", 1, 2).alias("vs"), (F.col("clique_id") + 1000).alias("clique_id"))
    return graph.largest(cliques.unionByName(more)).select("clique_id", F.array_join("vs", ",").alias("vs"))


def merged_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    edges = _graph(s)
    cliques = _cliques(edges)
    merged = graph.merge_accurate(cliques, edges, pipelines.no_edge_pairs(s, cliques, edges, SHARE))
    return merged.select(F.array_join("vs", ",").alias("vs"))


def non_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    edges = _graph(s)
    nodes = edges.select("u").union(edges.select("v")).distinct()
    return pipelines.non_edges(s, nodes, SHARE).select("p1", "a1", "p2", "a2", "reads", "o22")


def edge_graph_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of minors and of the deletions of a region, without second minors beside a more frequent deletion."""
    return pipelines.edge_graph(short_sample(spark, sf_dir), LEAST, SHARE, False)


def no_edge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    edges = _graph(s)
    return pipelines.no_edge_pairs(s, _cliques(edges), edges, SHARE)


def clique_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    rows = assign.clique_strings(_planted(s), s.majors)
    row = F.array_sort(F.collect_list(F.struct("pos", "allele")))
    return rows.groupBy("clique_id").agg(F.array_join(F.transform(row, lambda x: x["allele"]), "").alias("letters"))


def _assigned(s: Sample) -> DataFrame:
    return assign.assign_reads(s.pile, assign.clique_strings(_planted(s), s.majors))


def read_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(short_sample(spark, sf_dir))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.cluster_sizes(read_assignment(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def weighted_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    rows = pileup.weighted_profile(s.pile, _assigned(s), by=["clique_id"])
    return rows.select(F.col("clique_id").cast("long").alias("clique_id"), "pos", "allele", F.round("weight", 6).alias("weight"), F.round("freq", 9).alias("freq"))


def low_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    return assign.low_quality_filter(s.pile, s.majors, _planted(s).where("pos is not null").select("pos"))


def _likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = fixture.truth(spark).withColumnRenamed("haplotype", "hap_id")
    return haplotypes.read_likelihoods(fixture.pileup(spark, sf_dir), planted, 0.001, n_is_mismatch=True)


def read_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _likelihoods(spark, sf_dir).withColumn("h", F.round("h", 9))


def em_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = haplotypes.em_step(haplotypes.likelihood_patterns(_likelihoods(spark, sf_dir)), dict.fromkeys(range(4), 0.25))
    return spark.createDataFrame([(k, round(v, 9)) for k, v in freq.items()], "hap_id int, frequency double")


def em_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = haplotypes.em_frequencies(_likelihoods(spark, sf_dir))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in freq.items()], "hap_id int, frequency double")


def _called(s: Sample) -> DataFrame:
    return _planted(s).where("pos is not null").select("pos", "allele").distinct()


def vc_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    rows = haplotypes.vc_frequencies(_called(s), s.counts)
    return rows.select("pos", "allele", F.round("freq", 9).alias("freq"), "alleles", F.round("corrected", 9).alias("corrected"))


def vcf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    return writers.vcf_rows(haplotypes.vc_frequencies(_called(s), s.counts), s.majors)


def imputed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads are filled as strings; orders that share a key are one read, of several letters a position, and go by cells."""
    planted = fixture.truth(spark).withColumnRenamed("haplotype", "hap_id")
    listed = _strings(planted, "hap_id").orderBy("hap_id").collect()
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderkey").alias("again")).agg(F.count(F.lit(1)).alias("n"))
    again = small(keys.where("n > 1").select("again"))
    reads = fixture.long_reads(spark, sf_dir)
    if again.limit(1).count() == 0:
        return haplotypes.impute_strings(reads, [r["haplotype"] for r in listed])
    same = F.col("read_id").eqNullSafe(F.col("again"))
    once = haplotypes.impute_strings(reads.join(again, same, "left_anti"), [r["haplotype"] for r in listed])
    cells = long_sample(spark, sf_dir).pile.join(again, same, "left_semi")
    ranks = spark.range(4).select(F.col("id").cast("int").alias("hap_id"), F.col("id").cast("int").alias("rank"))
    return once.union(writers.imputed_lines(haplotypes.impute(cells, pipelines.containing_haplotype(cells, planted, ranks), planted)))


def _with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read segments with the consensus of the most frequent planted haplotype beside them."""
    reference = pileup.consensus_string(fixture.truth(spark).where("haplotype = 0"), "allele")
    reads = fixture.segment_reads(spark, sf_dir).join(F.broadcast(reference), F.lit(True))
    return reads.select("read_id", "mate", "seq", F.substring("consensus", F.col("off") + 1, F.length("seq")).alias("reference"))


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_reference(spark, sf_dir).select("read_id", "mate", alleles.hamming(F.col("seq"), F.col("reference")).cast("long").alias("distance"))


def string_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_reference(spark, sf_dir).select("read_id", "mate", F.array_join(alleles.differences(F.col("seq"), F.col("reference")), ";").alias("difference"))


def nearest_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 20).alias("g"))
    counts = fixture.pileup(spark, sf_dir).join(owners, "read_id").groupBy("g", "pos", "allele").agg(F.count(F.lit(1)).alias("n"))
    results = pileup.consensus(counts, by=["g"]).select(F.col("g").alias("result"), "pos", F.col("major").alias("allele"))
    rows = pipelines.nearest_results(fixture.truth(spark).withColumnRenamed("haplotype", "truth"), results)
    return rows.select(F.col("truth").alias("haplotype"), F.col("result").alias("nearest"), "distance", "found")


def smart_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice") / F.pow(F.lit(10), F.col("o_orderkey") % 14)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", alleles.smart_double(x).alias("text"))


def si_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    factor = F.element_at(F.array(*[F.lit(v) for v in (1, 37, 4001, 500009, 70000027)]), (k % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, alleles.si_format(k * factor).alias("text"))


def near_duplicate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus strings of the 20 customer groups, merged within one difference."""
    owners = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 20).alias("g"))
    rows = fixture.pileup(spark, sf_dir).join(owners, "read_id")
    counts = rows.groupBy("g", "pos", "allele").agg(F.count(F.lit(1)).alias("n"))
    found = pileup.consensus_string(pileup.consensus(counts, by=["g"]), by=["g"]).join(owners.groupBy("g").agg(F.count(F.lit(1)).alias("reads")), "g")
    rows = found.select(F.col("consensus").alias("haplotype"), (F.col("reads") / owners.count()).alias("frequency"))
    return haplotypes.merge_near_rows(rows).select("haplotype", F.round("frequency", 9).alias("frequency"))


def minor_hits_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint counts of minors from bitmaps of their reads instead of joined reads."""
    cells = short_sample(spark, sf_dir).cells.where("allele <> 'N'")
    return bitmaps.intersections(bitmaps.index(cells)).withColumnRenamed("n", "o22")


def minor_reads_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each minor's bitmaps, how many reads they hold, and the least and greatest of them."""
    found = bitmaps.index(short_sample(spark, sf_dir).cells.where("allele <> 'N'"))
    ends = bitmaps.reads_of(found).groupBy("pos", "allele").agg(F.min("read_id").alias("first_read"), F.max("read_id").alias("last_read"))
    return bitmaps.sizes(found).join(ends, ["pos", "allele"])


def floor_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line's order the last of a list of numbers that does not exceed it."""
    values = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") * 13).alias("value"))
    asks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return seek.floor_seek(values, asks, ask="l_orderkey").select("l_orderkey", "l_linenumber", "floor", F.col("index").alias("place"))


def transitive_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the transitive way of merging: pairs of a component that chance doesn't explain."""
    s = short_sample(spark, sf_dir)
    return pipelines.transitive(s, _graph(s))


def _strings(rows: DataFrame, key: str) -> DataFrame:
    return pileup.consensus_string(rows, "allele", by=[key]).withColumnRenamed("consensus", "haplotype")


def haplotype_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FASTA report of the planted haplotypes with their shares of the reads, over a part of the reference."""
    owners = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(fixture.haplotype_of(F.col("o_custkey")).alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    shares = owners.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy()))
    rows = _strings(fixture.truth(spark).withColumnRenamed("haplotype", "rank"), "rank").join(shares, "rank")
    return writers.fasta_lines(rows, "sample", "extended3", 10, 60)


def equal_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer groups whose consensus is one string, as one haplotype."""
    owners = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 20).alias("g"))
    counts = fixture.pileup(spark, sf_dir).join(owners, "read_id").groupBy("g", "pos", "allele").agg(F.count(F.lit(1)).alias("n"))
    found = pileup.consensus_string(pileup.consensus(counts, by=["g"]), by=["g"]).select(F.col("g").alias("clique_id"), F.col("consensus").alias("haplotype"), F.array().cast("array<string>").alias("snps"))
    return haplotypes.merge_equal(found).select("haplotype", "hap_id", F.array_join(F.col("cliques").cast("array<string>"), ",").alias("groups"))


def read_assignment_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(long_sample(spark, sf_dir))


def read_likelihood_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the long form: N is no mismatch, and every read is as long as the reference."""
    planted = fixture.truth(spark).withColumnRenamed("haplotype", "hap_id")
    return haplotypes.read_likelihoods(fixture.long_pileup(spark, sf_dir), planted, 0.01, n_is_mismatch=False, length=fixture.LENGTH).withColumn("h", F.round("h", 9))


def default_haplotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.default_haplotype(short_sample(spark, sf_dir)).frame(spark).select("haplotype", "frequency")


def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reads each planted haplotype has."""
    s = short_sample(spark, sf_dir)
    ranks = spark.range(4).select(F.col("id").cast("int").alias("rank"), F.array("id").alias("cliques"))
    names = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"))
    return writers.read_names(ranks, _assigned(s), names)


def exploded_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from the strings of the reads instead of their cells."""
    return pileup.coverage(pileup.explode_reads(fixture.segment_reads(spark, sf_dir)))


def closure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure_edges(_cliques(_graph(short_sample(spark, sf_dir))))


def clique_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.clique_slice(_cliques(_graph(short_sample(spark, sf_dir))), 30, 60)
    return rows.select("clique_id", F.array_join("vs", ",").alias("vs"))


def deletion_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletions.islands(fixture.pileup(spark, sf_dir))


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.profile_columns(short_sample(spark, sf_dir).counts)


def window_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a window in the middle, with two planted haplotypes known."""
    s = short_sample(spark, sf_dir)
    known = _planted(s).where("clique_id IN (1, 3) AND pos is not null").select(F.col("clique_id").alias("hap"), graph.vertex(F.col("pos"), F.col("allele")).alias("v"))
    return pipelines.window_edges(_graph(s), known, 30, 62)


def masked_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster haplotypes, with the consensus where a cluster has few reads, or where the one without SNPs has few of its letter."""
    s = short_sample(spark, sf_dir)
    assigned = pipelines.stored(_assigned(s))
    letters = haplotypes.cluster_haplotypes(s.pile, assigned, s.majors)
    empty = _planted(s).groupBy("clique_id").agg(F.count("pos").alias("size")).where("size = 0")
    rows = haplotypes.mask_low_support(letters, pipelines.support(s.pile, assigned, letters), empty, least_depth=200, least_count=4000)
    return haplotypes.strings(rows).select("clique_id", "haplotype")


def haplotypes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.whole_haplotypes(short_sample(spark, sf_dir), LEAST, 0.02).frame(spark)


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the graph, its cliques and the pairs of them that can't be joined, as observed while they were made."""
    s = short_sample(spark, sf_dir)
    with metrics.collected() as notes:
        edges = _graph(s)
        cliques = pipelines.unmerged(edges)
        pipelines.refused(s, cliques, edges, SHARE)
    found = metrics.values(notes)
    rows = [(name, figure, int(value or 0)) for name, times in found.items() for each in times for figure, value in each.items()]
    return spark.createDataFrame(rows, "part string, figure string, value long")


def pair_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotype frequencies of each candidate pair of minors, with errors of one in a hundred."""
    rows = _linked(short_sample(spark, sf_dir))
    em = pair_em.pair_frequencies([F.col(c) for c in ("o11", "o12", "o21", "o22")], (0.01, 0.01), (0.01, 0.01))
    return rows.withColumn("em", em).select("p1", "a1", "p2", "a2", *[F.round(F.col("em.f")[k], 6).alias(n) for k, n in enumerate(("f11", "f12", "f21", "f22"))], "em.rounds")


def letter_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, alleles.digit_letter((k % 7).cast("string")).alias("letter"))


def padded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.segment_reads(spark, sf_dir).select("read_id", "mate", alleles.padded(F.col("seq"), F.lit(70)).alias("padded"))


def letters_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each read the letter at a position of its own, within a mate, in the gap or outside."""
    reads = fixture.pair_reads(spark, sf_dir).withColumn("pos", (30 + F.col("read_id") % 60).cast("int"))
    return reads.select("read_id", "pos", alleles.char_at(*(F.col(c) for c in ("l", "l_off", "r", "r_off", "pos"))).alias("letter"))


def normalised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of letters; every tenth position has a total of 0, which leaves the count."""
    counts = coverage_counts_no_n(spark, sf_dir)
    total = F.when(F.col("pos") % 10 == 0, 0).otherwise(F.sum("n").over(Window.partitionBy("pos")))
    return counts.withColumn("total", total).select("pos", "allele", F.round(alleles.normalised(F.col("n"), F.col("total")), 9).alias("share"))


def minus_log_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unlikely each count is among its position's reads if letters were even."""
    rows = coverage_counts(spark, sf_dir).withColumn("depth", F.sum("n").over(Window.partitionBy("pos")))
    value = binomial.binomial_minus_log(F.col("n").cast("double"), F.col("depth").cast("double"), F.lit(0.25))
    return rows.select("pos", "allele", "n", F.round(value, 3).alias("minus_log"))


def edge_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _linked(short_sample(spark, sf_dir)).where("o22 / reads > 0.02")
    p = linkage_tests.edge_p(*(F.col(c) for c in ("o11", "o12", "o21", "o22", "reads")), linkage_tests.SHORT_READ_ERROR)
    return rows.select("p1", "a1", "p2", "a2", F.round(p, 9).alias("p"))


def linked_variants_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked minors of the long reads, more than five positions apart and without deletions."""
    return long_sample(spark, sf_dir).edges(LEAST, SHARE, drop_deletions=True)


def heaviest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign.top_clusters(assign.cluster_sizes(read_assignment(spark, sf_dir)), 3)
    return rows.withColumn("weight", F.round("weight", 6))


def cluster_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    rows = haplotypes.strings(haplotypes.cluster_haplotypes(s.pile, pipelines.stored(_assigned(s)), s.majors))
    return rows.select("clique_id", "haplotype", F.array_join("snps", ",").alias("snps"))


def source_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.source_clique(fixture.truth(spark).withColumnRenamed("haplotype", "hap_id"), _planted(short_sample(spark, sf_dir)))


def _planted_cliques(s: Sample) -> DataFrame:
    own = _planted(s).where("pos is not null")
    return own.groupBy("clique_id").agg(F.array_sort(F.collect_set(graph.vertex(F.col("pos"), F.col("allele")))).alias("vs"))


def truth_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    return pipelines.truth_mismatches(_planted_cliques(s), _cliques(_graph(s)))


def clique_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each clique of the short reads' graph, the planted haplotype that lacks fewest of its SNPs."""
    s = short_sample(spark, sf_dir)
    rows = pipelines.clique_mismatches(_cliques(_graph(s)), _planted_cliques(s))
    return rows.select("clique_id", "size", "truth", "mismatches")


def missed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    return pipelines.missed_edges(_planted_cliques(s), _graph(s), fixture.LENGTH)


def haplotypes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.long_haplotypes(long_sample(spark, sf_dir), LEAST, 0.02).frame(spark)


def haplotypes_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.short_haplotypes(short_sample(spark, sf_dir), LEAST, 0.02).frame(spark)


def variants_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = short_sample(spark, sf_dir)
    return writers.vcf_rows(pipelines.short_variants(s, LEAST, 0.02), s.majors)


def variants_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = long_sample(spark, sf_dir)
    return writers.vcf_rows(pipelines.long_variants(s, LEAST, 0.02), s.majors)


_QUERIES = (
    coverage_counts, coverage_counts_no_n, profile_freq, weighted_profile, consensus_with_del, consensus_no_del, consensus_string, profile_matrix,
    minors_sparse, major_counts, n_index, split_encode_roundtrip, overlap_merge, mate_pairing, cigar_projection, interval_parse, quantity_parse, contig_alias,
    minor_hits, common_reads_short, common_reads_long, linkage_table, edges_ratio, edges_pvalue, linked_variants, non_edges, top_edges, second_minor_prune,
    conflict_resolution, frequent_minor_candidates, deletion_regions, deletion_edges, fragment_length, most_covered_position, read_stats, snp_components,
    maximal_cliques, merged_cliques, clique_strings, merge_scores, subset_elimination, edge_graph_short, no_edge_pairs, read_assignment, cluster_sizes, low_quality_filter, read_likelihood,
    em_one_step, em_frequencies, vc_frequencies, vcf_rows, imputed_reads, hamming_pairs, string_difference, nearest_truth, smart_double, si_format,
    letter_digits, padded_segments, letters_at, normalised_counts, minus_log_chances, edge_chances, linked_variants_long, heaviest_clusters, cluster_haplotypes,
    source_cliques, truth_mismatches, clique_mismatches, missed_edges, near_duplicate_merge, minor_hits_bitmap, minor_reads_bitmap, floor_seek, transitive_graph, pair_frequencies, graph_metrics, haplotype_fasta, equal_haplotypes, read_assignment_long,
    read_likelihood_long, default_haplotype, read_names, exploded_coverage, closure_edges, clique_slices, deletion_islands, profile_columns, window_edges, masked_haplotypes, haplotypes_whole, haplotypes_long, haplotypes_short, variants_short, variants_long,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
