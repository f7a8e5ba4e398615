"""From reads to haplotypes and variants, for short and long reads."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import linkage_tests
from strandweave.metrics import note
from strandweave.operators import assign, deletions, graph, haplotypes, linkage, pileup
from strandweave.plans.samples import Sample
from strandweave.storage import by_read, small, stored

__all__ = ["stored"]

#: Fixed values.
MANY_READS = 50
NON_EDGE_P = 1e-4
SHORT_RATE, LONG_RATE = 0.001, 0.01
SHORT_CUT = 8e-4
CONSENSUS_SHARE = 0.25
TOP_CLUSTERS, CLUSTER_READS = 100, 10
TOP_EDGES = 17_000
UNLINKED_P, INDUCED_P, INDUCED_BETWEEN_P = 0.01, 1e-6, 5e-5


@dataclass
class Found:
    """Haplotypes of a sample, most frequent first: haplotype, snps, source, frequency and cliques.

    assigned: read_id and clique_id of the reads behind them, several rows for a read that ties.
    """

    rows: list[dict] = field(default_factory=list)
    error: str = ""
    code: int = 0
    assigned: DataFrame | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        made = [(i, r["haplotype"], r["frequency"], r["snps"], r["source"], r.get("cliques", [])) for i, r in enumerate(self.rows)]
        return spark.createDataFrame(made, "rank int, haplotype string, frequency double, snps array<string>, source array<string>, cliques array<long>")


def default_haplotype(sample: Sample, error: str = "", code: int = 0) -> Found:
    """The consensus with frequency 1."""
    text = pileup.consensus_string(sample.majors).first()["consensus"]
    return Found([{"haplotype": text, "frequency": 1.0, "snps": [], "source": []}], error, code)


def non_edges(sample: Sample, nodes: DataFrame, rate: float, fragment: int | None = None) -> DataFrame:
    """Pairs of minors (nodes: u) seen together less than a true link of that rate would be, with their tables.

    Pairs at about the fragment length, covered by few reads, or closer than the sample's limit do not count.  Pairs of
    positions that enough reads' shapes cover come first, and minors join them by position.
    """
    one = small(nodes.select(graph.vertex_pos(F.col("u")).alias("pos"), graph.vertex_allele(F.col("u")).alias("allele")))
    places = linkage.far_pairs(linkage.position_pairs(one), sample.close)
    if fragment is not None:
        places = places.where(F.abs(F.col("p2") - F.col("p1") - fragment) > 9)
    places = linkage.common_by_shape(places, sample.shape_sizes).where(F.col("covered") >= MANY_READS)
    pairs = places.join(one.toDF("p1", "a1"), "p1").join(one.toDF("p2", "a2"), "p2").select(*linkage.KEYS, "covered")
    rows = sample.table(linkage.hits(pairs, sample.cells)).where(F.col("reads") >= MANY_READS)
    _, hits = linkage_tests.swapped(F.col("o11"), F.col("o22"))
    return rows.where(linkage_tests.non_edge_p(F.col("o11"), F.col("o22"), F.col("reads"), rate) < NON_EDGE_P).withColumn("o22", hits)


def no_edge_pairs(sample: Sample, cliques: DataFrame, edges: DataFrame, rate: float, fragment: int | None = None) -> DataFrame:
    """c1 < c2 that cannot be one haplotype: two alleles of a position, or two minors of which few reads have both."""
    members = stored(graph.members(cliques))
    nodes = members.select(F.col("v").alias("u")).distinct()
    bad = stored(non_edges(sample, nodes, rate, fragment)).select(graph.vertex(F.col("p1"), F.col("a1")).alias("x"), graph.vertex(F.col("p2"), F.col("a2")).alias("y"))
    ways = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    bad = bad.join(ways, ["x", "y"], "left_anti")
    bad = bad.union(bad.select("y", "x"))
    left, right = members.select(F.col("clique_id").alias("c1"), F.col("v").alias("x")), members.select(F.col("clique_id").alias("c2"), F.col("v").alias("y"))
    unlinked = bad.join(left, "x").join(right, "y").where("c1 < c2").select("c1", "c2")
    return graph.conflicts(cliques).union(unlinked).distinct()


def unmerged(edges: DataFrame) -> DataFrame:
    """The maximal cliques of an edge table, numbered and stored."""
    figures = F.count(F.lit(1)).alias("cliques"), F.sum(F.size("vs")).alias("vertices"), F.max(F.size("vs")).alias("largest")
    return stored(note(graph.numbered(graph.maximal_cliques(edges)), "cliques", *figures))


def refused(sample: Sample, cliques: DataFrame, edges: DataFrame, rate: float, fragment: int | None = None) -> DataFrame:
    """The pairs of cliques that cannot be one haplotype, stored."""
    return stored(note(no_edge_pairs(sample, cliques, edges, rate, fragment), "no_edges", F.count(F.lit(1)).alias("pairs")))


def merged(sample: Sample, edges: DataFrame, rate: float, mode: str = "accurate", by_component: bool = True, fragment: int | None = None) -> DataFrame:
    """Merged cliques (clique_id, vs) of an edge table (u, v); mode is accurate, transitive or fast."""
    if mode == "transitive":
        edges = stored(transitive(sample, edges))
    cliques = unmerged(edges)
    if mode == "transitive" or cliques.limit(1).count() == 0:
        return cliques
    apart = refused(sample, cliques, edges, rate, fragment)
    if mode == "accurate":
        return graph.numbered(graph.merge_accurate(cliques, edges, apart, by_component))
    return graph.numbered(graph.merge_fast_by_component(cliques, edges, apart))


def transitive(sample: Sample, edges: DataFrame) -> DataFrame:
    """All pairs of a component but those that chance explains, and those that only they induce.

    An unlinked pair (f, s) is far enough apart and explained by chance.  A pair that is no edge itself goes too where
    it joins f to a neighbour of s or the other way about, or a neighbour of f to one of s, unless it is surer.
    """
    pairs = graph.transitive_edges(edges)
    at = lambda c: (graph.vertex_pos(F.col(c)), graph.vertex_allele(F.col(c)))
    (p1, a1), (p2, a2) = at("u"), at("v")
    asked = pairs.select(p1.alias("p1"), a1.alias("a1"), p2.alias("p2"), a2.alias("a2")).where("p1 < p2")
    found = linkage.hits(asked, sample.cells)
    p = linkage_tests.edge_p(*(F.col(c) for c in ("o11", "o12", "o21", "o22", "reads")), sample.error)
    # A pair that few reads cover, or none, may be one haplotype's.
    table = sample.table(found).select(*linkage.KEYS, F.when(F.col("reads") < MANY_READS, 0.0).otherwise(p).alias("p"))
    rows = asked.join(table, linkage.KEYS, "left").fillna(0.0, ["p"])
    rows = stored(rows.select(graph.vertex(F.col("p1"), F.col("a1")).alias("u"), graph.vertex(F.col("p2"), F.col("a2")).alias("v"), "p", (F.col("p2") - F.col("p1") > sample.close).alias("far")))
    gone = rows.where(F.col("far") & (F.col("p") > UNLINKED_P)).select("u", "v")
    both = gone.union(gone.select("v", "u")).toDF("f", "s")
    ways = edges.select("u", "v").union(edges.select("v", "u")).toDF("x", "n")
    beside = both.join(ways, F.col("s") == F.col("x")).select("f", "n")
    between = both.join(ways.toDF("x", "a"), F.col("f") == F.col("x")).select("s", "a").join(ways, F.col("s") == F.col("x")).select("a", "n")
    own = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    kept = rows.join(gone, ["u", "v"], "left_anti")
    for induced, limit in ((beside, INDUCED_P), (between, INDUCED_BETWEEN_P)):
        first, second = induced.columns
        doubtful = induced.select(F.least(first, second).alias("u"), F.greatest(first, second).alias("v")).distinct().join(own, ["u", "v"], "left_anti")
        doubtful = doubtful.join(rows.where(F.col("p") > limit), ["u", "v"], "left_semi")
        kept = kept.join(doubtful, ["u", "v"], "left_anti")
    return kept.select("u", "v")


def support(pile: DataFrame, assigned: DataFrame, letters: DataFrame) -> DataFrame:
    """clique_id, pos, depth and count: a cluster's reads at each position, and those with its haplotype's letter."""
    own = stored(by_read(pile, assigned).groupBy("clique_id", "pos", "allele").agg(F.count(F.lit(1)).alias("n")))
    depth = own.groupBy("clique_id", "pos").agg(F.sum("n").alias("depth")).join(letters.select("clique_id", "pos", "allele"), ["clique_id", "pos"])
    return depth.join(own.withColumnRenamed("n", "count"), ["clique_id", "pos", "allele"], "left").select("clique_id", "pos", "depth", "count")


def process_cliques(sample: Sample, cliques: DataFrame, rate: float, long_reads: bool, with_consensus: bool = True, least_reads: int = CLUSTER_READS, start: int = 0, end: int = 1_000_000) -> Found:
    """Haplotypes of the clusters around cliques and their frequencies, most frequent first."""
    spark = sample.pile.sparkSession
    members = graph.members(cliques).select("clique_id", "pos", "allele")
    if with_consensus:
        members = members.union(spark.createDataFrame([(-1, None, None)], "clique_id long, pos int, allele string"))
    members = stored(members)
    if members.limit(1).count() == 0:
        return Found()
    strings = assign.clique_strings(members, sample.majors)
    assigned = stored(assign.assign_reads(sample.pile, strings))
    if members.where("pos is not null").limit(1).count() == 0:  # the consensus alone has all reads
        assigned = sample.pile.select("read_id").distinct().select("read_id", F.lit(-1).cast("long").alias("clique_id"), F.lit(1).cast("long").alias("k"))
    best = stored(assign.top_clusters(assign.cluster_sizes(assigned), TOP_CLUSTERS, least_reads).select("clique_id"))
    assigned = assigned.join(F.broadcast(best), "clique_id")
    letters = stored(haplotypes.cluster_haplotypes(sample.pile, assigned, sample.majors, start, end))
    if not long_reads:
        depth = support(sample.pile, assigned, letters)
        empty = stored(assign.source_clique(letters.withColumnRenamed("clique_id", "hap_id"), members).join(members.groupBy("clique_id").agg(F.count("pos").alias("size")), "clique_id").where("size = 0"))
        letters = stored(haplotypes.mask_low_support(letters, depth, empty.select(F.col("hap_id").alias("clique_id"))))
    found = stored(haplotypes.merge_equal(haplotypes.strings(letters)))
    table = letters.join(F.broadcast(found.select("hap_id")), F.col("clique_id") == F.col("hap_id"), "left_semi").select(F.col("clique_id").alias("hap_id"), "pos", "allele")
    table = stored(table)
    rows = {r["hap_id"]: r for r in found.collect()}  # one a cluster, a hundred at most
    sources = {r["hap_id"]: r["clique_id"] for r in assign.source_clique(table, members).collect()}
    names = {r["clique_id"]: r["snps"] for r in members.where("pos is not null").groupBy("clique_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "allele"))), lambda x: F.concat_ws(":", x["pos"].cast("string"), x["allele"])).alias("snps")).collect()}
    liks = stored(haplotypes.read_likelihoods(sample.pile, table, rate, n_is_mismatch=not long_reads, length=sample.length if long_reads else None))
    freq = haplotypes.em_frequencies(liks)
    bare = [k for k, f in sorted(freq.items()) if (not rows[k]["snps"] or (not long_reads and sources.get(k) == -1)) and f < CONSENSUS_SHARE]
    if bare and len(freq) > 1:
        freq = haplotypes.em_frequencies(liks.where(F.col("hap_id") != bare[0]))
    made = [{"haplotype": rows[k]["haplotype"], "frequency": f, "snps": list(rows[k]["snps"]), "source": names.get(sources.get(k), []), "cliques": list(rows[k]["cliques"])} for k, f in freq.items()]
    made.sort(key=lambda r: (-r["frequency"], r["haplotype"]))
    return Found(made if long_reads else [r for r in made if r["frequency"] > SHORT_CUT], assigned=assigned)


def edge_graph(sample: Sample, least: int, share: float, long_reads: bool, top: int | None = None, **options: object) -> DataFrame:
    """u, v after pruning second minors; of short reads with the deletions of a region linked to each other.

    top: only so many edges, those of the highest share of joint reads, beside the ones of deletions.
    """
    rows = sample.edges(least, share, drop_deletions=long_reads, **options)
    if top is not None:
        rows = linkage.top_edges(rows, top)
    rows = rows.select(*linkage.KEYS)
    if not long_reads and not sample.ignore_deletion and sample.segments is not None:
        gone = F.lit("-")
        runs = deletions.deletion_edges(deletions.deletion_regions(sample.segments(), least))
        rows = rows.union(runs.select("p1", gone.alias("a1"), "p2", gone.alias("a2"))).distinct()
    pruned = linkage.prune_second_minors(stored(rows), sample.frequencies, deletions_only=not long_reads)
    return stored(pruned.select(graph.vertex(F.col("p1"), F.col("a1")).alias("u"), graph.vertex(F.col("p2"), F.col("a2")).alias("v")))


def rotated(sample: Sample, least: int, share: float) -> Sample:
    """The sample with minors as majors where they are about as frequent and have more neighbours in that role.

    Positions are bounded by the reference's length; only the candidates' degrees come to the driver.
    """
    found = stored(linkage.rotation_candidates(sample.profile).select("pos", F.col("allele").alias("other")))
    if found.limit(1).count() == 0:
        return sample
    swapped = stored(sample.majors.join(found, "pos", "left").select("pos", F.coalesce("other", "major").alias("major")))
    turned = sample.replaced(majors=swapped)

    def degrees(of: Sample) -> dict[int, int]:
        edges = of.edges(least, share)
        return {r["p"]: r["degree"] for r in linkage.degrees(edges).join(found, F.col("p") == F.col("pos"), "left_semi").groupBy("p").agg(F.sum("degree").alias("degree")).collect()}

    before, after = degrees(sample), degrees(turned)
    better = [p for p, n in after.items() if n > before.get(p, 0)]
    if not better:
        return sample
    kept = found.where(F.col("pos").isin(better))
    majors = stored(sample.majors.join(kept, "pos", "left").select("pos", F.coalesce("other", "major").alias("major")))
    return sample.replaced(majors=majors)


def _resolved(sample: Sample, cliques: DataFrame) -> DataFrame:
    return stored(graph.numbered(graph.resolve_conflicts(cliques, sample.frequencies).select("vs")))


def long_haplotypes(sample: Sample, least: int, share: float, mode: str = "accurate", quality_filter: bool = True, least_reads: int = CLUSTER_READS, non_edge_rate: float | None = None, by_component: bool = True, **region: int) -> Found:
    """Two passes: cliques of all reads, then of the nine tenths with fewest mistakes; all reads are then assigned.

    region: start and end, between which edges are looked for; outside haplotypes are the consensus.
    """
    rate = share if non_edge_rate is None else non_edge_rate
    cliques = stored(merged(sample, edge_graph(sample, least, share, True, **region), rate, mode, by_component))
    if quality_filter:
        places = graph.members(cliques).select("pos").distinct()
        good = stored(assign.low_quality_filter(sample.pile, sample.majors, places).select("read_id"))
        second = sample.only(good)
        cliques = stored(merged(second, edge_graph(second, least, share, True, **region), rate, mode, by_component))
    found = process_cliques(sample, cliques, LONG_RATE, True, least_reads=least_reads, **region)
    rows = [r for r in found.rows if r["frequency"] > share]
    return Found(rows, assigned=found.assigned) if rows else default_haplotype(sample, "all haplotypes are of low frequency", 5)


def windows(depth: dict[int, int], start: int, end: int, size: int) -> list[tuple[int, int]]:
    """Working windows from the most covered position on, one a step to the side with more reads a window away.

    Less than 20 positions to a border join the last window, which is then wider.
    """
    most = max(depth.get(p, 0) for p in range(start, end + 1))
    at = [p for p in range(start, end + 1) if depth.get(p, 0) == most]
    low = high = at[len(at) // 2]
    high = min(end, high + size)
    out = [(low, high)]
    while low > start or high < end:
        left = depth.get(low - size, 0) if low - size >= start else 0
        right = depth.get(high + size, 0) if high + size <= end else 0
        if low > start and (left > right or high >= end):
            before, low = low, max(start, low - size)
            low = start if low - start < 20 else low
            out.append((low, min(max(low + size, before), end)))
        else:
            before, high = high, min(end, high + size)
            high = end if end - high < 20 else high
            out.append((max(start, min(high - size, before)), high))
    return out


def window_edges(edges: DataFrame, known: DataFrame, low: int, high: int) -> DataFrame:
    """The edges (u, v) of a working window: both ends in it, both in one known haplotype (hap, v), or one in any of these and the other in the window."""
    inside = lambda c: graph.vertex_pos(F.col(c)).between(low, high)
    both = edges.join(known.select(F.col("v").alias("u"), "hap"), "u").join(known.select("v", F.col("hap").alias("other")), "v").where("hap = other").select("u", "v")
    first = edges.join(known.select(F.col("v").alias("u")).distinct(), "u", "left_semi").where(inside("v")).select("u", "v")
    second = edges.join(known.select("v").distinct(), "v", "left_semi").where(inside("u")).select("u", "v")
    return edges.where(inside("u") & inside("v")).select("u", "v").union(both).union(first).union(second).distinct()


def without_recombinations(rows: list[dict], low: int, high: int) -> list[dict]:
    """The first of the haplotypes whose sources have the same SNPs between low and high, both in."""
    first: dict[frozenset, dict] = {}
    for r in rows:
        first.setdefault(frozenset(s for s in r["source"] if low <= int(s.split(":")[0]) <= high), r)
    return list(first.values())


def short_haplotypes(sample: Sample, least: int, share: float, mode: str = "accurate", start: int = 0, end: int = 1_000_000, fragment: int | None = None, non_edge_rate: float | None = None, by_component: bool = True, recombinations: bool = True, truth: DataFrame | None = None) -> Found:
    """Windows of a fragment's length, each with the edges inside it and within haplotypes found before.

    recombinations: whether haplotypes that are equal outside the working window, in what was processed before, all stay.
    truth: position and letter of true haplotypes (truth, pos, allele), whose edges within a fragment are added.
    """
    end = min(end, sample.length - 1)
    rate = share if non_edge_rate is None else non_edge_rate
    sample = rotated(sample, least, share)
    edges = edge_graph(sample, least, share, False, start=start, end=end)
    sizes = sample.shapes.select((F.when(F.col("r_off") >= 0, F.least(F.col("r_end"), F.lit(sample.length - 2))).otherwise(F.col("l_end")) - F.col("l_off") + 1).alias("size"))
    if fragment is None:
        counts = sorted((r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a length
        total, upto = sum(n for _, n in counts), 0
        for fragment, n in counts:
            upto += n
            if upto > 0.9 * total:
                break
        if fragment > 0.8 * (end - start):
            fragment = sample.length
    if truth is not None:
        known = true_cliques(truth.where(F.col("pos").between(start, end)), sample.majors)
        edges = stored(edges.union(missed_edges(known, edges, fragment)))
    depth = {r["pos"]: r["depth"] for r in sample.counts.groupBy("pos").agg(F.sum("n").alias("depth")).collect()}  # one row a position
    rows: list[dict] = []
    done, last = None, Found()
    for low, high in windows(depth, start, end, fragment):
        done = (low, high) if done is None else (min(low, done[0]), max(high, done[1]))
        known = edges.sparkSession.createDataFrame([(i, v) for i, r in enumerate(rows) for v in _vertices(r["snps"])], "hap int, v string")
        part = stored(window_edges(edges, known, low, high))
        cliques = _resolved(sample, merged(sample, part, rate, mode, by_component, fragment))
        last = process_cliques(sample, cliques, SHORT_RATE, False, start=start, end=end)
        near = dict(haplotypes.merge_near([(r["haplotype"], r["frequency"]) for r in last.rows]))
        rows = [r | {"frequency": near[r["haplotype"]]} for r in last.rows if near.get(r["haplotype"], 0.0) > share / 2]
        outside = (high, done[1]) if low == done[0] else (done[0], low)
        if not recombinations and outside[0] != outside[1]:
            rows = without_recombinations(rows, *outside)
        closed = [(a, b) for r in rows for a in _vertices(r["source"]) for b in _vertices(r["source"]) if a < b]
        if closed:
            edges = stored(edges.union(edges.sparkSession.createDataFrame(closed, "u string, v string")).distinct())
    return Found([r for r in rows if r["frequency"] > share], assigned=last.assigned)


def whole_haplotypes(sample: Sample, least: int, share: float, mode: str = "accurate", non_edge_rate: float | None = None, by_component: bool = True, **region: int) -> Found:
    """Haplotypes of short reads from the cliques of the whole reference at once, without windows.

    For references not much longer than a fragment; distant SNPs are joined only through those between them.
    """
    rate = share if non_edge_rate is None else non_edge_rate
    sample = rotated(sample, least, share)
    cliques = _resolved(sample, merged(sample, edge_graph(sample, least, share, False, **region), rate, mode, by_component))
    found = process_cliques(sample, cliques, SHORT_RATE, False, **region)
    near = dict(haplotypes.merge_near([(r["haplotype"], r["frequency"]) for r in found.rows]))
    rows = [r | {"frequency": near[r["haplotype"]]} for r in found.rows if near.get(r["haplotype"], 0.0) > share / 2]
    return Found(rows, assigned=found.assigned) if rows else default_haplotype(sample, "all haplotypes are of low frequency", 5)


def _vertices(snps: list[str]) -> list[str]:
    return [f"{int(p):010d}{a}" for p, a in (s.split(":") for s in snps)]


def _called(sample: Sample, rows: list[dict]) -> DataFrame:
    snps = sorted({(int(p), a) for r in rows for p, a in (s.split(":") for s in r["snps"])})
    return sample.pile.sparkSession.createDataFrame(snps, "pos int, allele string")


def short_variants(sample: Sample, least: int, share: float, top: int = TOP_EDGES, **region: int) -> DataFrame:
    """pos, allele, freq, alleles and corrected of the SNPs of all haplotypes, from cliques that are not merged.

    region: start and end, between which edges are looked for and haplotypes may differ from the consensus.
    """
    sample = rotated(sample, least, share)
    cliques = stored(graph.numbered(graph.maximal_cliques(edge_graph(sample, least, share, False, top, **region))))
    return haplotypes.vc_frequencies(_called(sample, process_cliques(sample, cliques, SHORT_RATE, False, **region).rows), sample.counts)


def long_variants(sample: Sample, least: int, share: float, **settings: object) -> DataFrame:
    """The same from the haplotypes of long reads, always of those with fewest mistakes; settings are those of long_haplotypes."""
    rows = long_haplotypes(sample, least, share, quality_filter=True, **settings).rows
    return haplotypes.vc_frequencies(_called(sample, rows), sample.counts)


def containing_haplotype(cells: DataFrame, found: DataFrame, ranks: DataFrame) -> DataFrame:
    """read_id and hap_id: the first haplotype by rank that agrees with all known letters of a read."""
    met = cells.join(small(found.select("hap_id", "pos", F.col("allele").alias("letter"))), "pos")
    bad = met.groupBy("read_id", "hap_id").agg(F.count_if((F.col("allele") != "N") & (F.col("allele") != F.col("letter"))).alias("bad"))
    return bad.where("bad = 0").join(F.broadcast(ranks), "hap_id").groupBy("read_id").agg(F.min_by("hap_id", "rank").alias("hap_id"))


def impute(sample: Sample, least: int, share: float) -> DataFrame:
    """read_id and value: reads with their missing letters filled from the haplotype that contains them."""
    spark = sample.pile.sparkSession
    rows = long_haplotypes(sample, least, share, quality_filter=False, least_reads=0).rows
    table = spark.createDataFrame([(i, r["haplotype"]) for i, r in enumerate(rows)], "hap_id int, seq string")
    letters = table.select("hap_id", F.posexplode(F.split("seq", "")).alias("pos", "allele"))
    ranks = table.select("hap_id", F.col("hap_id").alias("rank"))
    filled = haplotypes.impute(sample.pile, containing_haplotype(sample.pile, letters, ranks), letters)
    return filled.groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "allele"))), lambda x: x["allele"]), "").alias("value"))


def nearest_results(truth: DataFrame, results: DataFrame) -> DataFrame:
    """truth, result, distance and found: the result nearest to each true haplotype, ties to the smaller id."""
    met = truth.join(results.select("result", "pos", F.col("allele").alias("letter")), "pos")
    sums = met.groupBy("truth", "result").agg(F.count_if(F.col("allele") != F.col("letter")).alias("distance"))
    best = sums.groupBy("truth").agg(F.min(F.struct("distance", "result")).alias("best"))
    return best.select("truth", "best.result", "best.distance", (F.col("best.distance") == 0).alias("found"))


def truth_mismatches(truth: DataFrame, cliques: DataFrame) -> DataFrame:
    """truth and missing: how many SNPs of a true clique the best found clique lacks, at least; both have clique_id and vs."""
    own = truth.select(F.col("clique_id").alias("truth"), F.explode("vs").alias("v"), F.size("vs").alias("size"))
    hits = own.join(cliques.select(F.col("clique_id").alias("found"), F.explode("vs").alias("v")), "v").groupBy("truth", "size", "found").agg(F.count(F.lit(1)).alias("hits"))
    best = hits.groupBy("truth").agg(F.max("hits").alias("hits"))
    sizes = truth.select(F.col("clique_id").alias("truth"), F.size("vs").alias("size"))
    return sizes.join(best, "truth", "left").select("truth", (F.col("size") - F.coalesce("hits", F.lit(0))).alias("missing"))


def true_cliques(truth: DataFrame, majors: DataFrame) -> DataFrame:
    """clique_id (the truth) and vs: where true haplotypes (truth, pos, allele) differ from the consensus; those that never do have no row."""
    rows = truth.join(small(majors), "pos").where("allele <> major")
    return rows.groupBy(F.col("truth").alias("clique_id")).agg(F.array_sort(F.collect_set(graph.vertex(F.col("pos"), F.col("allele")))).alias("vs"))


def clique_mismatches(cliques: DataFrame, truth: DataFrame) -> DataFrame:
    """clique_id, size, truth and mismatches: the true clique (clique_id, vs) that lacks fewest SNPs of each found one.

    Ties go to the smaller truth; a clique of which no true one has a SNP has a null truth and all its SNPs as mismatches.
    """
    own = cliques.select("clique_id", F.explode("vs").alias("v"))
    hits = own.join(truth.select(F.col("clique_id").alias("truth"), F.explode("vs").alias("v")), "v").groupBy("clique_id", "truth").agg(F.count(F.lit(1)).cast("int").alias("hits"))
    best = hits.groupBy("clique_id").agg(F.max_by(F.struct("truth", "hits"), F.struct("hits", -F.col("truth"))).alias("best"))
    sizes = cliques.select("clique_id", F.size("vs").alias("size"))
    return sizes.join(best, "clique_id", "left").select("clique_id", "size", "best.truth", (F.col("size") - F.coalesce("best.hits", F.lit(0))).alias("mismatches"))


def missed_edges(truth: DataFrame, edges: DataFrame, fragment: int) -> DataFrame:
    """u < v of true cliques within a fragment, not both deletions, that are no edges."""
    pairs = graph.closure_edges(truth)
    near = F.abs(graph.vertex_pos(F.col("u")) - graph.vertex_pos(F.col("v"))) <= fragment
    both = (graph.vertex_allele(F.col("u")) == "-") & (graph.vertex_allele(F.col("v")) == "-")
    return pairs.where(near & ~both).join(edges.select("u", "v"), ["u", "v"], "left_anti")
