import json

import pytest
from pyspark.sql import functions as F

from strandweave import cli
from strandweave.operators import assign, deletions, graph, haplotypes, pileup
from strandweave.plans import pipelines
from strandweave.sources import intervals, text, writers
from strandweave.streaming.profile import start_profile

SAM = """@HD\tVN:1.0
@SQ\tSN:ref\tLN:12
r1\t0\tref\t1\t60\t2S4M\t*\t0\t0\tGGACGT\t*
r2\t1\tref\t1\t60\t4M\t=\t7\t0\tACGT\t*
r2\t1\tref\t7\t60\t2M1D2M\t=\t1\t0\tACGT\t*
r3\t4\tref\t1\t60\t4M\t*\t0\t0\tACGT\t*
"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fasta_with_blank_lines(spark, tmp_path):
    path = tmp_path / "a.fas"
    path.write_text(">one\nAC\nGT\n\n>two\nNN\n")
    rows = text.fasta(spark, str(path)).orderBy("read_id").collect()
    assert [(r["name"], r["seq"], r["sample"]) for r in rows] == [("one", "ACGT", "a"), ("two", "NN", "a")]


@pytest.mark.parametrize(
    ("seq", "cigar", "out"),
    [("ACGT", "4M", "ACGT"), ("ACGTT", "2M1I2M", "ACTT"), ("ACGT", "2M2D2M", "AC--GT"), ("GGAC", "2S2M", "--AC"), ("AC", "1H2M1P", "-AC"), ("A", "3M", "A??"), ("ACGT", "2M3N2M", "AC---GT"), ("AC", "1=1X", "AC")],
)
def test_cigar(spark, seq, cigar, out):
    assert one(spark, text.project_cigar(F.lit(seq), F.lit(cigar))) == out


def test_sam_reads(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(SAM)
    assert text.sam_header(spark, str(path)).first().asDict() == {"contig": "ref", "length": 12, "interval": "ref:0-12"}
    rows = {r["name"]: r for r in text.short_reads(spark, str(path)).collect()}
    assert set(rows) == {"r1", "r2"}
    assert (rows["r2"]["l"], rows["r2"]["l_off"], rows["r2"]["r"], rows["r2"]["r_off"]) == ("ACGT", 0, "AC-GT", 6)
    assert (rows["r1"]["l"], rows["r1"]["l_off"], rows["r1"]["r_off"]) == ("ACGT", 0, -1)
    long = [r["seq"] for r in text.long_reads(spark, str(path)).orderBy("read_id").collect()]
    assert long[:3] == ["ACGTNNNNNNNN", "ACGTNNNNNNNN", "NNNNNNAC-GTN"]


@pytest.mark.parametrize(
    ("written", "parsed"),
    [("chr1:10-20", ("chr1", 10, 20)), ("chr1:1,000-2k", ("chr1", 1000, 2000)), ("chr1:100+10", ("chr1", 90, 110)), ("chr1:10-20+50bp", ("chr1", 0, 70)), ("chr1:20-10", None), ("chr1", None), ("chr1:x-3", None), (None, None)],
)
def test_intervals(spark, written, parsed):
    found = one(spark, intervals.parse(F.lit(written).cast("string")))
    assert (tuple(found) if found else None) == parsed


def test_interval_with_contig(spark):
    found = one(spark, intervals.parse(F.lit("chr1:5-500"), F.lit(100)))
    assert tuple(found) == ("chr1", 5, 100)
    assert tuple(one(spark, intervals.parse(F.lit("chr1"), F.lit(100), contig_alone=True))) == ("chr1", 0, 100)


def test_deletion_runs(spark):
    reads = spark.createDataFrame([(0, "AC----GT"), (0, "ACGTA---"), (5, "A---CGTA"), (0, "")], "off int, seq string")
    assert {tuple(r) for r in deletions.deletion_regions(reads, 1).collect()} == {(2, 5, 1), (5, 8, 1)}
    assert {tuple(r) for r in deletions.deletion_edges(deletions.deletion_regions(reads, 1)).collect()} == {(2, 3), (2, 4), (3, 4), (5, 6), (5, 7), (6, 7)}


def test_components_and_cliques(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")], "u string, v string")
    assert {tuple(r) for r in graph.components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert {tuple(r["vs"]) for r in graph.maximal_cliques(edges).collect()} == {("a", "b", "c"), ("x", "y")}
    assert graph.components(edges.limit(0)).count() == 0


def test_fast_merge():
    cliques = [("1A", "2C"), ("2C", "3G"), ("9T", "8A")]
    assert graph.merge_fast(cliques, {(0, 1): 2.0}, set()) == [("1A", "2C", "3G"), ("8A", "9T")]
    assert graph.merge_fast(cliques, {(0, 1): 2.0}, {(0, 1)}) == sorted(cliques[:2] + [("8A", "9T")])


def test_fast_merge_by_component_is_the_merge_of_all(spark):
    v = lambda p: f"{p:010d}A"
    vs = [sorted(map(v, c)) for c in ((1, 2), (2, 3), (3, 4), (7, 8), (8, 9), (20, 21))]
    cliques = spark.createDataFrame(list(enumerate(vs)), "clique_id long, vs array<string>")
    edges = spark.createDataFrame([(a, b) for a, b in vs] + [(v(1), v(3))], "u string, v string")
    refused = spark.createDataFrame([(1, 2), (0, 5)], "c1 long, c2 long")
    scores = {(r["c1"], r["c2"]): float(r["score"]) for r in graph.merge_scores(cliques, edges).collect()}
    wanted = graph.merge_fast([tuple(c) for c in vs], scores, {(1, 2), (0, 5)})
    found = [tuple(r["vs"]) for r in graph.merge_fast_by_component(cliques, edges, refused).collect()]
    assert sorted(found) == wanted and len(wanted) < len(vs)
    none = spark.createDataFrame([], "clique_id long, vs array<string>")
    assert graph.merge_fast_by_component(none, edges, refused).count() == 0


def test_ties_in_assignment(spark):
    cells = spark.createDataFrame([(1, 0, "A"), (1, 1, "C"), (2, 0, "G"), (2, 1, "N")], "read_id long, pos int, allele string")
    majors = spark.createDataFrame([(0, "A"), (1, "C")], "pos int, major string")
    members = spark.createDataFrame([(-1, None, None), (0, 0, "G"), (1, 1, "T")], "clique_id long, pos int, allele string")
    rows = {(r["read_id"], r["clique_id"], r["k"]) for r in assign.assign_reads(cells, assign.clique_strings(members, majors)).collect()}
    assert rows == {(1, -1, 1), (2, 0, 1)}


def test_consensus_ties_and_gaps(spark):
    counts = spark.createDataFrame([(0, "C", 2), (0, "A", 2), (1, "N", 5), (2, "-", 9), (2, "T", 1)], "pos int, allele string, n long")
    assert {r["pos"]: r["major"] for r in pileup.consensus(counts).collect()} == {0: "A", 1: "N", 2: "-"}
    assert {r["pos"]: r["major"] for r in pileup.consensus(counts, deletions=False).collect()}[2] == "T"


def test_true_frequencies(spark):
    rows = spark.createDataFrame([(0, "A", 0.7, 2), (0, "C", 0.297, 2), (0, "G", 0.003, 2)], "pos int, allele string, freq double, alleles int")
    found = {r["allele"]: r["corrected"] for r in haplotypes.true_frequencies(rows).collect()}
    assert abs(found["C"] - (0.297 - 0.001) / 0.995) < 1e-12
    assert abs(found["G"] - 0.003) < 1e-12


def test_reports(spark):
    rows = spark.createDataFrame([(0, "ACGTAC", 0.75)], "rank int, haplotype string, frequency double")
    assert writers.fasta_lines(rows, "s", "extended3", 1, 4).first()["value"] == ">s_0_0.750\nCGT\n"
    assert json.loads(writers.result_json([], {"t": "1"}))["foundHaplotypes"] == 0
    snps = spark.createDataFrame([(4, "T", 0.25), (4, "C", 0.05), (5, "-", 0.5)], "pos int, allele string, corrected double")
    majors = spark.createDataFrame([(4, "A"), (5, "A")], "pos int, major string")
    assert [tuple(r) for r in writers.vcf_rows(snps, majors).collect()] == [("ref", 5, ".", "A", "C,T", ".", "PASS", "AF=0.0500,0.250")]


def test_options():
    p = cli.Params.parse(["-m", "snv-pacbio", "-t", "x", "-tf", "0.01", "-log", "-in", "f.sam"])
    assert (p.m, p.t, p.tf, p.log, p.in_) == ("snv-pacbio", 10, 0.01, True, "f.sam")
    p = cli.Params.parse(["-m", "snv-illumina", "-rn", "-filter", "-addFnedges", "-answer", "t.fasta"])
    assert (p.rn, p.filter, p.addFnedges, p.answer) == (True, True, True, "t.fasta")


def test_long_run_from_a_file(spark, tmp_path):
    base = "ACGTACGTACGTACGTACGTACGTACGTAC"
    other = base[:4] + "G" + base[5:15] + "C" + base[16:]
    path = tmp_path / "s.fas"
    path.write_text("".join(f">r{i}\n{base if i % 3 else other}\n" for i in range(60)))
    found = cli.haplotypes(spark, cli.Params(m="snv-pacbio", in_=str(path), outDir=str(tmp_path / "out"), t=5, tf=0.05, rn=True), True)
    assert found.error == ""
    assert [r["haplotype"] for r in found.rows] == [base, other]
    assert abs(found.rows[1]["frequency"] - 1 / 3) < 0.02
    names = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "s_read_names")).collect()]
    heads = [i for i, n in enumerate(names) if n.startswith(">")]
    assert [n.split("_fr_")[0] for n in names if n.startswith(">")] == [">0", ">1"]
    assert sorted(names[heads[0] + 1 : heads[1]]) == sorted(f"r{i}" for i in range(60) if i % 3)
    assert sorted(names[heads[1] + 1 :]) == sorted(f"r{i}" for i in range(60) if i % 3 == 0)


def test_recombinations_go():
    rows = [{"haplotype": h, "source": src} for h, src in (("a", ["1:A", "9:C"]), ("b", ["1:A", "8:C"]), ("c", ["2:A"]), ("d", []), ("e", ["9:T"]))]
    assert [r["haplotype"] for r in pipelines.without_recombinations(rows, 0, 5)] == ["a", "c", "d"]
    assert pipelines.without_recombinations([], 0, 5) == []


def test_true_cliques_and_mismatches(spark):
    majors = spark.createDataFrame([(p, "A") for p in range(4)], "pos int, major string")
    truth = spark.createDataFrame([(t, p, a) for t, seq in ((1, "AAAA"), (2, "CACA"), (3, "CGAA")) for p, a in enumerate(seq)], "truth long, pos int, allele string")
    known = pipelines.true_cliques(truth, majors)
    v = lambda p, a: f"{p:010d}{a}"
    assert {r["clique_id"]: r["vs"] for r in known.collect()} == {2: [v(0, "C"), v(2, "C")], 3: [v(0, "C"), v(1, "G")]}
    found = spark.createDataFrame([(0, [v(0, "C"), v(2, "C"), v(3, "T")]), (1, [v(0, "C"), v(3, "G")]), (2, [v(3, "T")])], "clique_id long, vs array<string>")
    assert sorted(tuple(r) for r in pipelines.clique_mismatches(found, known).collect()) == [(0, 3, 2, 1), (1, 2, 2, 1), (2, 1, None, 1)]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    reads = spark.createDataFrame([(0, "ACG"), (1, "CG"), (0, "")], "off int, seq string")
    reads.write.parquet(str(folder))
    query = start_profile(spark.readStream.schema(reads.schema).parquet(str(folder)), "profile_counts", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("profile_counts").collect()} == {(0, "A", 1), (1, "C", 2), (2, "G", 2)}


def test_rotation_turns_frequent_minors(spark):
    """Two haplotypes of nearly equal share: the minor of one place is frequent, and so a candidate."""
    from strandweave.plans import pipelines
    from strandweave.plans.samples import Sample

    rows = [(i, p, "C" if i % 2 and p in (2, 9, 15) else "A") for i in range(120) for p in range(20)]
    pile = spark.createDataFrame(rows, "read_id long, pos int, allele string")
    shapes = spark.createDataFrame([(i, 0, 19, -1, -2) for i in range(120)], "read_id long, l_off int, l_end int, r_off int, r_end int")
    sample = Sample(pile, shapes, 20, deletions=False, error=0.2)
    turned = pipelines.rotated(sample, 10, 0.05)
    assert {r["pos"]: r["major"] for r in turned.majors.collect()}[3] == "A"
    found = pipelines.short_haplotypes(sample, 10, 0.05)
    assert {r["haplotype"] for r in found.rows} == {"A" * 20, "".join("C" if p in (2, 9, 15) else "A" for p in range(20))}
