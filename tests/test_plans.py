"""What plans must not do, whatever Spark guesses of sizes: send cells to the driver, or grow with every step before them."""

import re

import pytest

from strandweave.operators import graph, haplotypes, linkage, pileup
from strandweave.plans import catalogue, pipelines
from strandweave.plans.samples import short_sample
from strandweave.sources import fixture, writers
from strandweave.storage import stored


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


@pytest.fixture
def assigned(spark, sf_dir):
    return stored(short_sample(spark, sf_dir).shapes.selectExpr("read_id", "read_id % 4 AS clique_id", "1L AS k"))


def _by_read(plan):
    """The kinds of the plan's joins by read."""
    return re.findall(r"(\w+Join) \[read_id", plan)


def test_weighted_profile_shuffles_cells(spark, sf_dir, assigned):
    assert _by_read(_physical(pileup.weighted_profile(short_sample(spark, sf_dir).pile, assigned, by=["clique_id"]))) == ["SortMergeJoin"]


def test_support_shuffles_cells(spark, sf_dir, assigned, monkeypatch):
    monkeypatch.setattr(pipelines, "stored", lambda df: df)
    letters = spark.createDataFrame([(0, 5, "A")], "clique_id long, pos int, allele string")
    kinds = _by_read(_physical(pipelines.support(short_sample(spark, sf_dir).pile, assigned, letters)))
    assert kinds and set(kinds) == {"SortMergeJoin"}


def test_part_of_a_sample_is_shuffled(spark, sf_dir, assigned):
    part = short_sample(spark, sf_dir).only(assigned.select("read_id").where("read_id % 2 = 0"))
    assert _by_read(_physical(part.pile)) == _by_read(_physical(part.shapes)) == ["SortMergeJoin"]


def test_reads_that_reach_a_position_are_shuffled(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(linkage, "stored", lambda df: seen.append(_physical(df)) or df)
    s = short_sample(spark, sf_dir)
    linkage._reaching(s.pile, s.shapes, spark.createDataFrame([(3, 9)], "p1 int, p2 int"))
    kinds = _by_read("".join(seen))
    assert kinds and set(kinds) == {"SortMergeJoin"}


def test_merged_cliques_are_a_short_plan(spark):
    """Its parts are stored: what follows does not plan them again (537 lines before)."""
    v = lambda *places: [f"{p:010d}A" for p in places]
    cliques = stored(spark.createDataFrame([(0, v(1, 2)), (1, v(2, 3)), (2, v(7, 8))], "clique_id long, vs array<string>"))
    edges = stored(spark.createDataFrame([(*v(1, 2),), (*v(2, 3),), (*v(7, 8),)], "u string, v string"))
    merged = graph.merge_accurate(cliques, edges)
    assert _lines(merged) < 30
    assert sorted(r["vs"] for r in merged.collect()) == [v(1, 2, 3), v(7, 8)]


def test_imputed_reads_are_not_shuffled(spark, sf_dir):
    plan = _physical(catalogue.imputed_reads(spark, sf_dir))
    assert "Exchange" not in re.sub(r"Exchange RoundRobin\w*", "", plan)


def _by_cells(spark, sf_dir):
    """The imputed reads as cells joined with haplotypes have them."""
    pile = fixture.long_pileup(spark, sf_dir)
    planted = fixture.truth(spark).withColumnRenamed("haplotype", "hap_id")
    ranks = spark.range(4).selectExpr("CAST(id AS INT) AS hap_id", "CAST(id AS INT) AS rank")
    return writers.imputed_lines(haplotypes.impute(pile, pipelines.containing_haplotype(pile, planted, ranks), planted))


def test_odd_orders_are_imputed_as_cells_are(spark, tmp_path):
    """Negative, large, missing and repeated keys, and missing customers."""
    rows = [(-7, 3), (-999, 16), (10**14, 19), (5, None), (None, 4), (None, 11), (8, 2), (8, 17), (9, -3), (0, 12), (1009, 0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    found, expected = (sorted(map(repr, map(tuple, f(spark, str(tmp_path)).collect()))) for f in (catalogue.imputed_reads, _by_cells))
    assert len(found) == 9
    assert found == expected


def test_reads_of_several_lengths_are_filled(spark):
    reads = spark.createDataFrame([(1, "ANNT"), (2, "NCN"), (3, "NNNNN"), (4, "GNNN"), (5, "")], "read_id long, seq string")
    found = dict(haplotypes.impute_strings(reads, ["ACGT", "TCA"]).collect())
    assert found == {1: "ACGT", 2: "ACG", 3: "ACGTN", 4: "GNNN", 5: ""}
