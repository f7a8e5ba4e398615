"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from strandweave.plans import catalogue, pipelines
from strandweave.plans.samples import long_sample, short_sample
from strandweave.sources import fixture

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"haplotypes_long", "haplotypes_short", "variants_short", "variants_long", "merged_cliques"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def _sorted(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    frame = catalogue.queries()[name](spark, sf_dir)
    columns = ", ".join(f'"{c}"' for c in frame.columns)
    expected = duck.execute(f"SELECT {columns} FROM ({catalogue.oracle_sql()[name]}) q").fetchall()
    found = [tuple(r) for r in frame.collect()]
    assert found
    assert _sorted(found) == _sorted(expected)


def test_deletions_decide_edges(spark, sf_dir):
    """The deletions of a region are linked to each other whether or not reads link them, unless deletions are ignored."""
    s = short_sample(spark, sf_dir)
    gone = {(r["u"], r["v"]) for r in catalogue.edge_graph_short(spark, sf_dir).where("u LIKE '%-' AND v LIKE '%-'").collect()}
    assert gone
    s.ignore_deletion = True
    assert pipelines.edge_graph(s, 10, 0.02, False).where("u LIKE '%-' OR v LIKE '%-'").count() == 0


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_planted_frequencies_come_back(spark, sf_dir):
    rows = {r["hap_id"]: r["frequency"] for r in catalogue.em_frequencies(spark, sf_dir).collect()}
    assert abs(sum(rows.values()) - 1) < 1e-6
    assert all(abs(rows[h] - share) < 0.03 for h, share in ((0, 0.5), (1, 0.25), (2, 0.15), (3, 0.1)))


def test_merged_cliques_are_the_planted_haplotypes(spark, sf_dir):
    found = {tuple(r["vs"].split(",")) for r in catalogue.merged_cliques(spark, sf_dir).collect()}
    places = sorted(tuple(int(v[:10]) for v in vs) for vs in found)
    assert places == [(12, 37, 55, 80, 108), (20, 37, 62, 90), (30, 48, 49, 50, 51, 75, 100)]


def test_long_reads_bring_back_all_planted_haplotypes(spark, sf_dir):
    """Without the low-quality filter, which takes the deletions of the rarest haplotype for mistakes."""
    rows = pipelines.long_haplotypes(long_sample(spark, sf_dir), 10, 0.02, quality_filter=False).rows
    assert [[int(s.split(":")[0]) for s in r["snps"]] for r in rows] == [[], [12, 37, 55, 80, 108], [20, 37, 62, 90], [30, 48, 49, 50, 51, 75, 100]]
    assert all(abs(r["frequency"] - share) < 0.04 for r, share in zip(rows, (0.5, 0.25, 0.15, 0.1), strict=True))


def test_windowed_haplotypes_find_the_planted_ones(spark, sf_dir):
    rows = catalogue.haplotypes_short(spark, sf_dir).collect()
    assert {len(r["haplotype"]) for r in rows} == {120}
    assert any({"12:G", "37:T", "55:C", "80:A", "108:A"} <= set(r["snps"]) for r in rows)


def test_true_edges_are_added_and_recombinations_go(spark, sf_dir):
    """With the planted haplotypes as the answer, all of their SNPs come back together."""
    truth = fixture.truth(spark).withColumnRenamed("haplotype", "truth")
    s = short_sample(spark, sf_dir)
    known = pipelines.true_cliques(truth, s.majors)
    edges = pipelines.edge_graph(s, 10, 0.02, False)
    assert pipelines.missed_edges(known, edges, 120).count() > 0
    found = pipelines.short_haplotypes(s, 10, 0.02, fragment=120, recombinations=False, truth=truth)
    assert {len(r["haplotype"]) for r in found.rows} == {120}
    assert any({"12:G", "37:T", "55:C", "80:A", "108:A"} <= set(r["snps"]) for r in found.rows)
    ids = {c for r in found.rows for c in r["cliques"]}
    assert ids <= {r["clique_id"] for r in found.assigned.select("clique_id").distinct().collect()}
