"""Maximal cliques vertex by vertex, against plain ones."""

import random

from pyspark.sql import functions as F

from strandweave.operators import graph


def plain(edges):
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    return sorted(sorted(c) for c in graph.bron_kerbosch(near) if len(c) > 1)


def found(frame):
    return sorted(r["vs"] for r in frame.collect())


def test_random_graphs(spark):
    rng = random.Random(5)
    for n, share in ((8, 0.5), (14, 0.7), (30, 0.2)):
        edges = [(u, v) for u in range(n) for v in range(n) if u < v and rng.random() < share]
        edges += [(v, u) for u, v in edges[:5]] + [(0, 0)] + edges[:2]
        frame = spark.createDataFrame(edges, "u long, v long")
        assert found(graph.maximal_cliques(frame)) == plain(edges)
        # By layers instead of degrees.
        assert found(graph.maximal_cliques(frame, most=1)) == plain(edges)


def test_no_edges(spark):
    none = spark.createDataFrame([], "u string, v string")
    assert graph.maximal_cliques(none).count() == 0
    assert graph.maximal_cliques(none, most=-1).count() == 0


def test_one_component_of_many_vertices(spark):
    """A ring of 2,000 vertices, each linked to the next four, with a hub: cliques of six, made in several tasks."""
    n, reach = 2000, 4
    ring = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k")).select("u", ((F.col("u") + F.col("k")) % n).alias("v"))
    edges = ring.union(spark.range(n).select(F.lit(-1).cast("long"), "id"))
    assert graph.components(edges).select("component").distinct().count() == 1
    cliques = graph.maximal_cliques(edges)
    rows = cliques.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["vs"] for r in rows) == sorted(sorted([-1, *((u + k) % n for k in range(reach + 1))]) for u in range(n))
    assert len({r["task"] for r in rows}) > 1


def test_order_leaves_few_neighbours(spark):
    """A star of 3,000 leaves and a ring among them: the hub comes last, whichever way vertices are ordered."""
    n = 3000
    edges = spark.range(n).select(F.lit(-1).cast("long").alias("u"), F.col("id").alias("v")).union(spark.range(n).select("id", ((F.col("id") + 1) % n)))
    for most in (512, 1):
        after = graph.ordered_edges(edges, most=most).groupBy("u").count().agg(F.max("count")).first()[0]
        assert after <= 3
