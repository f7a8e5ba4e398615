"""Graphs of minors: components, maximal cliques, and merging of cliques.

Vertices are strings `pos:allele` zero-padded to sort by position, or any orderable ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.metrics import note
from strandweave.storage import stored

#: What a row says of p, a neighbour of a vertex after it in the order: that it is one, or is linked to q, another of these or an earlier one.
LATER, LINK, BEFORE = 0, 1, 2

#: What an error says when a vertex has too many cliques to list.
TOO_DENSE = "too many maximal cliques around one vertex"


def vertex(pos: Column, allele: Column) -> Column:
    return F.format_string("%010d%s", pos, allele)


def vertex_pos(v: Column) -> Column:
    return F.substring(v, 1, 10).cast("int")


def vertex_allele(v: Column) -> Column:
    return F.substring(v, 11, 1)


def components(edges: DataFrame, a: str = "u", b: str = "v", rounds: int = 64) -> DataFrame:
    """node and component, the smallest node reachable; rounds double the reach, each stored."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = pairs.union(pairs.select("v", "u")).distinct()
    labels = stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")))
    pairs = stored(pairs)
    for _ in range(rounds):
        near = pairs.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("c"))
        jumped = near.join(labels.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c").select("u", F.least("c", "cc").alias("d"))
        new = stored(labels.join(jumped, "u").select("u", F.least("c", "d").alias("c"), (F.col("d") < F.col("c")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.drop("moved")
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def bron_kerbosch(neighbours: dict, closed: frozenset = frozenset(), limit: int = 1_000_000) -> Iterator[frozenset]:
    """Maximal cliques outside closed that no vertex of it extends; a graph without vertices has the empty one.

    Sets of vertices are the bits of whole numbers; pivots have most neighbours.
    """
    names = sorted(neighbours)
    at = {v: k for k, v in enumerate(names)}
    near = [sum(1 << at[w] for w in neighbours[v]) for v in names]
    shut = sum(1 << at[v] for v in closed)
    found, stack = 0, [(0, (1 << len(names)) - 1 & ~shut, shut)]
    while stack:
        clique, open_, gone = stack.pop()
        if not open_:
            if not gone:
                found += 1
                if found > limit:
                    raise RuntimeError(f"{TOO_DENSE}: more than {limit}")
                yield frozenset(names[k] for k in _bits(clique))
            continue
        pivot = max(_bits(open_ | gone), key=lambda v: (near[v] & open_).bit_count())
        for v in _bits(open_ & ~near[pivot]):
            stack.append((clique | 1 << v, open_ & near[v], gone & near[v]))
            open_ &= ~(1 << v)
            gone |= 1 << v


def _bits(x: int) -> list[int]:
    out = []
    while x:
        low = x & -x
        out.append(low.bit_length() - 1)
        x ^= low
    return out


def _vertex_cliques(own: object, later: list, links: list[tuple], before: list[tuple]) -> list[list]:
    """Maximal cliques of two vertices or more whose first vertex is own.

    later: its neighbours further on in the order; links: edges among them; before: (p, x), where x is an earlier
    neighbour of own that p of later is linked to.
    """
    closed = frozenset(x for _, x in before)
    near: dict = {v: set() for v in (*later, *closed)}
    for u, v in (*links, *before):
        near[u].add(v)
        near[v].add(u)
    return sorted(sorted([own, *clique]) for clique in bron_kerbosch(near, closed))


def ordered_edges(edges: DataFrame, a: str = "u", b: str = "v", most: int = 512) -> DataFrame:
    """u and v of each distinct edge, u first in an order that leaves each vertex few neighbours after it.

    The order goes by degree, which leaves at most sqrt(2 * edges). Where more than `most` are left, it goes by layers:
    each takes off the vertices of at most three times the remaining vertices' mean degree, halving them, so that at
    most six times the degeneracy of the graph are left. Layers are logarithmic in the number of vertices.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = stored(pairs.union(pairs.select("v", "u")).distinct())

    def directed(order: DataFrame) -> DataFrame:
        ranks = order.select("u", F.struct(*[c for c in order.columns if c != "u"], "u").alias("rank"))
        both = pairs.join(ranks, "u").join(ranks.toDF("v", "other"), "v")
        return stored(both.where("rank < other").select("u", "v"))

    degrees = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    out = directed(stored(note(degrees, "graph", F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("ends"), F.max("degree").alias("most_neighbours"))))
    after = out.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if not after or after <= most:
        return out
    left, layers, layer = pairs, [], 0
    while True:
        degrees = stored(left.groupBy("u").agg(F.count(F.lit(1)).alias("degree")))
        mean = degrees.agg(F.avg("degree")).first()[0]
        if mean is None:
            break
        off = degrees.where(F.col("degree") <= 3 * mean).select("u", F.lit(layer).alias("layer"))
        layers.append(off)
        rest = degrees.where(F.col("degree") > 3 * mean).select("u")
        # Vertices whose neighbours are all gone come last.
        kept = stored(left.join(rest, "u", "left_semi").join(rest.toDF("v"), "v", "left_semi").select("u", "v"))
        layers.append(rest.join(kept, "u", "left_anti").select("u", F.lit(layer + 1).alias("layer")))
        left, layer = kept, layer + 1
    order = layers[0]
    for one in layers[1:]:
        order = order.union(one)
    return directed(order.groupBy("u").agg(F.max("layer").alias("layer")))


def maximal_cliques(edges: DataFrame, a: str = "u", b: str = "v", most: int = 512) -> DataFrame:
    """vs, the sorted vertices of each maximal clique of two vertices or more.

    Each vertex is a group with its neighbours after it in an order of few such, and finds the cliques that it is first
    in; so one large component is the work of many tasks. A group holds the triangles of its vertex.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(edges.dtypes)[a]
    on = ordered_edges(edges, a, b, most)
    # Triangles u, v, w in the order; all have two edges from u.
    triangles = on.join(on.select("u", F.col("v").alias("w")), "u").join(on.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    row = lambda own, p, q, what: F.struct(F.col(own).alias("own"), F.col(p).alias("p"), F.col(q).alias("q"), F.lit(what).alias("what"))
    rows = on.select(F.inline(F.array(row("u", "v", "v", LATER))))
    each = triangles.select(F.inline(F.array(row("u", "v", "w", LINK), row("v", "w", "u", BEFORE))))

    def cliques(frame: pd.DataFrame) -> pd.DataFrame:
        of = lambda what, c: frame.loc[frame["what"] == what, c].tolist()
        pairs = lambda what: list(zip(of(what, "p"), of(what, "q"), strict=True))
        return pd.DataFrame({"vs": pd.Series(_vertex_cliques(frame["own"].tolist()[0], of(LATER, "p"), pairs(LINK), pairs(BEFORE)), dtype=object)})

    # A stated number of partitions: groups are small in bytes, and few of them may be much work.
    return rows.union(each).repartition(parts, "own").groupBy("own").applyInPandas(cliques, f"vs array<{kind}>")


def numbered(cliques: DataFrame) -> DataFrame:
    """clique_id in the order of the sorted vertices; cliques are few beside the reads."""
    return cliques.select("vs").distinct().withColumn("clique_id", F.row_number().over(Window.orderBy(F.array_join("vs", ","))) - 1)


def members(cliques: DataFrame) -> DataFrame:
    v = F.col("v")
    return cliques.select("clique_id", F.explode("vs").alias("v")).select("clique_id", "v", vertex_pos(v).alias("pos"), vertex_allele(v).alias("allele"))


def clique_slice(cliques: DataFrame, start: int, end: int) -> DataFrame:
    """clique_id and vs of the positions from start to end, both in; with an end of 0 none."""
    inside = F.filter("vs", lambda v: vertex_pos(v).between(start, end) & (F.lit(end) != 0))
    return cliques.select("clique_id", inside.alias("vs"))


def merge_scores(cliques: DataFrame, edges: DataFrame) -> DataFrame:
    """c1 < c2 and score: shared vertices and edges between them; pairs with two alleles of a position have none.

    Cliques meet through the vertices and edges that they have, so pairs without any are never made.
    """
    m = members(cliques)
    left = m.select(F.col("clique_id").alias("c1"), F.col("v").alias("x"), F.col("pos").alias("px"), F.col("allele").alias("ax"))
    right = m.select(F.col("clique_id").alias("c2"), F.col("v").alias("y"), F.col("pos").alias("py"), F.col("allele").alias("ay"))
    same = left.join(right, F.col("x") == F.col("y")).where("c1 < c2").select("c1", "c2")
    ways = edges.select("u", "v").union(edges.select("v", "u")).distinct()
    linked = left.join(ways, F.col("x") == F.col("u")).join(right, F.col("v") == F.col("y")).where("c1 < c2").select("c1", "c2")
    clash = left.join(right, (F.col("px") == F.col("py")) & (F.col("ax") != F.col("ay"))).where("c1 < c2").select("c1", "c2").distinct()
    return same.union(linked).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("score")).join(clash, ["c1", "c2"], "left_anti")


def conflicts(cliques: DataFrame) -> DataFrame:
    """c1 < c2 that have different alleles at one position."""
    m = members(cliques)
    other = m.select(F.col("clique_id").alias("c2"), F.col("pos").alias("q"), F.col("allele").alias("b"))
    met = m.select(F.col("clique_id").alias("c1"), "pos", "allele").join(other, (F.col("pos") == F.col("q")) & (F.col("allele") != F.col("b")))
    return met.where("c1 < c2").select("c1", "c2").distinct()


def proper_subsets(cliques: DataFrame) -> DataFrame:
    """clique_id of those whose vertices another, larger one has all of; equal ones stay."""
    m = members(cliques).select("clique_id", "v")
    sizes = cliques.select("clique_id", F.size("vs").alias("size"))
    shared = m.join(m.select(F.col("clique_id").alias("other"), "v"), "v").where("clique_id <> other").groupBy("clique_id", "other").agg(F.count(F.lit(1)).alias("shared"))
    inside = shared.join(sizes, "clique_id").join(sizes.select(F.col("clique_id").alias("other"), F.col("size").alias("other_size")), "other")
    return inside.where("shared = size AND size < other_size").select("clique_id").distinct()


def largest(cliques: DataFrame) -> DataFrame:
    return cliques.join(proper_subsets(cliques), "clique_id", "left_anti")


def merge_accurate(cliques: DataFrame, edges: DataFrame, no_edge: DataFrame | None = None, by_component: bool = True) -> DataFrame:
    """Merged cliques, as vs: unions of the maximal cliques of the graph of cliques.

    Cliques with a score are in one component; within a component all pairs are joined but those in no_edge (c1 < c2)
    and those with two alleles of a position. Each part is stored, as the next ones read it several times over: in one
    plan they are hundreds of operators, which the driver plans anew after each of their stages.
    """
    scores = stored(merge_scores(cliques, edges))
    ids = cliques.select("clique_id")
    if by_component:
        groups = components(scores, "c1", "c2")
        ids = ids.join(groups.withColumnRenamed("node", "clique_id"), "clique_id", "left").withColumn("component", F.coalesce("component", "clique_id"))
    else:
        ids = ids.withColumn("component", F.lit(0))
    ids = stored(ids)
    pairs = ids.select(F.col("clique_id").alias("c1"), "component").join(ids.select(F.col("clique_id").alias("c2"), "component"), "component").where("c1 < c2").select("c1", "c2")
    bad = conflicts(cliques)
    if no_edge is not None:
        bad = bad.union(no_edge.select("c1", "c2")).distinct()
    joined = stored(pairs.join(bad, ["c1", "c2"], "left_anti"))
    groups = maximal_cliques(joined, "c1", "c2").select("vs")
    alone = ids.select("clique_id").join(joined.select(F.col("c1").alias("clique_id")).union(joined.select("c2")).distinct(), "clique_id", "left_anti").select(F.array("clique_id").alias("vs"))
    grouped = groups.union(alone).withColumn("g", F.monotonically_increasing_id()).select("g", F.explode("vs").alias("clique_id"))
    merged = grouped.join(cliques, "clique_id").groupBy("g").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("vs")))).alias("vs"))
    return largest(stored(numbered(merged))).select("vs")


def merge_fast(cliques: list[tuple[str, ...]], score: dict[tuple[int, int], float], refused: set[tuple[int, int]]) -> list[tuple[str, ...]]:
    """Each clique takes in, again and again, the one with the best score for its size.

    The cliques are those of one component, in order.
    """
    left, out = list(range(len(cliques))), []
    key = lambda a, b: (min(a, b), max(a, b))
    while left:
        own = [left.pop(0)]
        while True:
            rated = [(sum(score.get(key(o, c), 0.0) for o in own) / len(cliques[c]), -c) for c in left if all(key(o, c) not in refused for o in own)]
            best = max(rated, default=(0.0, 0))
            if best[0] <= 0:
                break
            left.remove(-best[1])
            own.append(-best[1])
        out.append(tuple(sorted({v for c in own for v in cliques[c]})))
    return sorted(set(out))


def merge_fast_by_component(cliques: DataFrame, edges: DataFrame, refused: DataFrame) -> DataFrame:
    """vs of the merged cliques; a clique only takes in what a score links to it, so each component is a task's group."""
    scores = stored(merge_scores(cliques, edges))
    groups = components(scores, "c1", "c2").withColumnRenamed("node", "clique_id")
    labels = cliques.select("clique_id").join(groups, "clique_id", "left").select("clique_id", F.coalesce("component", "clique_id").alias("component"))
    pairs = scores.join(refused.select("c1", "c2", F.lit(True).alias("refused")).distinct(), ["c1", "c2"], "full")
    inside = pairs.join(labels.toDF("c1", "component"), "c1").join(labels.toDF("c2", "other"), "c2").where("component = other")
    rows = cliques.join(labels, "clique_id").select("component", F.col("clique_id").cast("long").alias("c1"), F.lit(None).cast("long").alias("c2"), F.lit(0.0).alias("score"), F.lit(False).alias("refused"), "vs")
    rows = rows.unionByName(inside.select("component", F.col("c1").cast("long").alias("c1"), F.col("c2").cast("long").alias("c2"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("refused", F.lit(False)).alias("refused")), allowMissingColumns=True)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        alone = frame["c2"].isna()
        own = frame[alone].sort_values("c1")
        at = {c: i for i, c in enumerate(own["c1"])}
        linked = [(at[int(r.c1)], at[int(r.c2)], r.score, r.refused) for r in frame[~alone].itertuples()]
        made = merge_fast([tuple(vs) for vs in own["vs"]], {(a, b): x for a, b, x, _ in linked}, {(a, b) for a, b, _, no in linked if no})
        return pd.DataFrame({"vs": [list(vs) for vs in made]})

    return rows.groupBy("component").applyInPandas(merge, "vs array<string>")


def resolve_conflicts(cliques: DataFrame, freq: DataFrame) -> DataFrame:
    """clique_id and vs without alleles that a more frequent one of the same position and clique beats; ties stay."""
    m = members(cliques).join(freq.select("pos", "allele", "freq"), ["pos", "allele"])
    best = F.max("freq").over(Window.partitionBy("clique_id", "pos"))
    rated = note(m.withColumn("best", best), "conflicts", F.count_if(F.col("freq") < F.col("best")).alias("resolved"))
    return rated.where("freq = best").groupBy("clique_id").agg(F.array_sort(F.collect_list("v")).alias("vs"))


def closure_edges(cliques: DataFrame) -> DataFrame:
    """u < v of all pairs within a clique."""
    m = members(cliques).select("clique_id", "v")
    return m.withColumnRenamed("v", "u").join(m, "clique_id").where("u < v").select("u", "v").distinct()


def transitive_edges(edges: DataFrame) -> DataFrame:
    """u < v of all pairs within a component."""
    labels = components(edges)
    return labels.select(F.col("node").alias("u"), "component").join(labels.select(F.col("node").alias("v"), "component"), "component").where("u < v").select("u", "v")
