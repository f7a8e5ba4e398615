"""Joint counts of minors on reads, from the cells that are not major.

The dense pileup is never joined with itself, nor are the noise cells of a read paired with each other.  Minors on enough
reads come first; of these, pairs that could reach a threshold by their own counts and by how many reads cover both
positions (`likely_pairs`); joint counts are made of the cells of such pairs only.  With `sparse` (minors and N) at the
positions that are left, and the shapes of reads, every count of a 2x2 table follows by inclusion and exclusion:

    O22 = joint(i, j)          O21 = mcov(i; q) - sum_k joint(i, (q, k))          O12 alike
    O11 = reads - sum_a mcov(p, a; q) - sum_a mcov(q, a; p) + sum_kl joint((p, k), (q, l))

where mcov(p, a; q) counts reads with minor a at p that have a letter other than N at q.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.storage import by_read, small, stored

KEYS = ["p1", "a1", "p2", "a2"]


def joint_counts(cells: DataFrame) -> DataFrame:
    """p1, a1, p2, a2 and n: reads with both cells, p1 < p2. The join's key is the read, so no position is hot."""
    a = cells.select("read_id", F.col("pos").alias("p1"), F.col("allele").alias("a1"))
    b = cells.select(F.col("read_id").alias("_r"), F.col("pos").alias("p2"), F.col("allele").alias("a2"))
    return a.join(b, (F.col("read_id") == F.col("_r")) & (F.col("p1") < F.col("p2"))).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def _places(pairs: DataFrame) -> DataFrame:
    """pos of all positions of the pairs, to be broadcast: no more than the reference's length."""
    return F.broadcast(pairs.select(F.col("p1").alias("pos")).union(pairs.select("p2")).distinct())


def joint_at(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The joint counts (n) of the cells at distinct pairs of positions (p1, p2); cells elsewhere are not paired."""
    own = cells.join(_places(pairs), "pos", "left_semi")
    a = own.select("read_id", F.col("pos").alias("p1"), F.col("allele").alias("a1"))
    b = own.select(F.col("read_id").alias("_r"), F.col("pos").alias("p2"), F.col("allele").alias("a2"))
    met = a.join(b, (F.col("read_id") == F.col("_r")) & (F.col("p1") < F.col("p2")))
    return met.join(pairs, ["p1", "p2"], "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def hits(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The distinct pairs of minors (p1, a1, p2, a2, and other columns) with o22, their joint count, 0 where no read has both."""
    asked = small(pairs)
    minors = asked.select(F.col("p1").alias("pos"), F.col("a1").alias("allele")).union(asked.select("p2", "a2")).distinct()
    # A few letters a position.
    own = joint_counts(cells.join(F.broadcast(minors), ["pos", "allele"], "left_semi"))
    return asked.join(own.join(asked, KEYS, "left_semi"), KEYS, "left").withColumn("o22", F.coalesce("n", F.lit(0))).drop("n")


def frequent_minors(counts: DataFrame, majors: DataFrame, least: int) -> DataFrame:
    """pos, allele and n of the letters that are neither major nor N, on at least that many reads."""
    return counts.join(majors, "pos").where((F.col("allele") != F.col("major")) & (F.col("allele") != "N") & (F.col("n") >= least)).select("pos", "allele", "n")


def position_pairs(places: DataFrame) -> DataFrame:
    """p1 < p2 of all positions (pos); as many as the reference's length at most."""
    listed = F.broadcast(places.agg(F.array_sort(F.collect_set("pos")).alias("at")))
    after = F.filter("at", lambda x: x > F.col("pos"))
    return places.select("pos").distinct().join(listed, F.lit(True)).select(F.col("pos").alias("p1"), F.explode(after).alias("p2"))


def likely_pairs(minors: DataFrame, counts: DataFrame, shape_sizes: DataFrame, share: float) -> DataFrame:
    """Pairs of minors (pos, allele, n), with covered, whose joint count could exceed that share of the reads that have letters at both positions.

    The joint count is at most the smaller minor's; the reads are at least those whose shape covers both positions less
    the N of either. So reads decide nothing here but the size of the counts.
    """
    own = minors.join(counts.where("allele = 'N'").select("pos", F.col("n").alias("gone")), "pos", "left").fillna(0, ["gone"])
    own = stored(own)  # a few letters a position
    covered = common_by_shape(position_pairs(own.select("pos").distinct()), shape_sizes)
    first, second = (own.select(F.col("pos").alias(f"p{k}"), F.col("allele").alias(f"a{k}"), F.col("n").alias(f"n{k}"), F.col("gone").alias(f"gone{k}")) for k in (1, 2))
    least = F.col("covered") - F.col("gone1") - F.col("gone2")
    return covered.join(F.broadcast(first), "p1").join(F.broadcast(second), "p2").where(F.least("n1", "n2") > share * least).select(*KEYS, "covered")


def far_pairs(pairs: DataFrame, close: int = 0, start: int = 0, end: int = 1_000_000) -> DataFrame:
    """The pairs far enough apart and within the region."""
    return pairs.where((F.col("p2") - F.col("p1") > close) & F.col("p1").between(start, end) & F.col("p2").between(start, end))


def shape_counts(shapes: DataFrame) -> DataFrame:
    """Reads of each shape; few beside the reads."""
    return shapes.groupBy("l_off", "l_end", "r_off", "r_end").agg(F.count(F.lit(1)).alias("reads"))


def _bounds(reads: Column) -> Column:
    """q and delta: how the number of covering reads changes from position q on; mates that overlap are one range."""
    span = lambda first, last: (F.struct(first.alias("q"), reads.alias("delta")), F.struct((last + 1).alias("q"), (-reads).alias("delta")))
    left, right = span(F.col("l_off"), F.col("l_end")), span(F.col("r_off"), F.col("r_end"))
    apart = (F.col("r_off") > F.col("l_end")) | (F.col("r_end") < F.col("l_off"))
    one = span(F.least("l_off", "r_off"), F.greatest("l_end", "r_end"))
    return F.when(F.col("r_off") < 0, F.array(*left)).when(apart, F.array(*left, *right)).otherwise(F.array(*one))


def _covering(rows: DataFrame, keys: list[str], asked: DataFrame) -> DataFrame:
    """keys, q and x: of the rows (keys with pos, reads and their shape), how many reads cover q too; asked has pos and q.

    Shapes are summed as changes at their bounds and added up along q, so no row meets all positions that it covers.
    """
    changes = rows.select(*keys, F.inline(_bounds(F.col("reads")))).groupBy(*keys, "q").agg(F.sum("delta").alias("delta"))
    asks = changes.select(*keys).distinct().join(asked, "pos").select(*keys, "q", F.lit(0).cast("long").alias("delta"), F.lit(1).alias("ask"))
    both = changes.withColumn("ask", F.lit(0)).unionByName(asks).groupBy(*keys, "q").agg(F.sum("delta").alias("delta"), F.max("ask").alias("ask"))
    upto = F.sum("delta").over(Window.partitionBy(*keys).orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("x", upto).where("ask = 1 AND x > 0").select(*keys, "q", "x")


def _corners(reads: Column) -> Column:
    """p, q and delta: where the number of reads that cover p and q changes, as corners of rectangles in the plane.

    A span covers the pairs of the rectangle span x span; two mates apart also those of first x second.  The number of
    covering reads at (p, q), p < q, is the sum of all deltas at or below it in both directions.
    """
    value = lambda p, q, delta: F.struct(p.alias("p"), q.alias("q"), delta.alias("delta"))
    rectangle = lambda s, e, t, f: (value(s, t, reads), value(e + 1, t, -reads), value(s, f + 1, -reads), value(e + 1, f + 1, reads))
    l0, l1, r0, r1 = (F.col(c).cast("int") for c in ("l_off", "l_end", "r_off", "r_end"))
    apart = (r0 > l1) | (r1 < l0)
    a0, b0 = F.least(l0, r0), F.greatest(l0, r0)
    a1, b1 = F.when(l0 <= r0, l1).otherwise(r1), F.when(l0 <= r0, r1).otherwise(l1)
    two = (*rectangle(a0, a1, a0, a1), *rectangle(b0, b1, b0, b1), *rectangle(a0, a1, b0, b1))
    whole = F.greatest(l1, r1)
    left = F.when(l0 <= l1, F.array(*rectangle(l0, l1, l0, l1)))
    return F.when(r0 < 0, left).when(apart, F.array(*two)).otherwise(F.array(*rectangle(a0, whole, a0, whole)))


def common_by_shape(pairs: DataFrame, shape_sizes: DataFrame) -> DataFrame:
    """p1, p2 and covered: reads whose shape covers both positions, whatever the letter; pairs that none covers have no row.

    A summed-area table: shapes are corners in the plane of positions, summed up along the first position for the
    asked ones and then along the second. Work grows with shapes plus asked first positions times distinct ends, at most
    the square of the reference's length, and never with the lengths of reads.
    """
    corners = stored(shape_sizes.select(F.inline(_corners(F.col("reads")))).groupBy("p", "q").agg(F.sum("delta").alias("delta")).where("delta <> 0"))
    firsts = F.broadcast(pairs.agg(F.collect_set(F.col("p1").cast("int")).alias("at")))
    lines = corners.select("q").distinct().join(firsts, F.lit(True)).select(F.explode("at").alias("p"), "q", F.lit(0).cast("long").alias("delta"), F.lit(1).alias("ask"))
    along_p = _running(corners.withColumn("ask", F.lit(0)).unionByName(lines), "q", "p").where("delta <> 0").withColumn("ask", F.lit(0))
    asks = pairs.select(F.col("p1").cast("int").alias("p"), F.col("p2").cast("int").alias("q"), F.lit(0).cast("long").alias("delta"), F.lit(1).alias("ask"))
    return _running(along_p.unionByName(asks), "p", "q").where("delta > 0").select(F.col("p").alias("p1"), F.col("q").alias("p2"), F.col("delta").alias("covered"))


def _running(rows: DataFrame, by: str, along: str) -> DataFrame:
    """p, q and delta of the asked rows: the sum of all delta of the same `by` up to their `along`."""
    both = rows.groupBy("p", "q").agg(F.sum("delta").alias("delta"), F.max("ask").alias("ask"))
    upto = F.sum("delta").over(Window.partitionBy(by).orderBy(along).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("delta", upto).where("ask = 1").select("p", "q", "delta")


def _reaching(cells: DataFrame, shapes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """x(p, a; q): reads with a cell at one position of a pair whose shape covers the other one."""
    forth = pairs.select(F.col("p1").alias("pos"), F.col("p2").alias("q"))
    asked = forth.union(forth.select("q", "pos"))
    rows = by_read(cells.join(_places(pairs), "pos", "left_semi"), shapes).withColumn("reads", F.lit(1).cast("long"))
    found = stored(_covering(rows, ["pos", "allele"], asked))
    first = found.where("pos < q").select(F.col("pos").alias("p1"), F.col("q").alias("p2"), F.col("allele").alias("a1"), "x")
    second = found.where("pos > q").select(F.col("q").alias("p1"), F.col("pos").alias("p2"), F.col("allele").alias("a2"), "x")
    return first, second


def common_reads(pairs: DataFrame, cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """p1, p2 and reads: those with a letter other than N at both positions."""
    gone, pairs = cells.where("allele = 'N'"), small(pairs)
    first, second = _reaching(gone, shapes, pairs)
    both = joint_at(pairs, gone).select("p1", "p2", F.col("n").alias("nn"))
    out = common_by_shape(pairs, shape_counts(shapes))
    for part, name in ((first.select("p1", "p2", F.col("x").alias("n1")), "n1"), (second.select("p1", "p2", F.col("x").alias("n2")), "n2"), (both, "nn")):
        out = out.join(part, ["p1", "p2"], "left").fillna(0, [name])
    return out.select("p1", "p2", (F.col("covered") - F.col("n1") - F.col("n2") + F.col("nn")).alias("reads"))


def linkage_table(found: DataFrame, cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """found (p1, a1, p2, a2, o22, and covered where it is known) with o11, o12, o21 and reads."""
    pairs = small(found.select("p1", "p2").distinct())
    inside = stored(joint_at(pairs, cells))
    minor1, minor2 = F.col("a1") != "N", F.col("a2") != "N"
    n = F.col("n")
    rows = inside.groupBy("p1", "p2", "a1").agg(F.sum(F.when(minor2, n).otherwise(0)).alias("row"), F.sum(F.when(~minor2, n).otherwise(0)).alias("row_n"))
    columns = inside.groupBy("p1", "p2", "a2").agg(F.sum(F.when(minor1, n).otherwise(0)).alias("column"), F.sum(F.when(~minor1, n).otherwise(0)).alias("column_n"))
    first, second = _reaching(cells, shapes, pairs)
    mcov1 = first.join(rows, ["p1", "p2", "a1"], "left").fillna(0, ["row", "row_n"]).select("p1", "p2", "a1", "row", "x", (F.col("x") - F.col("row_n")).alias("mcov1"))
    mcov2 = second.join(columns, ["p1", "p2", "a2"], "left").fillna(0, ["column", "column_n"]).select("p1", "p2", "a2", "column", "x", (F.col("x") - F.col("column_n")).alias("mcov2"))
    sums1 = mcov1.groupBy("p1", "p2").agg(F.sum(F.when(minor1, F.col("mcov1")).otherwise(0)).alias("all1"), F.sum(F.when(minor1, F.col("row")).otherwise(0)).alias("joint_all"), F.sum(F.when(~minor1, F.col("x")).otherwise(0)).alias("gone1"))
    sums2 = mcov2.groupBy("p1", "p2").agg(F.sum(F.when(minor2, F.col("mcov2")).otherwise(0)).alias("all2"), F.sum(F.when(~minor2, F.col("x")).otherwise(0)).alias("gone2"))
    both = inside.where(~minor1 & ~minor2).select("p1", "p2", n.alias("nn"))
    covered = found.select("p1", "p2", "covered").distinct() if "covered" in found.columns else common_by_shape(pairs, shape_counts(shapes))
    base = covered.join(sums1, ["p1", "p2"]).join(sums2, ["p1", "p2"]).join(both, ["p1", "p2"], "left").fillna(0, ["nn"])
    base = base.withColumn("reads", F.col("covered") - F.col("gone1") - F.col("gone2") + F.col("nn"))
    table = found.select(*KEYS, "o22").join(base, ["p1", "p2"]).join(mcov1.select("p1", "p2", "a1", "row", "mcov1"), ["p1", "p2", "a1"]).join(mcov2.select("p1", "p2", "a2", "column", "mcov2"), ["p1", "p2", "a2"])
    return table.select(
        *KEYS,
        (F.col("reads") - F.col("all1") - F.col("all2") + F.col("joint_all")).alias("o11"),
        (F.col("mcov2") - F.col("column")).alias("o12"),
        (F.col("mcov1") - F.col("row")).alias("o21"),
        "o22",
        "reads",
    )


def top_edges(edges: DataFrame, limit: int) -> DataFrame:
    """Edges of the highest share of joint reads; ties by position and allele."""
    return edges.withColumn("rel_freq", F.col("o22") / F.col("reads")).orderBy(F.desc("rel_freq"), *KEYS).limit(limit)


def both_ways(edges: DataFrame) -> DataFrame:
    """(p, a) and its neighbour (q, b), each edge twice."""
    forth = edges.select(F.col("p1").alias("p"), F.col("a1").alias("a"), F.col("p2").alias("q"), F.col("a2").alias("b"))
    return forth.unionByName(forth.select(F.col("q").alias("p"), F.col("b").alias("a"), F.col("p").alias("q"), F.col("a").alias("b")))


def prune_second_minors(edges: DataFrame, freq: DataFrame, deletions_only: bool = False) -> DataFrame:
    """Of the neighbours of a minor at one position, the most frequent stays; an edge stays if it does from both ends.

    freq has pos, allele and freq. deletions_only: prune only where the winner is a deletion.
    """
    ways = both_ways(edges).join(freq.select(F.col("pos").alias("q"), F.col("allele").alias("b"), "freq"), ["q", "b"])
    at = Window.partitionBy("p", "a", "q")
    ranked = ways.withColumn("n", F.row_number().over(at.orderBy(F.desc("freq"), "b"))).withColumn("winner", F.first("b").over(at.orderBy(F.desc("freq"), "b")))
    stays = F.col("n") == 1
    if deletions_only:
        stays = stays | (F.col("winner") != "-")
    kept = ranked.where(stays)
    forth = kept.where("p < q").select(F.col("p").alias("p1"), F.col("a").alias("a1"), F.col("q").alias("p2"), F.col("b").alias("a2"))
    back = kept.where("p > q").select(F.col("q").alias("p1"), F.col("b").alias("a1"), F.col("p").alias("p2"), F.col("a").alias("a2"))
    return edges.join(forth, KEYS, "left_semi").join(back, KEYS, "left_semi")


def rotation_candidates(profile: DataFrame, least_reads: int = 40, least_share: float = 0.45) -> DataFrame:
    """Positions whose second most frequent letter (N included in the ranking) might as well be the major one."""
    rank = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("freq"), F.instr(F.lit("ACGT-N"), F.col("allele"))))
    depth = F.sum("n").over(Window.partitionBy("pos"))
    return profile.select("pos", "allele", "freq", rank.alias("place"), depth.alias("depth")).where((F.col("place") == 2) & (F.col("depth") >= least_reads) & (F.col("freq") >= least_share) & ~F.col("allele").isin("N", "-")).select("pos", "allele", "depth", "freq")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("p", "a").agg(F.count(F.lit(1)).alias("degree"))


def rel_freq(o22: Column, reads: Column) -> Column:
    return F.try_divide(o22, reads)
