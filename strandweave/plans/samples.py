"""The frames of one sample that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.linkage_tests import fits_threshold, has_edge, short_read_edge
from strandweave.operators import linkage, pileup
from strandweave.sources import fixture
from strandweave.storage import by_read, stored

#: Fixed value: long-read minors on fewer reads have no edges.
LEAST_ROWS = 10


class Sample:
    """A pileup with what follows from it; each frame is made once, and those that many others read are stored.

    deletions: whether `-` may be the consensus, and a minor. error and close: of the edge tests. segments: gives the
    reads' strings (off, seq), for runs of deletions. ignore_deletion: no `-` is a minor. ratio_reach: pairs further apart are
    not linked by the ratio alone. inner: the pileup without cells that shapes do not cover, such as the N that pad a long
    read, which no pair of cells needs.
    """

    def __init__(self, pile: DataFrame, shapes: DataFrame, length: int, deletions: bool, error: float, close: int = 0, majors: DataFrame | None = None, segments: Callable[[], DataFrame] | None = None, ignore_deletion: bool = False, ratio_reach: float | None = None, inner: DataFrame | None = None):
        self.pile, self.shapes, self.length, self.deletions, self.error, self.close = pile, shapes, length, deletions, error, close
        self._majors, self.segments, self.ignore_deletion, self.ratio_reach = majors, segments, ignore_deletion, ratio_reach
        self.inner = pile if inner is None else inner
        self.names: DataFrame | None = None

    def named(self, reads: DataFrame) -> Sample:
        """This sample, with the names of its reads (read_id, name) for reports."""
        self.names = reads.select("read_id", "name")
        return self

    def replaced(self, majors: DataFrame) -> Sample:
        """The same reads with another consensus."""
        return Sample(self.pile, self.shapes, self.length, self.deletions, self.error, self.close, majors, self.segments, self.ignore_deletion, self.ratio_reach, self.inner)

    def only(self, reads: DataFrame) -> Sample:
        """The same settings and consensus over some of the reads (read_id)."""
        part = lambda frame: by_read(frame, reads, "left_semi")
        return Sample(part(self.pile), part(self.shapes), self.length, self.deletions, self.error, self.close, self.majors, self.segments, self.ignore_deletion, self.ratio_reach, part(self.inner))

    @cached_property
    def counts(self) -> DataFrame:
        return stored(pileup.coverage(self.pile))

    @cached_property
    def profile(self) -> DataFrame:
        return pileup.profile(self.counts)

    @cached_property
    def majors(self) -> DataFrame:
        if self._majors is not None:
            return self._majors
        if self.deletions:
            return stored(pileup.consensus(self.counts))
        return stored(pileup.consensus(self.profile, deletions=False, value="freq", least=0.001))

    @cached_property
    def cells(self) -> DataFrame:
        return stored(pileup.sparse(self.inner, self.majors).select("read_id", "pos", "allele"))

    @cached_property
    def joint(self) -> DataFrame:
        """Joint counts of all cells, single reads' noise included."""
        return stored(linkage.joint_counts(self.cells))

    @cached_property
    def shape_sizes(self) -> DataFrame:
        return stored(linkage.shape_counts(self.shapes))

    def minors(self, least: int, drop_deletions: bool = False) -> DataFrame:
        """Letters that are neither major nor N, on at least that many reads."""
        rows = linkage.frequent_minors(self.counts, self.majors, least)
        return rows.where("allele <> '-'") if drop_deletions or self.ignore_deletion else rows

    def found(self, least: int, start: int = 0, end: int = 1_000_000) -> DataFrame:
        """Pairs of minors with at least that many joint reads, far enough apart and within the region; o22 is their count.

        Only minors on so many reads are paired.
        """
        cells = self.cells.join(F.broadcast(self.minors(least)), ["pos", "allele"], "left_semi")  # a few letters a position
        joint = linkage.joint_counts(cells).where(F.col("n") >= least).withColumnRenamed("n", "o22")
        return linkage.far_pairs(joint, self.close, start, end)

    def likely(self, least: int, share: float, start: int, end: int, drop_deletions: bool) -> DataFrame:
        """The same for pairs that may exceed that share of their common reads; pairs that can't are never counted."""
        least_row = max(least, LEAST_ROWS) if self.deletions else least
        pairs = linkage.likely_pairs(self.minors(least_row, drop_deletions), self.counts, self.shape_sizes, share)
        return linkage.hits(linkage.far_pairs(pairs, self.close, start, end), self.cells).where(F.col("o22") >= least)

    def table(self, found: DataFrame) -> DataFrame:
        return linkage.linkage_table(found, self.cells, self.shapes)

    def tested(self, least: int, share: float, start: int = 0, end: int = 1_000_000, drop_deletions: bool = False) -> DataFrame:
        """Candidates above the threshold, with is_edge."""
        found = stored(self.likely(least, share, start, end, drop_deletions))
        rows = self.table(found).where(fits_threshold(F.col("o22"), F.col("reads"), least, share))
        test = short_read_edge if not self.deletions else has_edge
        near = None if self.ratio_reach is None else F.col("p2") - F.col("p1") <= self.ratio_reach
        return rows.withColumn("is_edge", test(*(F.col(c) for c in ("o11", "o12", "o21", "o22", "reads")), self.length, self.error, near))

    def edges(self, least: int, share: float, **options: object) -> DataFrame:
        return self.tested(least, share, **options).where("is_edge").drop("is_edge")

    @cached_property
    def frequencies(self) -> DataFrame:
        return self.profile.select("pos", "allele", "freq")


def short_sample(spark: SparkSession, sf_dir: str) -> Sample:
    """The derived short reads."""
    return Sample(fixture.pileup(spark, sf_dir), fixture.shapes(spark, sf_dir), fixture.LENGTH, deletions=False, error=0.2, segments=lambda: fixture.segment_reads(spark, sf_dir))


def long_sample(spark: SparkSession, sf_dir: str) -> Sample:
    """The derived long reads, padded with N to the whole reference."""
    first, last = fixture.long_bounds(F.col("o_orderkey"))
    shapes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("read_id"), first.alias("l_off"), last.alias("l_end"), F.lit(-1).alias("r_off"), F.lit(-2).alias("r_end"))
    return Sample(fixture.long_pileup(spark, sf_dir), shapes, fixture.LENGTH, deletions=True, error=0.1, close=5, inner=fixture.long_pileup(spark, sf_dir, padded=False))
