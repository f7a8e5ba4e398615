"""Bitmap indexes, floor seeks, summed areas, the ordered merge and the EM of pairs, against plain versions."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import pair_em
from strandweave.operators import bitmaps, haplotypes, linkage, seek


def test_bitmaps_over_bucket_borders(spark):
    """Read ids around the borders of buckets, negative and zero ones, and repeated cells."""
    ids = [1, 2, 32768, 32769, 65536, 65537, 0, -1, -32767, -32768, -40000, 10**12]
    rng = random.Random(2)
    cells = [(i, p, rng.choice("ACGT")) for i in ids for p in (3, 5, 5, 900)] + [(None, 3, "A")]
    frame = spark.createDataFrame(cells, "read_id long, pos int, allele string")
    index = bitmaps.index(frame)
    own = {c for c in cells if c[0] is not None}
    assert {tuple(r) for r in bitmaps.reads_of(index).collect()} == own
    assert {(r["pos"], r["allele"]): r["n"] for r in bitmaps.sizes(index).collect()} == {(p, a): sum(c[1:] == (p, a) for c in own) for _, p, a in own}
    joined = linkage.joint_counts(frame.where("read_id is not null").distinct())
    assert sorted(map(tuple, bitmaps.intersections(index).collect())) == sorted(map(tuple, joined.collect()))
    assert bitmaps.intersections(bitmaps.index(frame.limit(0))).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_floor_seek(spark, parts):
    """Two thirds of the asks are for one number."""
    rng = random.Random(1)
    values = [rng.randrange(0, 1000) * 3 for _ in range(80)] + [None, 600, 600]
    asks = [(i, 600 if i % 3 else rng.randrange(-50, 3100)) for i in range(400)] + [(-1, None), (-2, -10**12), (-3, 10**12)]
    found = seek.floor_seek(spark.createDataFrame([(v,) for v in values], "value long"), spark.createDataFrame(asks, "k long, ask long"), parts=parts).collect()
    listed = sorted({v for v in values if v is not None})

    def plain(x):
        if x is None:
            return None, None
        at = bisect.bisect_right(listed, x) - 1
        return (listed[at] if at >= 0 else None), max(at, 0)

    assert sorted((r["k"], r["floor"], r["index"]) for r in found) == sorted((k, *plain(x)) for k, x in asks)


def test_floor_seek_without_values(spark):
    none = spark.createDataFrame([], "value long")
    asks = spark.createDataFrame([(5,), (5,)], "ask long")
    assert [tuple(r) for r in seek.floor_seek(none, asks).collect()] == [(5, None, 0)] * 2
    assert seek.floor_seek(asks.withColumnRenamed("ask", "value"), asks.limit(0)).count() == 0


def test_covering_reads_by_summed_areas(spark):
    """Single spans, mates apart, overlapping, touching, in the other order, and without letters."""
    rng = random.Random(4)
    shapes = []
    for _ in range(60):
        a, b = rng.randrange(0, 30), rng.randrange(0, 30)
        left = (a, a + rng.randrange(0, 12))
        right = rng.choice([(-1, -2), (b, b + rng.randrange(0, 12)), (left[1] + 1, left[1] + 4)])
        shapes.append((*left, *right, rng.randrange(1, 4)))
    shapes.append((0, -1, -1, -2, 5))
    frame = spark.createDataFrame(shapes, "l_off int, l_end int, r_off int, r_end int, reads long")
    pairs = [(p, q) for p in range(45) for q in range(p + 1, 45) if (p * q) % 3]
    found = linkage.common_by_shape(spark.createDataFrame(pairs, "p1 int, p2 int"), frame)

    def covers(s, p):
        apart = s[2] > s[1] or s[3] < s[0]
        if s[2] >= 0 and not apart:
            return min(s[0], s[2]) <= p <= max(s[1], s[3])
        return s[0] <= p <= s[1] or (s[2] >= 0 and s[2] <= p <= s[3])

    want = {(p, q): sum(s[4] for s in shapes if covers(s, p) and covers(s, q)) for p, q in pairs}
    assert {(r["p1"], r["p2"]): r["covered"] for r in found.collect()} == {k: n for k, n in want.items() if n}
    assert linkage.common_by_shape(spark.createDataFrame([], "p1 int, p2 int"), frame).count() == 0


@pytest.mark.parametrize("radius", [1, 2])
def test_ordered_merge_in_rounds(spark, radius):
    """Chains of near haplotypes, ties and equal ones settle as one after the other does."""
    rng = random.Random(radius)
    texts = ["".join(rng.choice("AC") for _ in range(6)) for _ in range(40)] + ["A" * k + "C" * (6 - k) for k in range(7)] + ["ACG", "ACC", "", "AAAAAA", "AAAAAA"]
    rows = [(t, rng.choice([1, 2, 3, 5]) / 64) for t in texts]
    together = {}
    for t, f in rows:
        together.setdefault(t, []).append(f)
    first = [(t, max(fs)) for t, fs in together.items()]
    kept = []
    total = {}
    for t, _ in sorted(first, key=lambda r: (-r[1], r[0])):
        near = next((k for k in kept if len(k) == len(t) and sum(a != b for a, b in zip(k, t, strict=True)) <= radius), t)
        kept += [t] if near is t else []
        total[near] = total.get(near, 0.0) + sum(together[t])
    found = haplotypes.merge_near_rows(spark.createDataFrame(rows, "haplotype string, frequency double"), radius)
    assert {r["haplotype"]: r["frequency"] for r in found.collect()} == total
    if radius == 1:
        assert dict(haplotypes.merge_near(first)).keys() == total.keys()
    assert haplotypes.merge_near_rows(found.limit(0), radius).count() == 0


def plain_em(n, first, second):
    a, b = pair_em.observed_given(*first), pair_em.observed_given(*second)
    h = [[a[t // 2][o // 2] * b[t % 2][o % 2] for o in range(4)] for t in range(4)]
    f, rounds = [0.25] * 4, 0
    while rounds < 100:
        d = [sum(f[t] * h[t][o] for t in range(4)) for o in range(4)]
        m = [sum(n[o] * f[t] * h[t][o] / d[o] for o in range(4) if d[o]) for t in range(4)]
        new = [x / sum(m) for x in m]
        rounds += 1
        moved = math.dist(f, new)
        f = new
        if moved <= 0.001:
            break
    return f, rounds


def test_pair_frequencies(spark):
    rows = [(80, 0, 0, 20), (50, 10, 10, 30), (0, 0, 0, 7), (97, 1, 1, 1), (1, 1, 1, 1), (0, 5, 0, 0)]
    frame = spark.createDataFrame([*rows, (0, 0, 0, 0)], "a long, b long, c long, d long")
    first, second = (0.02, 0.05), (0.01, 0.1)
    got = frame.select("a", "b", "c", "d", pair_em.pair_frequencies([F.col(c) for c in "abcd"], first, second).alias("em")).collect()
    for r in got:
        n = tuple(r)[:4]
        if not sum(n):
            assert r["em"] is None
            continue
        f, rounds = plain_em(n, first, second)
        assert r["em"]["rounds"] == rounds
        assert r["em"]["f"] == pytest.approx(f, abs=1e-9)
