import math
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.functions import alleles, binomial, linkage_tests
from strandweave.operators.graph import bron_kerbosch
from strandweave.operators.haplotypes import merge_near
from strandweave.plans.pipelines import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "text"), [(3.14159, "3.14"), (0.1234567, "0.123"), (0.05, "0.0500"), (0.0011, "0.00110"), (1e-10, "0.0")])
def test_smart_double(spark, value, text):
    assert one(spark, alleles.smart_double(F.lit(value))) == text


def test_split_codes_round_trip(spark):
    for major in "ACGT-":
        for own in "ACGT-".replace(major, ""):
            code = alleles.split_code(F.lit(7), F.lit(own), F.lit(major))
            assert one(spark, F.concat(alleles.split_position(code).cast("string"), alleles.split_allele(code, F.lit(major)))) == f"7{own}"


def test_overlap_left_wins(spark):
    assert one(spark, alleles.merged_left(F.lit("AAAA"), F.lit(0), F.lit("CCCC"), F.lit(2))) == "AAAACC"
    assert one(spark, alleles.merged_left(F.lit("AAAA"), F.lit(0), F.lit("CC"), F.lit(1))) == "AAAA"
    assert one(spark, alleles.merged_left(F.lit("AAAA"), F.lit(0), F.lit("CC"), F.lit(9))) == "AAAA"


def test_hamming_and_differences(spark):
    assert one(spark, alleles.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert one(spark, alleles.hamming(F.lit("ACGT"), F.lit("ACG"))) is None
    assert one(spark, alleles.hamming_over(F.lit("ACG"), F.lit("ACTT"))) == 1
    assert one(spark, alleles.differences(F.lit("ACGT"), F.lit("AGGA"))) == ["1 C G", "3 T A"]
    assert one(spark, alleles.si_format(F.lit(1_250_000))) == "1.2M"
    assert one(spark, alleles.digit_letter(F.lit("4"))) == "-"
    assert one(spark, alleles.char_at(F.lit("AC"), F.lit(3), F.lit("GT"), F.lit(8), F.lit(9))) == "T"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(-1, 120), st.floats(1e-6, 0.999))
def test_upper_tail_is_the_sum(n, s, p):
    exact = math.fsum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(max(s + 1, 0), n + 1))
    assert abs(float(binomial.upper_tail(s, n, p)) - exact) < 1e-10


def test_log_pmf():
    assert abs(float(np.exp(binomial.log_pmf(3, 10, 0.2))) - math.comb(10, 3) * 0.2**3 * 0.8**7) < 1e-12


def test_edges_by_ratio_and_zero_cells(spark):
    args = [F.lit(float(v)) for v in (938, 10, 11, 348)]
    assert one(spark, linkage_tests.short_read_edge(*args, F.lit(1554.0), 120)) is True
    assert one(spark, linkage_tests.short_read_edge(*[F.lit(float(v)) for v in (900, 0, 50, 3)], F.lit(1000.0), 120)) is False
    assert one(spark, linkage_tests.short_read_edge(*[F.lit(float(v)) for v in (0, 0, 0, 30)], F.lit(30.0), 120)) is True
    assert one(spark, linkage_tests.fits_threshold(F.lit(10), F.lit(0), 10, 0.1)) is False


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.data())
def test_bron_kerbosch_against_brute_force(n, data):
    near = {v: set() for v in range(n)}
    for a, b in combinations(range(n), 2):
        if data.draw(st.booleans()):
            near[a].add(b)
            near[b].add(a)
    every = [set(c) for k in range(1, n + 1) for c in combinations(range(n), k) if all(y in near[x] for x, y in combinations(c, 2))]
    maximal = {frozenset(c) for c in every if not any(c < d for d in every)}
    found = list(bron_kerbosch(near))
    assert set(found) == maximal
    assert len(found) == len(maximal)


def test_merge_near():
    assert merge_near([("ACGT", 0.6), ("ACGA", 0.3), ("TTTT", 0.1)]) == [("ACGT", 0.8999999999999999), ("TTTT", 0.1)]


def test_windows_cover_the_region():
    made = windows({p: 100 - abs(p - 40) for p in range(120)}, 0, 119, 30)
    assert min(a for a, _ in made) == 0
    assert max(b for _, b in made) == 119
    assert set().union(*(range(a, b + 1) for a, b in made)) == set(range(120))
