"""Frequencies of the four haplotypes of two SNPs by expectation maximisation, for many pairs at once.

Each row is a pair; its state is an array of four frequencies, in the order 11, 12, 21, 22 of the true letters (1: major,
2: minor), and all rounds are one expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds end when the frequencies' Euclidean change is at most this, or at this many.
LEAST_CHANGE, ROUNDS = 0.001, 100


def observed_given(e12: float, e21: float) -> list[list[float]]:
    """[true][observed] of one SNP; e21 is the chance that a true major letter is read as the minor one, e12 the other way."""
    return [[1 - e21, e21], [e12, 1 - e12]]


def pair_frequencies(counts: list[Column], first: tuple[float, float], second: tuple[float, float], rounds: int = ROUNDS) -> Column:
    """A struct of f, the four frequencies, and rounds, how many were made.

    counts are the reads of the observed letters 11, 12, 21, 22; first and second the chances (e12, e21) of the SNPs.
    Observations that no haplotype of positive frequency explains are left out, as is a pair without any reads (null).
    """
    a, b = observed_given(*first), observed_given(*second)
    chance = [[a[t // 2][o // 2] * b[t % 2][o % 2] for o in range(4)] for t in range(4)]
    total = sum(counts[1:], counts[0])

    def step(f: Column) -> Column:
        weights = [F.try_divide(counts[o].cast("double"), sum((f[t] * chance[t][o] for t in range(1, 4)), f[0] * chance[0][o])) for o in range(4)]
        mass = [f[t] * sum((F.coalesce(weights[o], F.lit(0.0)) * chance[t][o] for o in range(1, 4)), F.coalesce(weights[0], F.lit(0.0)) * chance[t][0]) for t in range(4)]
        return F.transform(F.array(*mass), lambda m: F.try_divide(m, sum(mass[1:], mass[0])))

    def again(state: Column, _: Column) -> Column:
        new = step(state["f"])
        made = F.transform(F.array(new), lambda n: F.struct(n.alias("f"), (state["rounds"] + 1).alias("rounds"), F.sqrt(sum(((n[t] - state["f"][t]) * (n[t] - state["f"][t]) for t in range(1, 4)), (n[0] - state["f"][0]) * (n[0] - state["f"][0]))).alias("change")))
        return F.when(state["change"] <= LEAST_CHANGE, state).otherwise(made[0])

    start = F.struct(F.array(*[F.lit(0.25)] * 4).alias("f"), F.lit(0).alias("rounds"), F.lit(1.0).alias("change"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again)
    return F.when(total > 0, F.transform(F.array(done), lambda d: F.struct(d["f"].alias("f"), d["rounds"].alias("rounds")))[0])
