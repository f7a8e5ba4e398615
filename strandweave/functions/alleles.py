"""Column functions on alleles, reads and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet in index order; `-` is a deletion, `N` not covered or unknown.
ALPHABET = "ACGT-N"
MINORS_PER_POSITION = 4


def allele_index(allele: Column) -> Column:
    """Index in the alphabet; any other letter counts as N."""
    found = F.instr(F.lit(ALPHABET), allele)
    return F.when((F.length(allele) == 1) & (found > 0), found - 1).otherwise(F.lit(len(ALPHABET) - 1)).cast("int")


def allele_at(index: Column) -> Column:
    return F.substring(F.lit(ALPHABET), index + 1, F.lit(1))


def digit_letter(digit: Column) -> Column:
    """01234 stand for ACGT-, anything else for N."""
    return F.when(digit.isin(*"01234"), allele_at(digit.try_cast("int"))).otherwise(F.lit("N"))


def split_code(pos: Column, allele: Column, major: Column) -> Column:
    """pos * 4 and the allele's index with the major left out."""
    own, top = allele_index(allele), allele_index(major)
    return (pos * MINORS_PER_POSITION + own - F.when(own >= top, 1).otherwise(0)).cast("int")


def split_position(code: Column) -> Column:
    return F.floor(code / MINORS_PER_POSITION).cast("int")


def split_allele(code: Column, major: Column) -> Column:
    own = F.pmod(code, F.lit(MINORS_PER_POSITION))
    return allele_at(own + F.when(own >= allele_index(major), 1).otherwise(0))


def char_at(left: Column, left_off: Column, right: Column, right_off: Column, pos: Column) -> Column:
    """The letter of a read pair at pos: left first, then right, else N."""
    own = lambda seq, off: F.when((pos >= off) & (pos < off + F.length(seq)), F.substring(seq, pos - off + 1, F.lit(1)))
    return F.coalesce(own(left, left_off), F.when(right_off >= 0, own(right, right_off)), F.lit("N"))


def merged_left(left: Column, left_off: Column, right: Column, right_off: Column) -> Column:
    """The left mate with what the right one adds where they overlap; the left wins where both have a letter."""
    reach = left_off + F.length(left)
    return F.when((right_off >= 0) & (reach > right_off), F.concat(left, F.substring(right, reach - right_off + 1, F.length(right)))).otherwise(left)


def overlaps(left: Column, left_off: Column, right_off: Column) -> Column:
    return (right_off >= 0) & (left_off + F.length(left) > right_off)


def hamming(a: Column, b: Column) -> Column:
    """Places in which strings of equal length differ; null for unequal lengths and nulls."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def hamming_over(a: Column, b: Column) -> Column:
    """Places of a in which b has another letter; b may be longer."""
    pairs = F.zip_with(F.split(a, ""), F.split(F.substring(b, F.lit(1), F.length(a)), ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def differences(a: Column, b: Column, start: int = 0, end: int | None = None) -> Column:
    """Array of `pos a b` for places in [start, end) in which strings differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    stop = end if end is not None else 1 << 30
    each = F.transform(pairs, lambda z, i: F.when((z["x"] != z["y"]) & (i >= start) & (i < stop), F.format_string("%d %s %s", i, z["x"], z["y"])))
    return F.filter(each, lambda z: z.isNotNull())


def smart_digits(x: Column) -> Column:
    """Decimals for a short display: 2 from 1 on, 3 from 0.1 on, one more for each decade below, 1 under 1e-9."""
    digits = F.lit(1)
    for k in range(9, 0, -1):
        digits = F.when(x >= F.lit(float(f"1e-{k}")), k + 2).otherwise(digits)
    return F.when(x >= 1, 2).otherwise(digits)


def smart_double(x: Column) -> Column:
    """x with `smart_digits` decimals, rounded half up."""
    out = F.format_string("%.1f", x)
    for d in range(2, 12):
        out = F.when(smart_digits(x) == d, F.format_string(f"%.{d}f", x)).otherwise(out)
    return out


def si_format(n: Column) -> Column:
    """n with k, M, G, T or P, one decimal; below 1000 as it is."""
    out = n.cast("string")
    for power, unit in enumerate("kMGTP", 1):
        low = 1000**power
        out = F.when(n >= low, F.concat(F.format_string("%.1f", F.floor(n / (low / 10)) / 10), F.lit(unit))).otherwise(out)
    return out


def normalised(x: Column, total: Column) -> Column:
    """x as a share of total, unchanged where that is 0."""
    return F.when(total == 0, x).otherwise(x / total)


def padded(seq: Column, width: Column, fill: str = "%") -> Column:
    return F.rpad(seq, width, F.lit(fill))


def region(pos: Column, start: int = 0, end: int = 1_000_000, length: int | None = None) -> Column:
    """Whether pos lies in [start, min(end, length - 1)]."""
    last = end if length is None else min(end, length - 1)
    return pos.between(start, last)
