"""Genomic intervals as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
UNITS = {"kb": 1_000, "mb": 1_000_000, "bp": 1, "b": 1, "k": 1_000, "m": 1_000_000}


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quantity(text: Column) -> Column:
    """A number with commas and a unit: bp, kb and mb in any case, b, k and m; null if it is none, or beyond an int."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    unit = F.regexp_extract(plain, r"^\d+\s*((?:[kKmM][bB]|bp|b|k|m)?)$", 1)
    number = F.regexp_extract(plain, r"^(\d+)\s*(?:[kKmM][bB]|bp|b|k|m)?$", 1).try_cast("decimal(28,0)")
    factors = F.create_map(F.lit(""), F.lit(1), *[F.lit(x) for item in UNITS.items() for x in item])
    value = number * F.coalesce(F.try_element_at(factors, unit), F.try_element_at(factors, F.lower(unit)))
    return _let(value, lambda v: F.when(v <= 2_147_483_647, v.cast("long")))


def parse(text: Column, contig_length: Column | None = None, contig_alone: bool = False) -> Column:
    """contig, start and end of `chrom:start-end`, `chrom:mid+ext` or `chrom:start-end+ext`; null if it is none.

    The start is 0 at least, the end not before the start.  With contig_length, the end is cut to it, and with
    contig_alone a bare contig is all of it.
    """
    contig = F.regexp_extract(text, r"^\s*([^:]+?)\s*(?::|$)", 1)
    span = r"^[^:]+:\s*([^-+]+)-([^-+]+?)(?:\+(.+))?\s*$"
    around = r"^[^:]+:\s*([^-+]+)\+([^-+]+)\s*$"
    # The two forms exclude each other; a place without its form stays null.
    parts = F.array(*[F.regexp_extract(text, span, k) for k in (1, 2, 3)], *[F.regexp_extract(text, around, k) for k in (1, 2)])

    def bounds(n: Column) -> Column:
        at = lambda k: F.get(n, F.lit(k))
        extra = F.when(F.regexp_extract(text, span, 3) == "", F.lit(0)).otherwise(at(2))
        low = F.greatest(F.coalesce(at(0) - extra, at(3) - at(4)), F.lit(0))
        high = F.coalesce(at(1) + extra, at(3) + at(4))
        if contig_length is not None:
            high = F.least(high, contig_length.cast("long"))
            if contig_alone:
                bare = ~F.contains(text, F.lit(":"))
                low, high = F.when(bare, F.lit(0)).otherwise(low), F.when(bare, contig_length.cast("long")).otherwise(high)
        # least and greatest pass over nulls
        known = F.when(at(0).isNotNull() | at(3).isNotNull() | F.lit(contig_alone), True)
        return F.struct(low.alias("low"), high.alias("high"), known.alias("known"))

    def made(b: Column) -> Column:
        good = b["known"] & (b["low"] <= b["high"]) & (contig != "")
        return F.when(good, F.struct(contig.alias("contig"), b["low"].cast("int").alias("start"), b["high"].cast("int").alias("end")))

    return _let(_let(F.transform(parts, quantity), bounds), made)


def resolve_contigs(names: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """name and contig: the dictionary's entry that is meant, or null.

    In this order: the same name, the same in another case, with or without `chr`, and chrM for MT or back.
    """
    asked = F.col(name)
    core = F.regexp_replace(asked, "^(?i)chr", "")
    mito = F.when(F.lower(asked).isin("chrm", "m", "mt"), F.array(F.lit("chrM"), F.lit("MT"))).otherwise(F.array().cast("array<string>"))
    tries = F.concat(
        F.array(F.struct(F.lit(0).alias("order"), asked.alias("key"), F.lit(False).alias("folded")), F.struct(F.lit(1).alias("order"), F.lower(asked).alias("key"), F.lit(True).alias("folded")), F.struct(F.lit(2).alias("order"), core.alias("key"), F.lit(False).alias("folded")), F.struct(F.lit(3).alias("order"), F.concat(F.lit("chr"), core).alias("key"), F.lit(False).alias("folded"))),
        F.transform(mito, lambda x: F.struct(F.lit(4).alias("order"), x.alias("key"), F.lit(False).alias("folded"))),
    )
    listed = dictionary.select(F.col("contig"), F.explode(F.array(F.struct(F.col("contig").alias("key"), F.lit(False).alias("folded")), F.struct(F.lower("contig").alias("key"), F.lit(True).alias("folded")))).alias("k")).select("contig", "k.*")
    met = names.select(name, F.inline(tries)).join(listed, ["key", "folded"], "left").where("contig is not null")
    best = met.withColumn("n", F.row_number().over(Window.partitionBy(name).orderBy("order", "contig"))).where("n = 1").select(name, "contig")
    return names.select(name).distinct().join(best, name, "left")
