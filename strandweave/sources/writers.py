"""Reports: FASTA, JSON, VCF, tables and imputed reads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.alleles import smart_double

VERSION = "1.0"


def haplotype_name(index: Column, freq: Column, sample: str, style: str = "short") -> Column:
    """`>{index}_fr_{freq}`, or for `extended` with decimals after it (two by default) `>{sample}_{index}_{freq}`."""
    if style.startswith("extended"):
        decimals = int(style[len("extended") :] or 2)
        return F.concat(F.lit(f">{sample}_"), index.cast("string"), F.lit("_"), F.format_string(f"%.{decimals}f", freq))
    return F.concat(F.lit(">"), index.cast("string"), F.lit("_fr_"), freq.cast("string"))


def fasta_lines(haplotypes: DataFrame, sample: str, style: str = "short", start: int = 0, end: int | None = None) -> DataFrame:
    """value: name, letters [start, end) and a blank line of each haplotype; ranks begin at 0. haplotypes has rank, haplotype, frequency."""
    letters = F.substring("haplotype", F.lit(start + 1), (F.least(F.lit(end), F.length("haplotype")) if end is not None else F.length("haplotype")) - start)
    return haplotypes.orderBy("rank").select(F.concat(haplotype_name(F.col("rank"), F.col("frequency"), sample, style), F.lit("\n"), letters, F.lit("\n")).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    """One text file under path; only for reports of bounded size."""
    rows.coalesce(1).write.mode("overwrite").text(path)


def result_json(haplotypes: list[dict], settings: dict[str, str], error: str = "", code: int = 0, metrics: dict | None = None) -> str:
    """The result of a run; haplotypes have frequency, name, snps, sourceClique and haplotype. metrics: figures of its graphs."""
    made = {"version": VERSION, "settings": settings, "error": error, "errorCode": code, "foundHaplotypes": len(haplotypes), "haplotypes": haplotypes}
    return json.dumps(made | ({"metrics": metrics} if metrics else {}), indent=2)


def read_names(haplotypes: DataFrame, assignment: DataFrame, reads: DataFrame) -> DataFrame:
    """rank and name: which reads each haplotype has, several for a read that ties. A table, as reads are many."""
    cliques = haplotypes.select("rank", F.explode("cliques").alias("clique_id"))
    own = assignment.select("read_id", "clique_id").join(F.broadcast(cliques), "clique_id").select("rank", "read_id").distinct()
    return own.join(reads.select("read_id", "name"), "read_id").select("rank", "name")


def read_name_lines(haplotypes: DataFrame, assignment: DataFrame | None, reads: DataFrame, sample: str, style: str = "short") -> DataFrame:
    """value, in order: the name of each haplotype and then of its reads, a line each; without an assignment no reads."""
    head = haplotypes.select("rank", F.lit(0).alias("row"), haplotype_name(F.col("rank"), F.col("frequency"), sample, style).alias("value"))
    if assignment is not None:
        head = head.union(read_names(haplotypes, assignment, reads).select("rank", F.lit(1), "name"))
    return head.orderBy("rank", "row", "value").select("value")


def vcf_rows(snps: DataFrame, majors: DataFrame, start: int = 0, end: int = 10_000_000) -> DataFrame:
    """chrom, pos (1-based), id, ref, alt, qual, filter and info of the SNPs of each position.

    snps has pos, allele, corrected. Deletions are left out, as letters or as reference; start and end are both in.
    """
    rows = snps.where((F.col("allele") != "-") & F.col("pos").between(start, end)).join(majors, "pos").where("major <> '-'")
    listed = F.array_sort(F.collect_list(F.struct("allele", smart_double(F.col("corrected")).alias("af"))))
    made = rows.groupBy("pos", "major").agg(listed.alias("alts"))
    join = lambda field: F.array_join(F.transform("alts", lambda x: x[field]), ",")
    return made.select(F.lit("ref").alias("chrom"), (F.col("pos") + 1).cast("int").alias("pos"), F.lit(".").alias("id"), F.col("major").alias("ref"), join("allele").alias("alt"), F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), F.concat(F.lit("AF="), join("af")).alias("info"))


#: The header of a VCF file.
VCF_HEADER = ["##fileformat=VCFv4.2", '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele Frequency">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


def vcf_lines(rows: DataFrame) -> DataFrame:
    """value: header and rows, in order."""
    head = rows.sparkSession.createDataFrame([(-len(VCF_HEADER) + i, line) for i, line in enumerate(VCF_HEADER)], "at int, value string")
    body = rows.select(F.col("pos").alias("at"), F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "info").alias("value"))
    return head.union(body).orderBy("at").select("value")


def imputed_lines(cells: DataFrame) -> DataFrame:
    """read_id and value: each read's letters in order."""
    row = F.array_sort(F.collect_list(F.struct("pos", "allele")))
    return cells.groupBy("read_id").agg(F.array_join(F.transform(row, lambda x: x["allele"]), "").alias("value"))
