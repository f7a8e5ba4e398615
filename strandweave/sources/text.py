"""Readers of FASTA, line-per-read text and SAM, on Spark's text source, and of BAM."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bam import bam, bam_header


def sample_name(path: Column) -> Column:
    """The file's name without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """read_id, name, seq and sample: records in file order.

    A record begins at a `>` line; blank lines end it or stand between records and are skipped.  Records are split at
    `>` by the reader, so a file is read in parallel; read_id is the record's number within its file where one task
    reads it, and in any case orders records as the file does.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("read_id"))
    text = F.regexp_replace("value", r"^\s*>?", "")
    lines = F.split(text, r"\r?\n")
    name = F.element_at(lines, 1)
    seq = F.array_join(F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.trim(x)), "")
    return rows.select("read_id", F.trim(name).alias("name"), seq.alias("seq"), sample_name(F.col("path")).alias("sample")).where("name <> '' OR seq <> ''")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """read_id, seq and sample: one read a line; several files are several samples."""
    rows = spark.read.text(path)
    return rows.select(F.monotonically_increasing_id().alias("read_id"), F.col("value").alias("seq"), sample_name(F.col("_metadata.file_path")).alias("sample"))


def is_bam(path: str) -> bool:
    return path.lower().rstrip("/").endswith(".bam")


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """contig, length and interval of the first @SQ line, or of the first contig of a BAM file."""
    if is_bam(path):
        return bam_header(spark, path)
    first = spark.read.text(path).where("value LIKE '@SQ%'").limit(1)
    name, length = F.regexp_extract("value", r"\tSN:([^\t]*)", 1), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int")
    return first.select(name.alias("contig"), length.alias("length"), F.concat(name, F.lit(":0-"), length.cast("string")).alias("interval"))


#: The columns of an alignment line that are used, by number.
SAM_FIELDS = {"qname": (0, "string"), "flag": (1, "int"), "rname": (2, "string"), "pos": (3, "int"), "mapq": (4, "int"), "cigar": (5, "string"), "rnext": (6, "string"), "pnext": (7, "int"), "tlen": (8, "int"), "seq": (9, "string")}


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines, or the records of a BAM file, with rec_id in file order."""
    if is_bam(path):
        return bam(spark, path)
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' AND NOT value LIKE '@%'").select(F.monotonically_increasing_id().alias("rec_id"), parts.alias("f"))
    return rows.select("rec_id", *[F.get("f", F.lit(i)).cast(kind).alias(name) for name, (i, kind) in SAM_FIELDS.items()])


def mapped(records: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Records with a place, up to limit."""
    return records.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("pos") <= limit))


def project_cigar(seq: Column, cigar: Column) -> Column:
    """A record's letters on the reference from its start on.

    Inserted and clipped letters are left out of the read, deletions and skips give `-`, clips give `-`, padding
    nothing; a missing letter gives `?`.
    """
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))

    def step(acc: Column, op: Column) -> Column:
        n = F.substring(op, F.lit(1), F.length(op) - 1).cast("int")
        kind = F.substring(op, -1, 1)
        letters = F.rpad(F.substring(seq, acc["at"] + 1, n), n, F.lit("?"))
        out = F.when(kind.isin("M", "=", "X"), letters).when(kind.isin("D", "N", "S", "H"), F.repeat(F.lit("-"), n)).otherwise(F.lit(""))
        moved = F.when(kind.isin("M", "=", "X", "I", "S"), n).otherwise(0)
        return F.struct((acc["at"] + moved).alias("at"), F.concat(acc["out"], out).alias("out"))

    return F.aggregate(ops, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)["out"]


def leading_clip(cigar: Column) -> Column:
    """Letters clipped before the first aligned one, which shift a record's start to the left."""
    clips = F.regexp_extract(cigar, r"^((?:\d+[SH])*)", 1)
    return F.aggregate(F.regexp_extract_all(clips, F.lit(r"(\d+)"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))


def _aligned(records: DataFrame, length: int) -> DataFrame:
    """start (0-based, at the first letter) and letters within the reference."""
    start = F.col("pos") - 1 - leading_clip(F.col("cigar"))
    rows = records.withColumn("_start", start).withColumn("_out", project_cigar(F.col("seq"), F.col("cigar")))
    cut = F.substring("_out", F.greatest(1 - F.col("_start"), F.lit(1)), F.greatest(F.least(F.length("_out"), F.lit(length) - F.col("_start")) - F.greatest(-F.col("_start"), F.lit(0)), F.lit(0)))
    return rows.withColumn("letters", cut).withColumn("start", F.greatest("_start", F.lit(0))).drop("_start", "_out")


def trimmed_reads(records: DataFrame, length: int) -> DataFrame:
    """rec_id, off and letters without `-` at the ends, at least one letter."""
    rows = _aligned(records, length)
    head = F.length(F.regexp_extract("letters", r"^(-*)", 1))
    head = F.least(head, F.greatest(F.length("letters") - 1, F.lit(0)))
    body = F.substring("letters", head + 1, F.length("letters"))
    kept = F.regexp_replace(body, r"(?<=.)-+$", "")
    return rows.withColumn("off", (F.col("start") + head).cast("int")).withColumn("letters", kept).drop("start")


def padded_reads(records: DataFrame, length: int) -> DataFrame:
    """read_id, name and seq over the whole reference; N where the read does not reach."""
    rows = trimmed_reads(records, length)
    seq = F.rpad(F.concat(F.repeat(F.lit("N"), F.col("off")), F.col("letters")), F.lit(length), F.lit("N"))
    return rows.select(F.col("rec_id").alias("read_id"), F.col("qname").alias("name"), seq.alias("seq"))


def pair_mates(records: DataFrame, first_only: bool = False) -> DataFrame:
    """qname, kind, i and j: which records make a read; j is null for a single one.

    records has rec_id, qname, flag, pos, pnext.  A name with one record is a single read.  Of more, a record that is
    not flagged as paired is one by itself (with first_only, the group's first stands for it); paired ones meet where
    each is the other's mate and i does not start after j; a record that meets itself is single, and two different
    records with one start are nothing.
    """
    groups = records.groupBy("qname").agg(F.count(F.lit(1)).alias("size"), F.min("rec_id").alias("first"))
    rows = records.join(groups, "qname")
    alone = F.col("size") == 1
    paired = F.col("flag").bitwiseAND(1) == 1
    unpaired = rows.where(alone | ~paired)
    single = unpaired.select("qname", F.lit("single").alias("kind"), (F.when(~alone, F.col("first")).otherwise(F.col("rec_id")) if first_only else F.col("rec_id")).alias("i"), F.lit(None).cast("long").alias("j"))
    left = rows.where(~alone & paired).select("qname", F.col("rec_id").alias("i"), F.col("pos").alias("ip"), F.col("pnext").alias("inext"))
    right = records.select(F.col("qname").alias("_q"), F.col("rec_id").alias("j"), F.col("pos").alias("jp"), F.col("pnext").alias("jnext"))
    met = left.join(right, (F.col("qname") == F.col("_q")) & (F.col("inext") == F.col("jp")) & (F.col("ip") == F.col("jnext"))).where("ip <= jp")
    itself = met.where("i = j").select("qname", F.lit("single").alias("kind"), "i", F.lit(None).cast("long").alias("j"))
    pairs = met.where("ip < jp").select("qname", F.lit("pair").alias("kind"), "i", "j")
    return single.union(itself).union(pairs)


def short_reads(spark: SparkSession, path: str, limit: int = 1_000_000, first_only: bool = False) -> DataFrame:
    """read_id, name, l, l_off, r and r_off of a SAM file."""
    length = sam_header(spark, path).first()["length"]
    records = mapped(sam(spark, path), limit)
    letters = trimmed_reads(records, length).select("rec_id", "off", "letters")
    made = pair_mates(records, first_only).withColumn("read_id", F.monotonically_increasing_id())
    left = letters.select(F.col("rec_id").alias("i"), F.col("letters").alias("l"), F.col("off").alias("l_off"))
    right = letters.select(F.col("rec_id").alias("j"), F.col("letters").alias("r"), F.col("off").alias("r_off"))
    return made.join(left, "i").join(right, "j", "left").select("read_id", F.col("qname").alias("name"), "l", "l_off", F.coalesce("r", F.lit("")).alias("r"), F.coalesce("r_off", F.lit(-1)).alias("r_off"))


def long_reads(spark: SparkSession, path: str) -> DataFrame:
    """read_id, name and seq, by the file's ending: FASTA for .fas, .fasta and .fa, else SAM or BAM."""
    if PurePosixPath(path).suffix.lower() in (".fas", ".fasta", ".fa"):
        return fasta(spark, path).select("read_id", "name", "seq")
    return padded_reads(sam(spark, path), sam_header(spark, path).first()["length"])
