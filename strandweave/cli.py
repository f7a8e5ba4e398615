"""Command line: one mode a run, as `python -m strandweave.cli -m MODE -in FILE [options]`."""

from __future__ import annotations

import json
import logging
import sys
from dataclasses import asdict, dataclass, fields
from pathlib import PurePosixPath

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave import limits, metrics
from strandweave.operators import graph, pileup
from strandweave.plans import pipelines
from strandweave.plans.samples import Sample
from strandweave.session import ship
from strandweave.sources import text, writers

log = logging.getLogger(__name__)

#: Accepted without effect, for old command lines: Spark's master decides.
WITHOUT_EFFECT = ("threads",)


@dataclass(frozen=True)
class Params:
    """Settings of a run, by option; -x without a value means true, and a value that is no number keeps the default.

    Unknown options are refused. tl: seconds that haplotypes may take once the reads are read.
    """

    m: str = ""
    in_: str = ""
    outDir: str = "strandweave_output/"
    t: int = 10
    tf: float = 0.05
    sp: int = 0
    ep: int = 1_000_000
    os: int = 0
    oe: int = 10_000_000
    cm: str = "accurate"
    el: int = 17_000
    re: float = 0.2
    net: float = -1.0
    cpt: int = -1
    fl: int = -1
    limit: int = 1_000_000
    ignoreDeletion: bool = False
    ignorecomponents: bool = False
    lowQFilter: bool = True
    fdf: str = "short"
    answer: str = ""
    tl: int = 10_800
    firstOnly: bool = False
    rn: bool = False
    filter: bool = False
    addFnedges: bool = False
    log: bool = False

    @staticmethod
    def parse(argv: list[str]) -> Params:
        given: dict[str, str] = {}
        i = 0
        while i < len(argv):
            name = argv[i].lstrip("-")
            if i + 1 < len(argv) and not argv[i + 1].startswith("-"):
                given[name] = argv[i + 1]
                i += 1
            else:
                given[name] = "true"
            i += 1
        known = {f.name.rstrip("_") for f in fields(Params)}
        if unknown := sorted(given.keys() - known - set(WITHOUT_EFFECT)):
            raise SystemExit(f"unknown options: {', '.join('-' + name for name in unknown)}\n{usage()}")
        for name in sorted(given.keys() & set(WITHOUT_EFFECT)):
            log.warning("-%s has no effect: Spark's master decides", name)
        values: dict[str, object] = {}
        for f in fields(Params):
            raw = given.get(f.name.rstrip("_"))
            if raw is None:
                continue
            kind = type(f.default)
            try:
                values[f.name] = raw.lower() == "true" if kind is bool else kind(raw)
            except ValueError:
                log.warning("%s is no %s for -%s; %s is taken", raw, kind.__name__, f.name.rstrip("_"), f.default)
        return Params(**values)

    def settings(self) -> dict[str, str]:
        return {k.rstrip("_"): str(v) for k, v in asdict(self).items()}

    def region(self) -> dict[str, int]:
        return {"start": max(self.sp, 0), "end": self.ep}

    def merging(self) -> dict[str, object]:
        """How cliques are merged."""
        return {"mode": self.cm, "non_edge_rate": self.net if self.net > 0 else None, "by_component": not self.ignorecomponents}


def _name(path: str) -> str:
    return PurePosixPath(path).name.rsplit(".", 1)[0]


def long_sample(spark: SparkSession, p: Params, close: int = 5) -> Sample:
    reads = pipelines.stored(text.long_reads(spark, p.in_))
    length = reads.select(F.max(F.length("seq"))).first()[0] or 0
    return _padded_sample(reads, length, close if p.cpt < 0 else p.cpt).named(reads)


def _padded_sample(reads: DataFrame, length: int, close: int) -> Sample:
    """Of stored reads (read_id, seq) that N pads to one length."""
    off, body = pileup.known_letters(F.col("seq"))
    pile = pileup.explode_reads(reads.withColumn("off", F.lit(0)))
    inner = pileup.explode_reads(reads.select("read_id", off.alias("off"), body.alias("seq")))
    return Sample(pipelines.stored(pile), pipelines.stored(pileup.padded_shapes(reads)), length, True, 0.1, close, inner=inner)


def short_sample(spark: SparkSession, p: Params) -> Sample:
    """Profile and consensus come from the mates as they are, cells from merged ones."""
    pairs = pipelines.stored(text.short_reads(spark, p.in_, p.limit, p.firstOnly))
    length = pileup.read_stats(pairs).first()["reference_length"] or 0
    both = lambda frame: frame.select("read_id", F.col("l").alias("seq"), F.col("l_off").alias("off")).union(frame.where("r_off >= 0").select("read_id", "r", "r_off"))
    merged = pipelines.stored(pileup.merge_overlaps(pairs))
    before = Sample(pileup.explode_reads(both(pairs)), pileup.shapes(pairs), length, False, p.re)
    # In samples of single reads mostly, the ratio alone links only what lies well within a read.
    single = pileup.read_stats(pairs).first()["single_read"]
    reach = 0.8 * (p.fl if p.fl > 0 else pileup.fragment_length(pairs, length).first()["fragment_length"]) if single else None
    return Sample(pipelines.stored(pileup.explode_reads(both(merged))), pipelines.stored(pileup.shapes(merged)), length, False, p.re, max(p.cpt, 0), before.majors, lambda: both(merged), p.ignoreDeletion, reach).named(pairs)


def _cells(rows: DataFrame, key: str) -> DataFrame:
    """key, pos and allele of the strings seq."""
    return rows.select(key, F.posexplode(F.split("seq", "")).alias("pos", "allele"))


def _truth(spark: SparkSession, p: Params) -> DataFrame:
    """truth (ordered as in the file), pos and allele of the haplotypes of the FASTA file that -answer names."""
    return _cells(text.fasta(spark, p.answer).withColumnRenamed("read_id", "truth"), "truth")


def _report(spark: SparkSession, p: Params, found: pipelines.Found, figures: dict | None = None) -> None:
    name = _name(p.in_)
    frame = found.frame(spark)
    writers.write_text(writers.fasta_lines(frame, name, p.fdf, p.os, p.oe if p.oe < 10_000_000 else None), f"{p.outDir}/{name}.fasta")
    rows = [{"frequency": r["frequency"], "name": f"{i}_fr_{r['frequency']}", "snps": r["snps"], "sourceClique": r["source"], "haplotype": r["haplotype"]} for i, r in enumerate(found.rows)]
    made = spark.createDataFrame([(writers.result_json(rows, p.settings(), found.error, found.code, figures),)], "value string")
    writers.write_text(made, f"{p.outDir}/{name}.json")


def haplotypes(spark: SparkSession, p: Params, long_reads: bool) -> pipelines.Found:
    """A run over its limit, or one whose graph is too dense, reports the consensus, with the error beside it.

    The short mode gives the error a code, 4 or 6; the long one says it in words only.
    """
    sample = long_sample(spark, p) if long_reads else short_sample(spark, p)
    settings, figures = p.region() | p.merging(), None
    try:
        with limits.time_limit(spark, p.tl), metrics.collected() as notes:
            if long_reads:
                found = pipelines.long_haplotypes(sample, p.t, p.tf, quality_filter=p.lowQFilter, **settings)
            else:
                truth = _truth(spark, p) if p.answer and p.addFnedges else None
                found = pipelines.short_haplotypes(sample, p.t, p.tf, fragment=p.fl if p.fl > 0 else None, recombinations=not p.filter, truth=truth, **settings)
        figures = metrics.values(notes)
    except limits.TimeLimitError:
        log.exception("the time limit has been reached")
        found = pipelines.default_haplotype(sample, "Timeout reached", 0 if long_reads else 4)
    except PythonException as error:
        if graph.TOO_DENSE not in str(error):
            raise
        log.exception("the graph is too dense")
        found = pipelines.default_haplotype(sample, str(error), 0 if long_reads else 6)
    _report(spark, p, found, figures)
    if p.rn and found.assigned is not None:
        lines = writers.read_name_lines(found.frame(spark), found.assigned, sample.names, _name(p.in_), p.fdf)
        lines.write.mode("overwrite").text(f"{p.outDir}/{_name(p.in_)}_read_names")
    return found


def variants(spark: SparkSession, p: Params, long_reads: bool) -> None:
    """The long mode takes all settings of its haplotypes; the short one doesn't merge cliques."""
    sample = long_sample(spark, p) if long_reads else short_sample(spark, p)
    if long_reads:
        called = pipelines.long_variants(sample, p.t, p.tf, **p.region(), **p.merging())
    else:
        called = pipelines.short_variants(sample, p.t, p.tf, p.el, **p.region())
    writers.write_text(writers.vcf_lines(writers.vcf_rows(called, sample.majors, p.os, p.oe)), f"{p.outDir}/{_name(p.in_)}.vcf")


def consensus(spark: SparkSession, p: Params, long_reads: bool) -> None:
    sample = long_sample(spark, p) if long_reads else short_sample(spark, p)
    row = pileup.consensus_string(sample.majors).select(F.lit(0).alias("rank"), F.col("consensus").alias("haplotype"), F.lit(0.0).alias("frequency"))
    writers.write_text(writers.fasta_lines(row, _name(p.in_)), f"{p.outDir}/{_name(p.in_)}_consensus.fasta")


def profile(spark: SparkSession, p: Params, long_reads: bool) -> None:
    sample = long_sample(spark, p) if long_reads else short_sample(spark, p)
    counts = sample.counts.where("allele <> 'N'") if long_reads else sample.counts
    writers.write_text(pileup.profile_matrix(counts).orderBy("row_no").select("line"), f"{p.outDir}/{_name(p.in_)}_profile.tsv")


def imputation(spark: SparkSession, p: Params) -> None:
    """Each file of a folder is a sample."""
    reads = pipelines.stored(text.lines(spark, p.in_))
    for row in reads.select("sample").distinct().orderBy("sample").toLocalIterator():
        own = reads.where(F.col("sample") == row["sample"])
        length = own.select(F.max(F.length("seq"))).first()[0] or 0
        sample = _padded_sample(own, length, 0)
        filled = pipelines.impute(sample, p.t, p.tf).orderBy("read_id").select("value")
        filled.write.mode("overwrite").text(f"{p.outDir}/{row['sample']}_imputed")


def check_answer(spark: SparkSession, p: Params, found: pipelines.Found) -> DataFrame:
    """truth, result, distance and found, against the haplotypes of a FASTA file."""
    truth = _cells(text.fasta(spark, p.answer).withColumnRenamed("name", "truth"), "truth")
    results = _cells(spark.createDataFrame([(i, r["haplotype"]) for i, r in enumerate(found.rows)], "result int, seq string"), "result")
    return pipelines.nearest_results(truth, results)


def replay(spark: SparkSession, p: Params) -> None:
    """One run for each line of options in a file."""
    for row in spark.read.text(p.in_).where("trim(value) <> ''").toLocalIterator():
        run(spark, Params.parse(row["value"].split()))


MODES = {"snv-pacbio": (haplotypes, True), "snv-illumina": (haplotypes, False), "snv-pacbio-vc": (variants, True), "snv-illumina-vc": (variants, False), "consensus-pacbio": (consensus, True), "consensus-illumina": (consensus, False), "profile-pacbio": (profile, True), "profile-illumina": (profile, False)}


def usage() -> str:
    return f"{__doc__}\nModes: {', '.join([*MODES, 'imputation', 'test'])}\nOptions: {', '.join('-' + f.name.rstrip('_') for f in fields(Params))}"


def run(spark: SparkSession, p: Params) -> None:
    ship(spark)
    if p.m in MODES:
        function, long_reads = MODES[p.m]
        found = function(spark, p, long_reads)
        if p.answer and found is not None:
            print(json.dumps([r.asDict() for r in check_answer(spark, p, found).collect()]))
    elif p.m == "imputation":
        imputation(spark, p)
    elif p.m == "test":
        replay(spark, p)
    else:
        raise SystemExit(usage())


if __name__ == "__main__":
    options = Params.parse(sys.argv[1:])
    logging.basicConfig(level=logging.INFO if options.log else logging.WARNING)
    run(SparkSession.builder.getOrCreate(), options)
