"""The time limit, and what the command line makes of its options."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandweave import cli, limits
from strandweave.plans import pipelines


@F.udf(LongType())
def slow(x):
    time.sleep(60)
    return x


def test_jobs_over_the_limit_are_cancelled(spark):
    began = time.time()
    with pytest.raises(limits.TimeLimitError), limits.time_limit(spark, 1.0):
        spark.range(3).select(slow("id")).collect()
    assert time.time() - began < 30
    # Nothing of the limit is left on the session.
    assert spark.range(3).count() == 3
    assert not spark.sparkContext.getJobTags()


def test_quick_parts_and_other_errors_pass(spark):
    with limits.time_limit(spark, 100.0):
        assert spark.range(3).count() == 3
    with pytest.raises(KeyError), limits.time_limit(spark, 100.0):
        raise KeyError("x")


def reads_file(tmp_path):
    base = "ACGTACGTACGTACGTACGTACGTACGTAC"
    other = base[:4] + "G" + base[5:15] + "C" + base[16:]
    path = tmp_path / "s.fas"
    path.write_text("".join(f">r{i}\n{base if i % 3 else other}\n" for i in range(60)))
    return base, path


@pytest.mark.parametrize(("long_reads", "code"), [(True, 0), (False, 4)])
def test_run_over_its_limit_gives_the_consensus(spark, tmp_path, monkeypatch, long_reads, code):
    base, path = reads_file(tmp_path)

    def stage(sample, *_, **__):
        return sample.pile.select(slow("read_id")).collect()

    monkeypatch.setattr(pipelines, "long_haplotypes" if long_reads else "short_haplotypes", stage)
    if not long_reads:
        monkeypatch.setattr(cli, "short_sample", cli.long_sample)
    began = time.time()
    found = cli.haplotypes(spark, cli.Params(m="x", in_=str(path), outDir=str(tmp_path / "out"), tl=1, rn=True), long_reads)
    assert time.time() - began < 45
    assert (found.error, found.code) == ("Timeout reached", code)
    assert [(r["haplotype"], r["frequency"]) for r in found.rows] == [(base, 1.0)]
    report = json.loads(spark.read.text(str(tmp_path / "out" / "s.json"), wholetext=True).first()["value"])
    assert report["errorCode"] == code


def test_unknown_options_are_refused(caplog):
    with pytest.raises(SystemExit, match="-bogus, -noSNPlog"):
        cli.Params.parse(["-m", "snv-pacbio", "-noSNPlog", "-bogus", "1"])
    assert cli.Params.parse(["-threads", "4", "-tl", "5"]).tl == 5
    assert "-threads has no effect" in caplog.text


@pytest.mark.parametrize("long_reads", [True, False])
def test_variants_take_the_settings(spark, tmp_path, monkeypatch, long_reads):
    """Region and merging of the long mode, region of the short one."""
    seen = {}

    def called(sample, *given, **settings):
        seen.update(settings)
        return spark.createDataFrame([], "pos int, allele string, freq double, alleles int, corrected double")

    monkeypatch.setattr(pipelines, "long_variants" if long_reads else "short_variants", called)
    monkeypatch.setattr(cli, "short_sample", cli.long_sample)
    _, path = reads_file(tmp_path)
    cli.run(spark, cli.Params.parse(["-m", "snv-pacbio-vc" if long_reads else "snv-illumina-vc", "-in", str(path), "-outDir", str(tmp_path / "out"), "-sp", "3", "-ep", "20", "-cm", "fast", "-net", "0.3", "-ignorecomponents"]))
    merging = {"mode": "fast", "non_edge_rate": 0.3, "by_component": False}
    assert seen == {"start": 3, "end": 20} | (merging if long_reads else {})


def test_region_bounds_long_variants(spark, tmp_path):
    """Both SNPs are called over the whole reference; the linked pair is gone where only one of them lies inside."""
    _, path = reads_file(tmp_path)
    calls = {}
    for end in (29, 10):
        cli.run(spark, cli.Params.parse(["-m", "snv-pacbio-vc", "-in", str(path), "-outDir", str(tmp_path / f"o{end}"), "-ep", str(end)]))
        lines = spark.read.text(str(tmp_path / f"o{end}" / "s.vcf")).where("value NOT LIKE '#%'").collect()
        calls[end] = sorted(int(r["value"].split("\t")[1]) for r in lines)
    assert calls == {29: [5, 16], 10: []}
