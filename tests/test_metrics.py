"""Observed figures of a run, and places of rows by ranges."""

import json

from pyspark.sql import functions as F

from strandweave import cli, metrics
from strandweave.plans import pipelines
from strandweave.storage import ranked, stored


def test_figures_come_with_the_stored_frame(spark):
    with metrics.collected() as notes:
        kept = stored(metrics.note(spark.range(1000).repartition(7), "rows", F.count(F.lit(1)).alias("n"), F.max("id").alias("most")))
        stored(metrics.note(spark.range(5), "rows", F.count(F.lit(1)).alias("n")))
    assert metrics.values(notes) == {"rows": [{"n": 1000, "most": 999}, {"n": 5}]}
    assert kept.count() == 1000
    # Nothing is observed outside.
    frame = spark.range(3)
    assert metrics.note(frame, "rows", F.count(F.lit(1)).alias("n")) is frame


def test_result_has_the_figures(spark, tmp_path, monkeypatch):
    path = tmp_path / "s.fas"
    path.write_text("".join(f">r{i}\nACGTACGT\n" for i in range(6)))

    def long_haplotypes(sample, *_, **__):
        stored(metrics.note(sample.pile, "cells", F.count(F.lit(1)).alias("n")))
        return pipelines.default_haplotype(sample)

    monkeypatch.setattr(pipelines, "long_haplotypes", long_haplotypes)
    cli.haplotypes(spark, cli.Params(m="snv-pacbio", in_=str(path), outDir=str(tmp_path / "out")), True)
    report = json.loads(spark.read.text(str(tmp_path / "out" / "s.json"), wholetext=True).first()["value"])
    assert report["metrics"] == {"cells": [{"n": 48}]}


def test_places_by_ranges(spark):
    """Two thirds of the rows have one key."""
    rows = [(i, 7 if i % 3 else i % 50) for i in range(500)]
    frame = spark.createDataFrame(rows, "i long, k long")
    found = {r["i"]: r["place"] for r in ranked(frame, [F.desc("k"), F.asc("i")], "place").collect()}
    assert found == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert ranked(frame.limit(0), [F.col("k")], "place").count() == 0
