"""What Python workers hold while they work and after it."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa

import corpus_pipeline
from strandweave.llm import bpe, frames
from strandweave.llm.queries import TOKENIZER

PINS: list[bytes] = []


def _resident_mb() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def _scatter(mb: int) -> None:
    """Frees so much memory below a small piece that stays, so that the C library keeps it."""
    pieces = [bytes(1000) for _ in range(1000 * mb)]
    PINS.append(bytes(1000))
    del pieces


class _Frame:
    """Stands for a DataFrame: gives the function of its tasks or groups."""

    def __getattr__(self, name):
        return lambda *_: self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run

    applyInPandas = mapInArrow  # noqa: N815


def test_a_worker_does_not_keep_what_a_block_needed(monkeypatch):
    monkeypatch.setattr(frames, "numbered", lambda batches, limit: enumerate(pa.Table.from_batches([b]) for b in batches))
    run = frames.block_rows(_Frame(), lambda table: _scatter(100) or b"packed")
    before = _resident_mb()
    assert [b.to_pylist() for b in run(iter([pa.RecordBatch.from_pydict({"text": ["a"]})]))] == [[{"block": 0, "payload": b"packed"}]]
    assert _resident_mb() - before < 40


def test_a_worker_does_not_keep_what_a_group_needed():
    run = frames.by_part(_Frame(), lambda payloads: [_scatter(250) or x for x in payloads])
    before = _resident_mb()
    assert run(pd.DataFrame({"block": [1], "part": [0], "payload": [b"x"]}))["payload"].tolist() == [b"x"]
    assert _resident_mb() - before < 40


def test_words_are_encoded_in_slices(monkeypatch):
    words = [f" w{k}x{k * k}".encode() for k in range(20_001)] + [b"<|endoftext|>", b" last"]
    tok, special, sizes = bpe.tokenizer(TOKENIZER), bpe.specials(TOKENIZER), []
    tok.encode_special_tokens = True
    whole = [[special[w]] if w in special else tok.encode(w.decode(), add_special_tokens=False).ids for w in words]

    class Counting:
        def encode_batch_fast(self, texts, **options):
            sizes.append(len(texts))
            return tok.encode_batch_fast(texts, **options)

    monkeypatch.setattr(bpe, "tokenizer", lambda path: Counting())
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_words(words, TOKENIZER)] == whole
    assert max(sizes) <= 10_000


def test_stages_send_small_batches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        corpus_pipeline.pack(spark, docs, str(tmp_path))
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == corpus_pipeline.BATCH
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
