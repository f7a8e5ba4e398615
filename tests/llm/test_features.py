"""Audio features against direct sums, thresholds of the quality classifier against plain ones, texts above a block."""

import math

import numpy as np
import pytest

from strandweave.llm import audio, exact_dedup, language, packing, periods, quality, queries, resampling, sharding, token_counts
from strandweave.llm import frames as fr


def direct_resample(x, spec):
    """Zeros between the samples, the low-pass filter over all of them, and every down-th of the result."""
    h = audio.phases(spec).T.ravel().astype(np.float64)
    wide = np.zeros(len(x) * spec.up)
    wide[:: spec.up] = x
    return np.convolve(wide, h)[: len(wide)][:: spec.down]


def direct_log_mels(y, spec):
    n = max(1, math.ceil((len(y) - spec.frame) / spec.hop) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * spec.hop + spec.frame)])
    t, f = np.arange(spec.frame), np.arange(spec.frame // 2 + 1)
    wave = np.exp(-2j * np.pi * np.outer(f, t) / spec.frame)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / spec.frame)
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    top = spec.rate * spec.up / spec.down / 2
    edges = [700 * (10 ** (mel(top) * k / (spec.mels + 1) / 2595) - 1) for k in range(spec.mels + 2)]
    rows = []
    for k in range(n):
        power = np.abs(wave @ (y[k * spec.hop : k * spec.hop + spec.frame] * window)) ** 2
        row = []
        for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
            weight = [max(0.0, min((hz - a) / (b - a), (c - hz) / (c - b))) for hz in f * top / (spec.frame // 2)]
            row.append(math.log(float(power @ np.array(weight)) + 1e-6))
        rows.append(row)
    return np.array(rows)


def direct_segments(energy, spec):
    level, on, out = float(np.median(energy)), None, []
    for k, e in enumerate([*energy, -math.inf]):
        if on is None and e >= level + spec.high:
            on = k
        elif on is not None and e < level + spec.low:
            out.append([on, k])
            on = None
    return out


@pytest.mark.parametrize("size", [1, 255, 384, 2000, 9000])
def test_features_against_direct_sums(size):
    spec = audio.AudioSpec()
    rng = np.random.default_rng(size)
    payload = rng.integers(0, 256, size).astype(np.uint8)
    payload[size // 3 : size // 2] = 128
    x = (payload.astype(np.float64) - 128) / 128
    y = audio.resample(x.astype(np.float32), spec)
    assert np.allclose(y, direct_resample(x, spec)[: len(y)], atol=1e-5)
    assert len(y) == math.ceil(size * spec.up / spec.down)
    mels, energy = audio.log_mels(y, spec)
    want = direct_log_mels(y.astype(np.float64), spec)
    assert np.allclose(mels, want, atol=5e-3)
    assert audio.segments(energy, spec).tolist() == direct_segments(energy, spec)
    text = dict(part.split("=") for part in audio.features(payload.tobytes(), spec)[1].split(";"))
    spans = direct_segments(energy, spec)
    assert (int(text["frames"]), int(text["segments"]), int(text["active"])) == (len(want), len(spans), sum(b - a for a, b in spans))
    assert np.allclose([float(v) for v in text["mel"].split(",")], want.mean(axis=0), atol=0.06)


def test_thresholds_against_plain_ones(spark):
    rng = np.random.default_rng(4)
    words = {"en": ["the", "of", "and", "cat", "sat"], "de": ["der", "die", "und", "katze"]}
    docs = [(i, " ".join(rng.choice(words[lang], rng.integers(1, 40)) if i % 9 else [f"{x}" for x in rng.integers(0, 99, 12)]), lang) for lang in words for i in range(500 * (lang == "de"), 500 * (lang == "de") + 120)]
    frame = spark.createDataFrame([*docs, (9000, "", "en"), (9001, "the of", "xx")], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i, _, _ in docs if i % 9 and i % 2], "doc_id long")
    scored = {r["doc_id"]: r for r in quality.perplexities(frame, trusted).collect()}
    found = {r["doc_id"]: r for r in quality.classify(frame, trusted, quantile=0.9, margin=1.1, prior_words=20.0).collect()}
    assert len(found) == len(docs) + 2
    for lang in words:
        held = [r for r in scored.values() if r["lang"] == lang and r["held_out"]]
        assert len(held) > 5
        size = sum(r["n_words"] + 1 for r in held)
        mean = sum(math.log(r["perplexity"]) * (r["n_words"] + 1) for r in held) / size
        score = lambda r: math.exp((math.log(r["perplexity"]) * (r["n_words"] + 1) + mean * 20) / (r["n_words"] + 21))  # noqa: B023, E731
        limit = sorted(score(r) for r in held)[math.ceil(0.9 * len(held)) - 1] * 1.1
        own = [r for r in found.values() if r["lang"] == lang]
        for r in own:
            assert r["score"] == pytest.approx(score(scored[r["doc_id"]]), abs=2e-6)
            assert r["threshold"] == pytest.approx(limit, rel=1e-3)
            assert r["kept"] == (r["score"] <= r["threshold"] or r["n_words"] == 0)
        assert 0 < sum(r["kept"] for r in own) < len(own)
    assert found[9000]["kept"]
    assert (found[9001]["kept"], found[9001]["threshold"]) == (True, None)


def test_texts_above_a_block(spark):
    """One text of 5 MB between two short ones, through the operators that work within documents."""
    unit = "the cat sat on a mat and looked at 7 dogs. "
    long = unit * (5_000_000 // len(unit))
    assert len(long) > fr.BLOCK_BYTES
    frame = spark.createDataFrame([(1, unit, "en"), (2, long, "en"), (3, unit, "de")], "doc_id long, text string, lang string").coalesce(1)
    words = len(long.split())
    runs = {r["doc_id"]: r for r in periods.find_runs(frame).collect()}
    assert [tuple(r) for r in runs[2]["runs"]] == [(0, words, 11)]
    assert runs[2]["collapsed"] == unit.strip()
    weights = {r["doc_id"]: r for r in resampling.weights(frame, np.ones(100, np.int64), 3).collect()}
    assert weights[2]["weight"] == weights[2]["n_features"] == 3 * words - 3
    assert {r["doc_id"] for r in language.identify(frame).collect()} == {1, 2, 3}
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_lengths(frame, queries.TOKENIZER).collect()}
    pieces = packing.pack_documents(frame, queries.TOKENIZER, size=2048, end_id=1).where("doc_id = 2").collect()
    assert sum(r["length"] for r in pieces) == tokens[2] + 1
    assert {r["doc_id"]: r["size"] for r in sharding.shard_documents(frame).collect()}[2] == len(long) + 1
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(frame).collect()} == {1: 1, 2: 2, 3: 1}
    sizes = {r["doc_id"]: r["n_bytes"] for r in audio.audio_columns(frame).select("doc_id", "n_bytes").collect()}
    assert sizes[2] == len(long)
