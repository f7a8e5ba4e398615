"""The quality model, audio columns and the pipeline."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandweave.llm import audio, quality


@pytest.mark.parametrize(("order", "broadcast_ids"), [(3, 1000), (2, 10)])
def test_model_against_a_plain_one(spark, order, broadcast_ids):
    """Probabilities of every n-gram, worked out with dictionaries."""
    rng = np.random.default_rng(2)
    words = ["the", "of", "and", "cat", "sat"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(3, 15))), "en") for i in range(80)] + [(500, None, "en"), (501, "the cat", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(60)] + [(None,), (3,)], "doc_id long")
    found = {r["doc_id"]: r for r in quality.perplexities(frame, trusted, order=order, broadcast_ids=broadcast_ids).collect()}
    assert len(found) == len(docs)
    assert found[501]["perplexity"] is None
    held = {i for i, r in found.items() if r["held_out"]}
    assert held <= set(range(60))
    assert 5 < len(held) < 35

    size = quality.FIRST_WORD + len(words)
    lines = {i: [quality.START, quality.START, *((t or "").split()), quality.END] for i, t, _ in docs}
    three = Counter(g for i in range(60) if i not in held for g in zip(lines[i], lines[i][1:], lines[i][2:], strict=False))

    def discounts(counts):
        n = [0, *(sum(v == k for v in counts.values()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        return [max(0.1, min(k - 0.1, k - (k + 1) * y * n[k + 1] / n[k] if n[k] and y is not None else k * 0.5)) for k in (1, 2, 3)]

    two, one = Counter(g[1:] for g in three), Counter()
    if order == 2:
        two = Counter(g for i in range(60) if i not in held for g in zip(lines[i][1:], lines[i][2:], strict=False))
    for g in two:
        one[g[1:]] += 1

    def share(counts, gram, below):
        d = discounts(counts)
        mine = {g: v for g, v in counts.items() if g[:-1] == gram[:-1]}
        total = sum(mine.values())
        if not total:
            return below
        own = counts[gram] - d[min(counts[gram], 3) - 1] if counts[gram] else 0.0
        return own / total + sum(d[min(v, 3) - 1] for v in mine.values()) / total * below

    def logp(g):
        p = share(two, g[1:], share(one, g[2:], 1 / size))
        return math.log(share(three, g, p) if order == 3 else p)

    for i, line in lines.items():
        if i != 501:
            grams = list(zip(line, line[1:], line[2:], strict=False))
            assert abs(found[i]["perplexity"] - math.exp(-sum(map(logp, grams)) / len(grams))) < 1e-6 * found[i]["perplexity"]


def test_rare_words_have_symbols(spark):
    """Words of the same form: those that trusted text has, however rare, are likelier than those that it lacks."""
    rng = np.random.default_rng(8)
    seen, other = [f"se{i:04d}" for i in range(2000)], [f"ot{i:04d}" for i in range(2000)]
    docs = [(i, " ".join(rng.choice(seen, 100))) for i in range(300)] + [(1000, " ".join(seen[:100])), (1001, " ".join(other[:100]))]
    frame = spark.createDataFrame([(i, "the " * 60_000 + t if i == 0 else t, "en") for i, t in docs], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(frame, spark.range(0, 300)).collect()}
    assert found[1001] > 2 * found[1000]


def test_blocks_and_other_languages_do_not_change_a_model(spark):
    """The same rows, clustered by language, mixed in one block, or without the larger language."""
    rng = np.random.default_rng(9)
    words = {lang: [f"{lang}{i:03d}" for i in range(400)] for lang in ("aa", "bb")}
    docs = [(i, " ".join(rng.choice(words[lang], 100)), lang) for i, lang in enumerate(["aa"] * 30 + ["bb"] * 120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = []
    for rows in (frame.coalesce(1), frame.repartitionByRange(5, "doc_id"), frame.orderBy("text").coalesce(2), frame.where("lang = 'aa'")):
        made = quality.perplexities(rows, spark.range(0, 140)).where("lang = 'aa'").collect()
        found.append({r["doc_id"]: r["perplexity"] for r in made})
    assert len(found[0]) == 30
    for other in found[1:]:
        assert found[0].keys() == other.keys()
        assert all(abs(other[i] - p) < 1e-6 * p for i, p in found[0].items())


@pytest.mark.parametrize("order", [2, 3])
def test_rounds_do_not_change_a_model_and_free_what_they_shuffle(spark, sf_dir, order):
    """The same perplexities whatever the rounds; the files that were shuffled are gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    shuffled = lambda: {f for f in local.rglob("shuffle_*.data") if f.stat().st_size > 20_000}
    before, found = shuffled(), []
    for options in ({"rounds": 1}, {"rounds": 5, "files": True}, {"rounds": 2, "files": True, "parts": 3}):
        found.append({r["doc_id"]: (r["perplexity"], r["held_out"]) for r in quality.perplexities(docs, trusted, order=order, **options).collect()})
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == docs.count()
    until = time.time() + 20  # files are deleted behind the caller's back
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before


def test_junk_goes_and_clean_text_stays(spark):
    rng = np.random.default_rng(4)
    clean = lambda: " ".join(rng.choice(["the", "of", "house", "river", "walks", "over", "a", "small"], 60)) + "."
    docs = [(i, clean()) for i in range(150)] + [(1000 + i, " ".join(rng.choice(["%%%", "||", "&&x", "###1"], 60))) for i in range(20)] + [(2000, None), (2001, "")]
    frame = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    rows = quality.classify(frame, spark.range(0, 90).withColumnRenamed("id", "doc_id")).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert len(rows) == len(docs)
    assert not kept & set(range(1000, 1020))
    assert len(kept & set(range(150))) >= 145
    assert {2000, 2001} <= kept


def test_quality_of_nothing_and_without_trust(spark, odd, empty):
    nobody = spark.createDataFrame([], "doc_id long")
    assert quality.classify(empty, nobody).count() == 0
    assert all(r["kept"] for r in quality.classify(odd, nobody).collect())
    assert quality.classify(odd, odd.select("doc_id")).count() == odd.count()


def test_audio(odd, rows):
    made = audio.audio_columns(odd).collect()
    expected = []
    for i, t in rows:
        raw = t.encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        expected.append((str(i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in made) == sorted(expected)
    same = {}
    for r in made:
        assert len(r["media"]) == r["media_bytes"]
        assert hashlib.sha256(audio.from_wav(bytes(r["media"]))).hexdigest() == r["payload_sha256"]
        assert same.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
        table = pa.ipc.open_stream(bytes(r["features"])).read_all()
        assert table.schema.field("log_mel").type.shape == [32, 40]
        assert sum(table.column("n_frames").to_pylist()) == int(r["feature"].split(";")[0].split("=")[1])
    assert audio.audio_columns(odd.where("1 = 0")).count() == 0


def test_resampling_keeps_a_tone():
    spec = audio.AudioSpec()
    x = np.sin(2 * np.pi * 300 * np.arange(8000) / spec.rate).astype(np.float32)
    y = audio.resample(x, spec)
    assert len(y) == -(-8000 * spec.up // spec.down)
    peak = np.argmax(np.abs(np.fft.rfft(y[200:5200])))
    assert abs(peak * spec.out_rate / 5000 - 300) < 3
    assert abs(np.abs(y[500:4500]).max() - 1) < 0.05


def test_hysteresis():
    energy = np.array([0, 0, 5, 1, 1, 0, 0, 1, 1, 5, 0], dtype=float)
    assert audio.segments(energy, audio.AudioSpec(high=4, low=0.5)).tolist() == [[2, 3], [9, 10]]
    assert audio.segments(energy - 1, audio.AudioSpec(high=4, low=-0.5)).tolist() == [[2, 5], [9, 10]]


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    assert docs.select("doc_id").distinct().count() == spark.read.parquet(str(tmp_path / "suffix_dedup")).count() < seen
    kept = spark.read.parquet(str(tmp_path / "exact_dedup"))
    assert kept.selectExpr("regexp_replace(text, '[ \\\\t-\\\\r]', '') AS t").distinct().count() == kept.count()


def test_filters_against_brute_force(spark, sf_dir):
    """Which documents the exact and near filters keep, worked out over all pairs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), i))
    kept = sorted(min(g)[1] for g in groups.values())
    exact = corpus_pipeline.exact_filter(spark, docs, sf_dir).cache()
    assert sorted(r["doc_id"] for r in exact.select("doc_id").collect()) == kept

    texts = dict(rows)
    sets = {}
    for i in kept:
        words = texts[i].lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    up = {i: i for i in kept}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in kept:
        for b in kept:
            both = len(sets[a] & sets[b])
            if a < b and (both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    near = corpus_pipeline.near_filter(spark, exact, sf_dir)
    assert sorted(r["doc_id"] for r in near.select("doc_id").collect()) == [i for i in kept if find(i) == i]


def test_stages_take_odd_rows(spark, odd, sf_dir):
    """Null and repeated ids, null and empty texts, clashing columns, and no rows at all."""
    for docs in (odd, odd.where("1 = 0")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf_dir)
            if name != "packing":
                assert made.columns == corpus_pipeline.COLUMNS
                assert made.count() <= n
                assert n == 0 or made.where("doc_id IS NULL").count() > 0
            else:
                assert (made.count() == 0) == (n == 0)
