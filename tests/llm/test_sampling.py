"""Periodic runs, importance resampling and language identification, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import language, periods, queries, resampling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, exponent=3):
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            own = words[start : start + length]
            if length >= max(least, exponent * q) and not any(own[r:] == own[: length - r] for r in range(1, q)):
                found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_codes():
    rng = np.random.default_rng(3)
    for _ in range(150):
        docs = []
        for _ in range(rng.integers(1, 5)):
            words = rng.integers(0, rng.integers(1, 4), rng.integers(0, 120))
            if len(words) > 30 and rng.random() < 0.7:
                a, p = int(rng.integers(0, len(words))), int(rng.integers(1, 40))
                words = np.array([words[i] if i < a else words[a + (i - a) % p] if a + (i - a) % p < len(words) else 0 for i in range(len(words))])
            docs.append(words)
        at = np.append(0, np.cumsum([len(d) for d in docs]))
        got = periods.runs_of(np.concatenate(docs).astype(np.int64), at)
        want = [(s + int(at[d]), n, q) for d, words in enumerate(docs) for s, n, q in plain_runs(words.tolist())]
        assert list(zip(got.start.tolist(), got.length.tolist(), got.period.tolist(), strict=True)) == want


def test_long_texts_of_few_words():
    same = periods.runs_of(np.zeros(300_000, np.int64), np.array([0, 300_000]))
    assert (same.start.tolist(), same.length.tolist(), same.period.tolist()) == ([0], [300_000], [1])
    wide = periods.runs_of(np.tile(np.arange(70_000), 4), np.array([0, 280_000]))
    assert (wide.start.tolist(), wide.length.tolist(), wide.period.tolist()) == ([0], [280_000], [70_000])
    fib = ["0", "01"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    got = periods.runs_of(np.array([int(c) for c in fib[-1]]), np.array([0, len(fib[-1])]))
    assert list(zip(got.start.tolist(), got.length.tolist(), got.period.tolist(), strict=True)) == plain_runs(list(fib[-1]))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def runs_row(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    share = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, share, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def key(row):
    return tuple((x is not None, x) for x in row)


def test_runs_query(spark, odd, rows, tmp_path):
    """Over whole small tables; ids 30 and 35 among others are planted."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    texts = [(i, t) for i, t in rows if len(WORD.findall(t)) < 1500 or i == 1013]
    want = [runs_row(i, t) for i, t in texts]
    ids = {i for i, _ in texts}
    assert sorted((r for r in found if r[0] in ids), key=key) == sorted(want, key=key)
    assert len(found) == len(rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and w[1] for (i, _), w in zip(texts, want, strict=True) if i is not None)


def test_runs_of_odd_rows(odd, empty, rows):
    found = periods.find_runs(odd).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in rows)
    by = {r["doc_id"]: r for r in found}
    assert (by[1000]["n_words"], by[1000]["runs"], by[1000]["collapsed"]) == (0, [], "")
    assert by[1002]["n_words"] == 0
    assert [tuple(r) for r in by[1006]["runs"]] == [(0, 400, 1)]
    assert by[1006]["collapsed"] == "of"
    assert by[1005]["collapsed"] == next(t for i, t in rows if i == 1003).strip()
    assert periods.find_runs(empty).count() == 0


def test_strongest_run_breaks_ties(spark):
    frame = spark.sql("select array(named_struct('start', 9L, 'length', 6L, 'period', 2L), named_struct('start', 4L, 'length', 9L, 'period', 3L), named_struct('start', 4L, 'length', 6L, 'period', 2L), named_struct('start', 1L, 'length', 5L, 'period', 2L)) r, cast(array() as array<struct<start:long,length:long,period:long>>) e")
    got = frame.select(periods.strongest(F.col("r")).alias("r"), periods.strongest(F.col("e")).alias("e")).first()
    assert tuple(got["r"]) == (4, 6, 2)
    assert got["e"] is None


def features(text, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def test_buckets_of_all_grams():
    texts = ["", " -- ", "a", "A b", "é É ÀÉ 漢字 x" * 3, "x" * 70_000 + " y " + "z" * 300, "one Two two three", "", "b a b a b a"]
    n, found = resampling.buckets_of(pa.array(texts), 3, 10_000)
    for i, text in enumerate(texts):
        words, want = features(text)
        assert n[i] == words
        assert [b for bucket, at in found for b in bucket[at[i] : at[i + 1]].tolist()] == want
    assert resampling.buckets_of(pa.array([], pa.string()), 3, 10)[0].tolist() == []


def test_joined_checksums():
    rng = np.random.default_rng(1)
    parts = [(rng.bytes(rng.integers(0, 50)), rng.bytes(n)) for n in (0, 1, 2, 3, 7, 200, 5000)]
    first, second = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    assert resampling.crc_joined(first, second, np.array([len(b) for _, b in parts])).tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_resampling_query(spark, odd, rows, tmp_path):
    target = ["before word1 is here after", None, "the of and of", ""]
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [tuple(r) for r in queries.op12_importance_resampling(spark, str(tmp_path)).collect()]
    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    total = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * total[0] / ((s[b] + 1) * total[1]))) for b in range(10_000)]

    def score(i, weight):
        if i is None:
            return None
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        return weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    want = [(i, len(f), sum(gain[b] for b in f), n) for i, n, f in own]
    want = [(i, f, w, score(i, w), n) for i, f, w, n in want]
    able = sorted((r for r in want if r[4] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    drawn = 5 * len(able) // 100
    assert drawn >= 2
    assert sorted((r[:4] for r in found), key=key) == sorted((r[:4] for r in want), key=key)
    assert sorted((r[4], r[0]) for r in found if r[4] is not None) == [(k + 1, r[0]) for k, r in enumerate(able[:drawn])]


def test_ranks_over_many_ranges(spark):
    """Half of the rows have one score; ids decide, whatever the ranges."""
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 100).cast("long").alias("score"))
    got = {r["doc_id"]: r["_rank"] for r in resampling.ranked(frame, [F.desc("score"), F.asc("doc_id")]).collect()}
    order = sorted(range(3000), key=lambda i: (-(7 if i % 2 == 0 else i % 100), i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_resampling_of_odd_rows(spark, odd, empty, rows):
    target = spark.createDataFrame([(1, None)], "k int, words string")
    found = resampling.resample(odd, target, percent=50, target_col="words").collect()
    assert len(found) == len(rows)
    assert {(r["n_features"], r["weight"], r["rank"]) for r in found if r["doc_id"] == 1000} == {(0, 0, None)}
    assert resampling.resample(empty, target, target_col="words").count() == 0
    assert resampling.resample(odd, empty).count() == len(rows)


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 200
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)
    sure = [r for r in held if r["accepted"]]
    assert len(sure) > 0.9 * len(held)
    assert np.mean([r["lang_pred"] == r["lang"] for r in sure]) > 0.985


def test_language_takes_the_text_only(spark, odd, empty, rows):
    found = language.identify(odd).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"], r["accepted"]))
    assert by[1000] == by[1001] == by[1002] == [("und", 0.0, False)]
    assert by[1006] == by[1007]
    assert len(by[None]) == 2
    other = odd.where("doc_id is null or pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2")
    changed = odd.withColumn("lang", F.when(F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    again = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(changed).collect()}
    assert again == {(r["doc_id"], r["lang_pred"], r["score"]) for r in found}
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(other).collect()} == {"und"}


def test_subwords_do_not_cross_words():
    bucket, word = language.subwords(["ab", "c"])
    alone = [language.subwords([w])[0].tolist() for w in ("ab", "c")]
    assert [sorted(bucket[word == k].tolist()) for k in (0, 1)] == [sorted(x) for x in alone]
    assert [len(x) for x in alone] == [3 + 2 + 1, 2 + 1]
    assert len(language.subwords([])[0]) == 0


@pytest.mark.parametrize("precision", [0.5, 1.0])
def test_rejection(precision):
    """A threshold is met by the share that it asks for; noise is rejected at a precision of 1."""
    rng = np.random.default_rng(0)
    rows = [{"lang": "ab"[k % 2], "grams": rng.integers(k % 2 * 50 * (k < 150), 100 - 50 * (1 - k % 2) * (k < 150), 20).astype("<u2").tobytes(), "counts": np.ones(20, "<u2").tobytes()} for k in range(200)]
    place = {"a": 0, "b": 1}
    model = language.trained(language.Bags.of(rows[:100], place), ["a", "b"], 5, 0.3)
    bags = language.Bags.of(rows[100:], place)
    made = language.calibrated(model, bags, precision)
    p = made.scores(bags.mean(made.table), bags.size)
    sure = p.max(axis=1) >= made.threshold
    assert sure.any()
    assert (p.argmax(axis=1) == bags.lang)[sure].mean() >= precision
    assert sure.all() == (precision == 0.5)
