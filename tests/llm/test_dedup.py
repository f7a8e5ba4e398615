"""Exact, near and substring deduplication and sharding against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandweave.llm import components, exact_dedup, fm_index, sharding, simhash, suffix_array
from strandweave.llm import frames as fr
from strandweave.llm.queries import OP6, OP9, OP10

LOW = -(1 << 63)


def test_exact(odd, rows):
    made = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(odd, hot_share=4).collect())
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), math.inf if doc_id is None else doc_id, doc_id))
    expected = []
    for doc_id, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text)
        keep = min(groups[key], key=lambda x: x[:2])[2]
        expected.append((str(doc_id), str(keep), len(groups[key]), doc_id == keep, hashlib.sha256(key.encode()).hexdigest()))
    assert made == sorted(expected)


def test_exact_of_nothing(empty):
    assert exact_dedup.exact_groups(empty).count() == 0


def test_sharding(odd, rows):
    made = sharding.shard_documents(odd, 16).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in made) == sorted((str(i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows)
    for s in range(16):
        assert sorted(r["slot"] for r in made if r["shard"] == s) == list(range(sum(r["shard"] == s for r in made)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in made)
    assert len({r["shard"] for r in made if r["doc_id"] is None}) == 1
    assert sharding.shard_documents(odd.where("1 = 0"), 16).count() == 0


def test_weights(spark):
    keys = spark.range(20_000)
    counts = {r["shard"]: r["count"] for r in sharding.shard(keys, "id", [1.0, 3.0, 0.0, 1.0]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 3}
    assert abs(counts[1] / 20_000 - 0.6) < 0.02
    grown = sharding.shard(sharding.shard(keys, "id", [1.0, 1.0], "a"), "id", [1.0, 1.0, 1.0], "b")
    assert grown.where("a <> b AND b <> 2").count() == 0


def brute_groups(found, radius):
    ids = sorted(found, key=lambda x: x[0])
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sum(int(x).bit_count() for x in ids[a][1] ^ ids[b][1]) <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, ids[find(i)][0]) for i, (d, _) in enumerate(ids))


def test_fingerprints(rows):
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert int(simhash.fingerprint(text)[0]) == expected


def test_near_groups(odd, rows):
    made = sorted((LOW if r["doc_id"] is None else r["doc_id"], LOW if r["component_id"] is None else r["component_id"]) for r in simhash.near_groups(odd).collect())
    assert made == brute_groups([(LOW if i is None else i, simhash.fingerprint(t)) for i, t in rows], 2)
    assert simhash.near_groups(odd.where("1 = 0")).count() == 0


def test_rows_of_hot_groups_come_back(spark):
    """A third of the rows has one key, and another hot one is spread to a key that a group has."""
    keys = ["a" if i % 3 else "b" if i % 2 else f"{i}" for i in range(600)]
    rows = spark.createDataFrame([(i, k.encode(), 5) for i, k in enumerate(keys)], "doc_id long, k binary, x int")
    groups = fr.stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")))
    for share in (4, 1024):
        found = fr.join_groups(rows, groups, "k", "n", "doc_id", share).collect()
        assert sorted((r["doc_id"], r["n"], r["first"], r["x"]) for r in found) == [(i, keys.count(k), keys.index(k), 5) for i, k in enumerate(keys)]
    assert fr.join_groups(rows.limit(0), fr.stored(groups.limit(0)), "k", "n", "doc_id").count() == 0


@pytest.mark.parametrize(("words", "radius"), [(1, 0), (1, 2), (1, 7), (3, 20)])
def test_bit_slices(words, radius):
    rng = np.random.default_rng(words * radius)
    fps = rng.integers(0, 1 << 63, (40, words)).astype(np.uint64)
    fps = np.concatenate([fps, fps ^ (np.uint64(1) << rng.integers(0, 64, (40, words)).astype(np.uint64)), fps[:5]])
    group = np.sort(rng.integers(0, 3, len(fps)))
    found = {tuple(sorted(map(int, p))) for left, right in simhash.close_rows(fps, group, radius, slice_size=7) for p in zip(left, right, strict=True)}
    expected = {(a, b) for b in range(len(fps)) for a in range(b) if group[a] == group[b] and np.bitwise_count(fps[a] ^ fps[b]).sum() <= radius}
    assert found == expected


def test_stretches_hide_all_differences():
    masks = simhash.stretches(2, 2)[:, 0]
    for a in range(64):
        for b in range(64):
            assert ((masks & np.uint64((1 << a) | (1 << b))) == 0).any()


def test_similar_texts_share_a_group(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    other = [f"v{i * 104729 % 1000}" for i in range(400)]
    edited = [*words[:200], "changed", *words[201:]]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(other)), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(frame, width=5, similarity=0.8).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_links_have_the_similarity(spark):
    """Texts about the limit: no link below it, and nearly all above it, against brute force on the sets."""
    rng = np.random.default_rng(12)
    docs = []
    for base in range(150):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
        other = list(words)
        for at in range(5, 5 + 10 * (3 + base % 12), 10):
            other[at] = f"x{base}"
        docs += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(other))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in docs}
    close = {b for b in range(150) if len(sets[2 * b] & sets[2 * b + 1]) >= 0.8 * len(sets[2 * b] | sets[2 * b + 1])}
    assert 30 < len(close) < 120
    made = simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), width=5, similarity=0.8).where("group_size > 1").collect()
    found = {r["doc_id"] // 2 for r in made}
    assert all(r["component_id"] // 2 == r["doc_id"] // 2 for r in made)
    assert found <= close
    assert len(found) >= 0.95 * len(close)
    print("recall", len(found), len(close))
    cut = simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), width=5, similarity=0.8, meeting_shingles=400).where("group_size > 1").collect()
    assert sorted(cut) == sorted(made)


def test_cut_meetings_keep_all_pairs(spark):
    """A meeting of many shingles is cut so that all pairs still meet and no piece is much larger than asked; others stay whole."""
    rows = [(0, 7, 0, 0, i, bytes([i % 256]), 100) for i in range(300)] + [(1, 7, 0, 1, i, b"x", 100) for i in range(3)]
    met = spark.createDataFrame(rows, "band int, key long, a int, b int, node long, fp binary, size long")
    pieces = {}
    for r in simhash.cut_meetings(met, 6000).collect():
        pieces.setdefault(tuple(r[c] for c in simhash.CUT), set()).add(r["node"])
    assert pieces.pop((1, 7, 0, 1, 0, 0)) == {0, 1, 2}
    together = {(x, y) for nodes in pieces.values() for x in nodes for y in nodes}
    assert len(together) == 300 * 300
    assert max(map(len, pieces.values())) * 100 < 1.7 * 6000


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 201), (201, 200)]
    found = {tuple(r) for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {(i, 0) for i in range(61)} | {(200, 200), (201, 200)}


def order(doc_id):
    return LOW if doc_id is None else doc_id


def test_words(odd, rows):
    docs = [(order(i), re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows]
    first = {}
    for n, (i, words) in enumerate(docs):
        for s in range(len(words) - 19):
            first.setdefault(tuple(words[s : s + 20]), []).append((i, n, s))
    expected = []
    for n, (i, words) in enumerate(docs):
        gone = set()
        for s in range(len(words) - 19):
            if any(j < i or (m == n and p < s) for j, m, p in first[tuple(words[s : s + 20])]):
                gone |= set(range(s, s + 20))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        expected.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for hot_runs in (3, 1000):
        made = fm_index.remove_repeated_words(odd, parts=3, shards=4, hot_runs=hot_runs).collect()
        assert sorted((order(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in made) == sorted(expected)
    assert fm_index.remove_repeated_words(odd.where("1 = 0")).count() == 0


def test_bytes(odd, rows):
    docs = [(order(i), t.encode()) for i, t in rows]
    least = {}
    for i, text in docs:
        for s in range(len(text) - 49):
            key = text[s : s + 50]
            least[key] = min(least.get(key, i), i)
    expected = []
    for i, text in docs:
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - 49):
            if least[text[s : s + 50]] < i:
                gone[s : s + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        expected.append((i, len(text), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(text, np.uint8)[~gone])).hexdigest()))
    for hot_runs in (3, 1000):
        made = suffix_array.remove_repeated_bytes(odd, parts=3, shards=4, hot_runs=hot_runs).collect()
        assert sorted((order(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in made) == sorted(expected)
    for r in made:
        assert len(r["kept_bytes"]) == r["n_bytes"] - r["n_removed"]
        assert len(r["kept_text"].encode()) >= len(r["kept_bytes"])
    assert suffix_array.remove_repeated_bytes(odd.where("1 = 0")).count() == 0


@pytest.mark.parametrize("remove", [fm_index.remove_repeated_words, suffix_array.remove_repeated_bytes])
def test_input_planned_again(spark, sf_dir, tmp_path, remove):
    """The scan is cut otherwise between the call and the action, as when executors come and go."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(12).write.parquet(str(tmp_path / "many"))
    found = []
    for before, after in ((1, 12), (12, 2)):
        spark.conf.set("spark.sql.files.minPartitionNum", before)
        made = remove(spark.read.parquet(str(tmp_path / "many")))
        spark.conf.set("spark.sql.files.minPartitionNum", after)
        found.append(sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in made.collect()))
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found[0] == found[1]


@pytest.mark.parametrize("remove", [fm_index.remove_repeated_words, suffix_array.remove_repeated_bytes])
def test_text_above_a_block(spark, remove):
    """A text of several blocks' bytes, a passage of it elsewhere, and itself again."""
    rng = np.random.default_rng(3)
    long = " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 400_000))
    assert len(long) > 4 << 20
    words = long.split(" ")
    passage = " ".join(words[200_000:200_100])
    frame = spark.createDataFrame([(1, passage), (2, long), (3, long)], "doc_id long, text string")
    made = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in remove(frame).select("doc_id", "n_removed", "n_spans").collect()}
    by_words = remove is fm_index.remove_repeated_words
    assert made[1] == (0, 0)
    assert made[2][1] == 1 and (made[2][0] == 100 if by_words else 0 <= made[2][0] - len(passage) <= 2)
    assert made[3] == (len(words) if by_words else len(long), 1)


def test_suffix_array_and_fm_index():
    rng = np.random.default_rng(5)
    for _ in range(20):
        text = rng.integers(1, 4, 60)
        assert suffix_array.Buckets(text, 1).sort().order.tolist() == sorted(range(60), key=lambda i: [*text[i:].tolist(), 99])  # the end sorts last
        symbols = np.append(rng.integers(1, 6, 80), 0)
        symbols[40] = 0
        index = fm_index.FMIndex(symbols, 6, 3)
        # A sequence that is indexed, and one of which the index holds only parts.
        other = rng.integers(1, 6, 50)
        sequences = np.concatenate([symbols[:40], other])
        place, number, size = index.matches(sequences, np.array([0, 40, 90]))
        wanted = {p: sum(symbols[i : i + 3].tolist() == sequences[p : p + 3].tolist() for i in range(79)) for p in (*range(38), *range(40, 88))}
        assert dict(zip(place.tolist(), size.tolist(), strict=True)) == {p: n for p, n in wanted.items() if n}
        texts = {}
        for p, k in zip(place.tolist(), number.tolist(), strict=True):
            texts.setdefault(k, set()).add(tuple(sequences[p : p + 3].tolist()))
        assert all(len(x) == 1 for x in texts.values()) and len(set.union(*texts.values())) == len(texts)


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_select(share):
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000, 5000):
        bits = rng.random(n) < share
        bits[-1] = True
        own = fm_index.Bits(bits)
        places = np.flatnonzero(bits)
        assert own.select(np.arange(len(places))).tolist() == places.tolist()
        assert own.ones(places).tolist() == list(range(len(places)))


@pytest.mark.parametrize("size", [4, 1000, 50_000])
def test_index_is_compressed(size):
    """The index takes the entropy of its symbols, half of that and two bits a symbol more, and what each distinct symbol has."""
    rng = np.random.default_rng(size)
    n = 200_000
    symbols = np.minimum(rng.zipf(1.3, n), size - 1).astype(np.int64)
    symbols[::97] = 0
    symbols[-1] = 0
    index = fm_index.FMIndex(symbols, size, 20)
    counts = np.bincount(symbols)
    counts = counts[counts > 0]
    entropy = float((counts * np.log2(n / counts)).sum()) / n
    assert index.nbytes * 8 <= n * (1.5 * (entropy + 1) + 2) + 600 * size
    assert size > 1000 or index.nbytes < 0.6 * 4 * n


@pytest.mark.parametrize("skew", [0, 1, 3])
@pytest.mark.parametrize("size", [1, 2, 11, 300])
def test_wavelet_rank(size, skew):
    rng = np.random.default_rng(1)
    symbols = (size * rng.random(500) ** (1 + skew)).astype(np.int64)
    tree = fm_index.WaveletTree(symbols, size + 1)
    where, which = rng.integers(0, 501, (2, 200)), rng.integers(0, size + 1, 200)
    wanted = [[int((symbols[:i] == c).sum()) for c, i in zip(which, row, strict=True)] for row in where]
    assert tree.rank(which, where).tolist() == wanted
    assert tree.rank(which, where[0]).tolist() == wanted[0]


def test_code_lengths():
    counts = np.array([5, 0, 1, 1, 2, 9])
    sizes = fm_index.code_lengths(counts)
    assert sizes.tolist() == [2, 0, 4, 4, 3, 1]
    assert fm_index.code_lengths(np.array([0, 7])).tolist() == [0, 0]
    rng = np.random.default_rng(2)
    counts = rng.geometric(0.05, 400)
    sizes = fm_index.code_lengths(counts).astype(float)
    share = counts / counts.sum()
    assert (2.0**-sizes).sum() == 1
    assert -(share * np.log2(share)).sum() <= (share * sizes).sum() <= 1 - (share * np.log2(share)).sum()


@pytest.mark.parametrize(("sql", "made", "columns"), [(OP9, exact_dedup.exact_groups, "doc_id, keep_id, group_size, kept, text_sha256"), (OP6, fm_index.remove_repeated_words, "doc_id, n_words, n_removed, kept_sha256"), (OP10, suffix_array.remove_repeated_bytes, "doc_id, n_bytes, n_removed, n_spans, kept_sha256")])
def test_sql(spark, sf_dir, sql, made, columns):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = duck.execute(f"SELECT {columns} FROM ({sql}) q ORDER BY ALL").fetchall()
    found = [tuple(r) for r in made(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr(*columns.split(", ")).collect()]
    assert sorted(found) == sorted(expected)
