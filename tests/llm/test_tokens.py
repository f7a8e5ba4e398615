"""BPE, packing and token counts against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandweave.llm import bpe, packing, token_counts
from strandweave.llm.queries import TOKENIZER


def encoded(texts):
    tok = bpe.tokenizer(TOKENIZER)
    tok.encode_special_tokens = False
    return [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_and_ids_of_random_texts():
    rng = random.Random(3)
    letters = "ab'sSretvlmd  \n\t 1٣²é漢\U00020000\U00020001😀.!  ,Ⅻ́"
    for _ in range(60):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", " <|endoftext|> x", "<|endof"]) for _ in range(20)]
        ids, ends = bpe.encode_table(pa.table({"doc_id": list(range(20)), "text": texts}), TOKENIZER)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == encoded(texts)


def test_encode_and_decode(odd, rows):
    tok = bpe.tokenizer(TOKENIZER)
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(odd, TOKENIZER).collect())
    expected = []
    for (doc_id, _), ids in zip(rows, encoded([t for _, t in rows]), strict=True):
        text = tok.decode(ids, skip_special_tokens=False)
        expected.append((str(doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(expected)


def test_encode_nothing(empty):
    assert bpe.encode_documents(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("size", [64, 2048])
def test_packing(odd, rows, size):
    made = packing.pack_documents(odd, TOKENIZER, size=size, open_windows=4, slack=4, fan_in=2).collect()
    ids = [[*x, 1] for x in encoded([t for _, t in rows])]
    windows = {}
    for r in made:
        windows.setdefault(r["sequence_id"], []).append(r)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            assert r["length"] > 0
            at += r["length"]
        assert at <= size
    total = sum(map(len, ids))
    assert sum(r["length"] for r in made) == total
    assert len(windows) * size - total <= 4 * len(windows) + size
    # Each document's pieces, whichever document it is of those with its id and length.
    pieces = sorted((str(r["doc_id"]), r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in made)
    left = list(pieces)
    for (doc_id, _), own in zip(rows, ids, strict=True):
        at = 0
        while at < len(own):
            fit = next(p for p in left if p[:3] == (str(doc_id), len(own), at) and p[4] == zlib.crc32(np.array(own[at : at + p[3]], "<u4").tobytes()))
            left.remove(fit)
            at += fit[3]
    assert not left


def test_pack_nothing(empty):
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_histogram(odd, rows, spark):
    lengths = [len(x) for x in encoded([t for _, t in rows])]
    made = token_counts.length_histogram(token_counts.token_lengths(odd, TOKENIZER), range_width=64)
    found = {r["n_tokens"]: r for r in made.collect()}
    assert set(found) == set(lengths)
    for limit, r in found.items():
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_over"] == sum(n > limit for n in lengths)
        assert r["tokens_within_limit"] == sum(min(n, limit) for n in lengths)
        assert r["tokens_cut"] == sum(max(n - limit, 0) for n in lengths)
        assert abs(r["quantile"] - sum(n <= limit for n in lengths) / len(lengths)) < 1e-12
    at = {r["context_limit"]: (r["docs_over"], r["tokens_within_limit"]) for r in token_counts.at_limits(made, [100, 5000]).collect()}
    assert at == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in (100, 5000)}


def test_histogram_of_nothing(empty):
    assert token_counts.length_histogram(token_counts.token_lengths(empty, TOKENIZER)).count() == 0
