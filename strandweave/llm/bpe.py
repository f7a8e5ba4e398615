"""Byte-level BPE over Spark: split words, encode each distinct word once, put ids back by position."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames as fr

#: Code points from here on are rare; documents that hold one are split by the tokenizer itself.
RARE = 0x20000

LETTER, NUMBER, OTHER, SPACE = range(4)

#: Words that the tokenizer gets at once; what it makes of a word takes far more memory than the ids.
SLICE = 1 << 13

#: The contractions that are words of their own, after an apostrophe.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def specials(path: str) -> dict[bytes, int]:
    return {t.content.encode(): i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


@lru_cache(maxsize=4)
def classes(path: str) -> np.ndarray:
    """Each code point's class, as the tokenizer's own splitter sees it.

    Every code point c stands in `x c 7 c ;` without the blanks: a letter joins x, a number joins 7,
    anything else joins ;, and white space joins none.
    """
    points = np.array([c for c in range(RARE) if not 0xD800 <= c <= 0xDFFF], dtype=np.uint32)
    out = np.full(RARE, OTHER, dtype=np.uint8)
    for part in np.array_split(points, 32):
        table = np.empty((len(part), 5), dtype=np.uint32)
        table[:] = [ord("x"), 0, ord("7"), 0, ord(";")]
        table[:, 1] = table[:, 3] = part
        starts = np.zeros(table.size + 1, dtype=bool)
        starts[[a for _, (a, _) in tokenizer(path).pre_tokenizer.pre_tokenize_str(table.tobytes().decode("utf-32-le"))]] = True
        joins = ~starts[:-1].reshape(-1, 5)
        out[part] = np.select([joins[:, 1], joins[:, 3], joins[:, 4]], [LETTER, NUMBER, OTHER], SPACE)
    out[[ord(c) for c in "\t\n\x0b\x0c\r "]] = SPACE
    return out


def word_starts(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where words start, for code points of texts end to end; first marks where texts start.

    A run of one class is a word; one blank before it belongs to it; of longer white space the last
    character stands apart; a contraction at a word's start is a word.
    """
    n = len(points)
    starts = first.copy()
    if n < 2:
        return starts
    inner = ~first[1:]
    starts[1:] |= kinds[1:] != kinds[:-1]
    after_space = (kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & inner
    starts[1:] &= ~(after_space & (points[:-1] == 32))
    starts[:-1] |= after_space
    marks = np.flatnonzero(starts & (points == 39))
    marks = marks[marks + 1 < n]
    marks = marks[~first[marks + 1]]
    next_one = points[marks + 1]
    one = np.isin(next_one, [ord(c) for c in ONE_LETTER])
    pairs = marks[(~one) & (marks + 2 < n)]
    pairs = pairs[~first[pairs + 2]]
    two = np.zeros(len(pairs), dtype=bool)
    for a, b in TWO_LETTERS:
        two |= (points[pairs + 1] == ord(a)) & (points[pairs + 2] == ord(b))
    for at, length in ((marks[one], 2), (pairs[two], 3)):
        starts[at + 1] = False
        after = at + length
        starts[after[after < n]] = True
    return starts


def split_words(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all words (with the end), and each document's first word (with the end).

    Empty documents have no word.  A special token's string is one word.
    """
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(widths)])
    doc_at = np.searchsorted(at, offsets)
    first = np.zeros(n, dtype=bool)
    first[doc_at[:-1][np.diff(doc_at) > 0]] = True
    whole = []
    for special in specials(path):
        found = raw.find(special)
        while found >= 0:
            whole.append((found, found + len(special)))
            found = raw.find(special, found + len(special))
    # A special string that runs over the end of a document is none.
    whole = [(a, b) for a, b in whole if offsets[np.searchsorted(offsets, a, side="right")] >= b]
    spans = np.searchsorted(at, np.array(whole, dtype=np.int64).reshape(-1, 2))
    first[spans[:, 0]] = True
    first[spans[:, 1][spans[:, 1] < n]] = True
    starts = word_starts(points, first, classes(path)[np.minimum(points, RARE - 1)])
    for a, b in spans:
        starts[a + 1 : b] = False
    rare = np.flatnonzero(points >= RARE)
    if len(rare):
        edges = np.flatnonzero(first)
        special_starts = set(spans[:, 0].tolist())
        for k in np.unique(np.searchsorted(edges, rare, side="right") - 1):
            a, b = int(edges[k]), int(edges[k + 1]) if k + 1 < len(edges) else n
            if a not in special_starts:
                starts[a:b] = False
                starts[[a + x for _, (x, _) in tokenizer(path).pre_tokenizer.pre_tokenize_str(points[a:b].tobytes().decode("utf-32-le"))]] = True
    word_at = np.flatnonzero(starts)
    return np.concatenate([at[word_at], [at[-1]]]), np.searchsorted(word_at, doc_at)


def dictionary(data: np.ndarray, word_offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each word's number in the table of distinct words, and that table."""
    if len(word_offsets) < 2:
        return np.zeros(0, np.int32), pa.array([], pa.large_binary())
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(word_offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(word_offsets)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def encode_words(words: list[bytes], path: str) -> list[bytes]:
    """Each distinct word's ids, as little-endian 32-bit integers."""
    special = specials(path)
    tok = tokenizer(path)
    tok.encode_special_tokens = True
    plain = [w.decode("utf-8") for w in words if w not in special]
    found = (e.ids for lo in range(0, len(plain), SLICE) for e in tok.encode_batch_fast(plain[lo : lo + SLICE], add_special_tokens=False))
    return [np.array([special[w]] if w in special else next(found), dtype="<u4").tobytes() for w in words]


class Memo:
    """Words that this worker has encoded; full, it takes no more, and results stay the same."""

    def __init__(self, path: str, limit: int = 300_000):
        self.path, self.limit, self.known = path, limit, {}

    def encode(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        found = [known.get(w) for w in words]
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            for i, ids in zip(missing, encode_words([words[i] for i in missing], self.path), strict=True):
                found[i] = ids
                if len(known) < self.limit:
                    known[words[i]] = ids
        return found


@lru_cache(maxsize=4)
def memo(path: str) -> Memo:
    return Memo(path)


def spread(codes: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in order, and where each word's ids start (with the end)."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    flat = np.frombuffer(b"".join(pieces), "<u4")
    first = np.concatenate([[0], np.cumsum(lengths)])
    size = lengths[codes]
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(first[codes] - ends[:-1], size) + np.arange(ends[-1])
    return flat[take], ends


def encode_table(table: pa.Table, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of documents, and the n+1 offsets of the documents."""
    data, offsets = fr.text_bytes(table.column("text"))
    word_offsets, doc_words = split_words(data, offsets, path)
    codes, words = dictionary(data, word_offsets)
    ids, ends = spread(codes, memo(path).encode(words.to_pylist()))
    return ids, ends[doc_words]


@lru_cache(maxsize=4)
def pieces(path: str) -> pa.Array:
    """The id-to-piece table: the bytes of every id, in order of the ids; bounded by the vocabulary."""
    tok = tokenizer(path)
    # Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {i: s for s, i in specials(path).items()}
    size = tok.get_vocab_size()
    return pa.array([special[i] if i in special else bytes(byte_of[c] for c in tok.id_to_token(i)) for i in range(size)], pa.large_binary())


def _block_words(table: pa.Table, path: str, parts: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """A block's documents as numbers of words in its own table of distinct words, and that table dealt to parts."""
    data, offsets = fr.text_bytes(table.column("text"))
    word_offsets, doc_words = split_words(data, offsets, path)
    codes, words = dictionary(data, word_offsets)
    ids = fr.ids_of(table.column("doc_id"))
    frame = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    part = (frame % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    payload = fr.arrays_to_bytes(doc_id=ids, doc_words=doc_words.astype(np.int64), codes=rank[codes])
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    rows = []
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        rows.append((int(part[order[a]]), fr.table_to_bytes(pa.table({"word": words.take(pa.array(order[a:b]))}))))
    return payload, rows


def _encode_part(path: str):
    def answer(payloads: list[bytes]) -> Iterator[bytes]:
        columns = [fr.bytes_to_table(p).column("word").combine_chunks() for p in payloads]
        coded = pa.concat_arrays(columns).dictionary_encode()
        ids = pa.array(encode_words(coded.dictionary.to_pylist(), path), pa.large_binary())
        start = 0
        for column in columns:
            yield fr.table_to_bytes(pa.table({"ids": ids.take(coded.indices.slice(start, len(column)))}))
            start += len(column)

    return answer


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), ids_sha256, decoded_text bytes and decoded_sha256 of every row.

    The distinct-word table: each block's distinct words go to a part by hash; there every distinct word of the
    corpus is encoded once; its ids go back to the blocks that hold it, by position.  Decoding looks ids up in
    the id-to-piece table, whose size is the vocabulary's.

    Special tokens written in a text become their ids, as in the tokenizers library.  A null text is empty and
    has no ids; a null id stays null; repeated rows are answered each.  The input is read twice and must be cut
    the same way both times, as files are; store a frame with shuffles in it first.
    """
    parts = parts or 2 * fr.partitions(df.sparkSession)
    docs = fr.with_text(df, id_col, text_col)
    blocks = fr.block_rows(docs, lambda table: _block_words(table, path, parts)[0])
    words = fr.part_rows_of(docs, lambda table: _block_words(table, path, parts)[1])
    encoded = fr.by_part(words, _encode_part(path))

    def finish(block: int, payload: bytes, answers: list[dict[int, bytes]]) -> pd.DataFrame:
        own = fr.bytes_to_arrays(payload)
        table = [w for part in sorted(answers[0]) for w in fr.bytes_to_table(answers[0][part]).column("ids").to_pylist()]
        ids, ends = spread(own["codes"], table)
        ends = ends[own["doc_words"]]
        # The id-to-piece join: pieces stand end to end in the order of the ids.
        joined = pieces(path).take(pa.array(ids))
        places = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][ends] if len(ids) else ends
        spelled = joined.buffers()[2].to_pybytes() if len(ids) else b""
        out = []
        for doc_id, a, b, x, y in zip(own["doc_id"].tolist(), ends[:-1].tolist(), ends[1:].tolist(), places[:-1].tolist(), places[1:].tolist(), strict=True):
            raw = ids[a:b].tobytes()
            text = spelled[x:y].decode("utf-8", "replace").encode()
            out.append((doc_id, b - a, raw, hashlib.sha256(raw).hexdigest(), text, hashlib.sha256(text).hexdigest()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"])
        return frame.assign(doc_id=fr.nullable(own["doc_id"]))

    schema = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded binary, decoded_sha256 string"
    return fr.by_block(blocks, [encoded], finish, schema)
