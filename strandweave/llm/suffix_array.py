"""Suffix arrays by bucket-pointer refinement, and removal of repeated byte strings with them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames as fr
from .anchors import HOT_RUNS, Finder, Segments, Spans, Units, byte_units, kept_texts, remove_repeats, sha256, spread


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)


class Buckets:
    """Suffixes in the order of their first `depth` symbols.

    `order` lists suffixes, `pointer[i]` is the first slot of suffix i's bucket, so suffixes with one pointer agree
    in `depth` symbols.  Suffixes beyond the end have pointers of their own.
    """

    def __init__(self, keys: np.ndarray, depth: int):
        """keys order the suffixes by their first depth symbols: the initial q-gram buckets."""
        self.n, self.depth = len(keys), depth
        self.order = np.argsort(keys)
        self.head = _heads(keys[self.order])
        self.pointer = np.empty(self.n, np.int64)
        self._point(np.arange(self.n))

    def _point(self, slots: np.ndarray) -> None:
        self.pointer[self.order[slots]] = _firsts(self.head)[slots]

    def refine(self, step: int) -> None:
        """Sorts each bucket of several suffixes on the buckets of the suffixes step (at most depth) symbols later.

        The pointers that this updates are the keys of the next refinement, which so reaches twice as deep.
        """
        if not 0 < step <= self.depth:
            raise ValueError("pointers are known to `depth` symbols only")
        last = np.append(self.head[1:], True)
        slots = np.flatnonzero(~(self.head & last))
        suffix = self.order[slots]
        later = suffix + step
        beyond = later >= self.n
        second = np.where(beyond, later, self.pointer[np.minimum(later, self.n - 1)])
        keys = (self.pointer[suffix] << 32) | second
        by = np.argsort(keys)
        self.order[slots] = suffix[by]
        self.head[slots] = _heads(keys[by])
        self._point(slots)
        self.depth += step

    def sort(self) -> Buckets:
        """To the full suffix array; ends where every bucket holds one suffix."""
        while not self.head.all():
            self.refine(self.depth)
        return self


def window_buckets(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of the suffixes at starts, alike where the next `length` (8 at least) bytes are.

    The initial buckets are those of 8-grams.  A refinement sorts the members of each bucket on the bucket that each
    one's later offset is in, and moves their pointers on within the bucket's slots; these are the keys of the next
    refinement, at twice the depth.  Only suffixes that a later refinement reads are refined.
    """
    n = len(text)
    depths = [8]
    while depths[-1] < length:
        depths.append(min(2 * depths[-1], length))
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    rounds = []
    for known, depth in zip(depths[-2::-1], depths[:0:-1], strict=True):
        rounds.append((depth - known, np.flatnonzero(wanted)))
        wanted[depth - known :] |= wanted[: n - (depth - known)].copy()

    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    grams = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(grams)
    pointer = np.empty(n, np.int64)
    pointer[order] = _firsts(_heads(grams[order]))
    del grams, order
    for step, suffixes in reversed(rounds):
        sizes = np.bincount(pointer[suffixes], minlength=n)
        suffixes = suffixes[sizes[pointer[suffixes]] > 1]
        keys = (pointer[suffixes] << 32) | pointer[suffixes + step]
        by = np.argsort(keys)
        keys = keys[by]
        bucket = keys >> 32
        pointer[suffixes[by]] = bucket + _firsts(_heads(keys)) - _firsts(_heads(bucket))
    return pointer[starts]


def _firsts(heads: np.ndarray) -> np.ndarray:
    """For each place, the last head up to it."""
    return np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))


def match_by_suffix_array(segments: Segments, length: int) -> np.ndarray:
    """Windows whose byte string starts in a smaller document too."""
    windows = np.diff(segments.at) - length + 1
    starts = spread(segments.at[:-1], windows)
    bucket = window_buckets(segments.text, starts, length)
    least = np.full(len(segments.text), np.iinfo(np.int64).max)
    np.minimum.at(least, bucket, np.repeat(segments.least_doc(), windows))
    least = least[bucket]
    n = windows[segments.content]
    places = spread((np.cumsum(windows) - windows)[segments.content], n)
    return least[places] < np.repeat(segments.doc_id, n)


def whole_characters(text: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches less the characters at their ends of which they hold only some bytes; empty ones go."""
    inside = np.append((text & 0xC0) == 0x80, False)
    for _ in range(3):
        first = first + (inside[first] & (first < end))
        end = end - (inside[end] & (first < end))
    return first[first < end], end[first < end]


def remove_repeated_bytes(df: DataFrame, length: int = 50, parts: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes, kept_text, spans and the columns in carry.

    spans lists begin and end of each removed stretch in turn.

    A byte goes if a string of length bytes that covers it also starts in a document with a smaller id; strings
    are judged on the input.  kept_text leaves characters of which a span covers only some bytes whole.

    A null text is empty; a null id orders before every other and stays null; rows with one id do not remove
    each other's bytes; repeated rows are answered each; an empty table gives no rows.
    """
    width = fr.partitions(df.sparkSession)
    finder = Finder(byte_units, match_by_suffix_array, length, 16, False, parts or 2 * width, shards or 4 * width, hot_runs)
    docs = fr.with_text(df, id_col, text_col, *carry)

    def rows_of(units: Units, ids: np.ndarray, spans: Spans, table: pa.Table) -> pd.DataFrame:
        kept = kept_texts(units.text, units.docs, spans.first, spans.end)
        texts = kept_texts(units.text, units.docs, *whole_characters(units.text, spans.first, spans.end))
        removed, n_spans = spans.per_doc(len(ids))
        out = {"doc_id": fr.nullable(ids), "n_bytes": np.diff(units.docs), "n_removed": removed, "n_spans": n_spans, "kept_sha256": sha256(kept), "kept_bytes": kept, "kept_text": [t.decode("utf-8") for t in texts], "spans": spans.lists(units.docs)}
        return pd.DataFrame(out | {c: table.column(c).to_pandas() for c in carry})

    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary, kept_text string, spans array<long>{kinds}"
    return remove_repeats(docs, finder, rows_of, schema)
