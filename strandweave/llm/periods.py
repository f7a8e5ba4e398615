"""Runs of repeated words: maximal stretches with a small period, by a dictionary of basic factors.

The basic factors of a document are its stretches of 1, 2, 4, 8, ... words.  Those of one length get names, equal for
equal stretches, from the pairs of names of their halves.  Of two occurrences of a factor of L words that follow each
other, those at a distance of at most L lie within twice that length; such occurrences form arithmetic progressions, and
their step is a period.  Where consecutive starts have one step q, the stretch from the first of them to the end of the
last's successor has the period q and can't be extended: a neighbour with that period would be a start of the same step
(theorem of Fine and Wilf).  q is its smallest period for the same reason.  A run of three periods has factors of every
length up to twice its period, so each run is found at the one length L with L/2 < q <= L, and is reported there only.

Each level names only starts whose factor occurs in the document again, so text without repeats costs one level.
Everything happens within a document: tasks work on pieces of a few documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as fr
from .anchors import binary, split_blanks

#: Bytes of text that are worked on together; a longer document is taken alone.
PIECE_BYTES = 1 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@dataclass
class Runs:
    """Stretches of length units from start on, of the smallest period; in order of start, then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of equal keys side by side (by place), where a key is new in it, and how often each place's key is there."""
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])[: len(key)]
    head = np.flatnonzero(new)
    return order, new, np.repeat(np.diff(np.append(head, len(key))), np.diff(np.append(head, len(key))))


def runs_of(codes: np.ndarray, docs: np.ndarray, least: int = 24, exponent: int = 3) -> Runs:
    """All runs of at least `least` units and `exponent` periods; document d has the units docs[d]:docs[d + 1]."""
    if exponent < 3:
        raise ValueError("a run has three periods at least")
    sizes = np.diff(docs)
    end = np.repeat(docs[1:], sizes)
    name = np.full(len(codes), -1)
    at = np.arange(len(codes))
    key = np.repeat(np.arange(len(sizes)), sizes) * (int(codes.max(initial=0)) + 1) + codes
    found, size = [(np.zeros(0, np.int64),) * 3], 1
    while len(at):
        order, new, times = _named(key)
        place = at[order]
        step = np.append(place[1:], 0) - place
        step[np.append(new[1:], True)] = 0
        near = (step > size // 2) & (step <= size)
        found.append(_stretches(place[near], step[near], size))
        # Starts whose factor is there again in their document go on to the next length.
        name[at] = -1
        again = times > 1
        at = np.sort(place[again])
        name[place[again]] = (np.cumsum(new) - 1)[again]
        at = at[at + 2 * size <= end[at]]
        at = at[name[at + size] >= 0]
        key = name[at] * (len(place) + 1) + name[at + size]
        size *= 2
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = (length >= least) & (length >= exponent * period)
    order = np.lexsort((period[keep], start[keep]))
    return Runs(start[keep][order], length[keep][order], period[keep][order])


def _stretches(place: np.ndarray, step: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of the stretches that consecutive places of one step span, with factors of that size."""
    order = np.argsort(place)
    place, step = place[order], step[order]
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (step[1:] != step[:-1]))[: len(place)])
    last = np.append(first[1:], len(place))[: len(first)] - 1
    return place[first], place[last] - place[first] + step[first] + size, step[first]


def _rows(table: pa.Table, least: int, exponent: int) -> pa.RecordBatch:
    text, at, docs = split_blanks(*fr.text_bytes(table.column("text")))
    runs = runs_of(binary(text, at).dictionary_encode().indices.to_numpy().astype(np.int64), docs, least, exponent)
    doc = np.searchsorted(docs, runs.start, side="right") - 1
    listed = pa.StructArray.from_arrays([pa.array(x) for x in (runs.start - docs[doc], runs.length, runs.period)], fields=list(RUN))
    edge = np.zeros(len(at), np.int64)
    np.add.at(edge, runs.start + runs.period, 1)
    np.add.at(edge, runs.start + runs.length, -1)
    kept = np.repeat(np.cumsum(edge)[: len(at) - 1] == 0, np.diff(at))
    left = text[kept].tobytes()
    ends = np.append(0, np.cumsum(kept))[at[docs]].tolist()
    collapsed = [left[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    columns = [
        table.column("doc_id").combine_chunks(),
        pa.array(np.diff(docs)),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(docs))), pa.int32()), listed),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(df: DataFrame, least: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row.

    Words stand between ASCII white space and are numbered from 0.  runs are the maximal stretches of at least `least`
    words and `exponent` periods, by start, then period.  collapsed is the text, with one blank between words, without
    what runs hold after their first period.  A null or empty text has no word and no run; a null id stays null;
    repeated rows are answered each; other columns are ignored; an empty table gives no rows.  A text of any length is
    taken whole, in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in fr.batches_of(batches, PIECE_BYTES):
            yield _rows(table, least, exponent)

    return fr.with_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def strongest(runs: Column) -> Column:
    """Of an array of runs the one of most periods (exactly); ties go to the smaller start, then the smaller period."""
    worth = lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1)
    order = lambda a, b: worth(a, b).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int"))
    return F.try_element_at(F.array_sort(runs, order), F.lit(1))


def with_planted_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, where about a tenth of the documents (by checksum of the id) end in a stretch of their own, repeated.

    With h the CRC-32 of the decimal id and g = h / 10 rounded down, documents of h % 10 = 0 keep their first a = g % n of
    n words; the p = 1 + (n - a) / (3 + g % 8) words after these are repeated up to word n.  A null id or text plants nothing.
    """
    docs = fr.with_text(df, id_col, text_col)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.nullif(F.size(words).cast("long"), F.lit(0))
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    whole = lambda x: x.cast("int")
    block = F.slice(words, whole(a + 1), whole(p))
    tail = F.slice(F.flatten(F.array_repeat(block, whole(F.ceil((n - a) / p)))), F.lit(1), whole(n - a))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), whole(a)), tail), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & n.isNotNull(), made).otherwise(F.col("text")))
