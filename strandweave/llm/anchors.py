"""Finding windows of a text that occur elsewhere: routing by anchors, matching by an index in each shard.

Every window of L units (bytes or words) has an anchor, the smallest hash of its k-grams, so equal windows
have equal anchors.  Consecutive windows with one anchor are a run.  An anchor that occurs in one run only
cannot belong to a repeated window.  So the work goes in three rounds over the same stored blocks:

1. Blocks send their distinct anchors, with how many runs have them, to parts; each part answers which ones occur in
   another block too, and which are hot.
2. Blocks send the runs with such anchors, as segments of text, to shards by anchor.  Runs with a hot anchor are cut
   into their windows, and these go to shards by a hash of the window itself, so that no shard gets all that a frequent
   line or the surroundings of a frequent passage give.  Equal segments of a block go once, for the smallest document
   that holds them, and a shard indexes equal segments once.  The index compares texts, not hashes, and answers a bit
   a window.
3. Blocks turn the bits into spans of their documents.

Blocks are worked on in pieces that fit the processor's caches, so long texts need no more memory than a few times
their own size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames as fr

#: Windows in a segment at most; a longer run is cut.
RUN = 64

HASH_BITS = 48

#: Bytes of text in a block here.
BLOCK_BYTES = 3 << 20

#: Windows of a piece whose grams are held at once.
PIECE = 1 << 16

#: Runs with one anchor, over all blocks (255 a block at most), from which on its windows are dealt one by one.
HOT_RUNS = 16_384

#: A shard's segments are matched by lots of anchors, of about this many bytes of text.
LOTS, LOT_BYTES = 256, 2 << 20


@dataclass
class Units:
    """A block's documents as units: unit i is text[at[i]:at[i + 1]], document d has units docs[d]:docs[d + 1].

    grams(first, end) hashes the grams that start at units first to end - 1.
    """

    text: np.ndarray
    at: np.ndarray | range
    docs: np.ndarray
    grams: Callable[[int, int], np.ndarray]

    def bytes_at(self, units: np.ndarray) -> np.ndarray:
        return units if isinstance(self.at, range) else self.at[units]


@dataclass
class Segments:
    """A shard's distinct segments, end to end in text; each one that was sent has a content, which is one of them.

    source tells documents apart; start is the segment's first unit there.
    """

    text: np.ndarray
    at: np.ndarray
    content: np.ndarray
    doc_id: np.ndarray
    source: np.ndarray
    start: np.ndarray

    def least_doc(self) -> np.ndarray:
        """The smallest document of each distinct segment."""
        least = np.full(len(self.at) - 1, np.iinfo(np.int64).max)
        np.minimum.at(least, self.content, self.doc_id)
        return least


#: Gets a shard's segments and the window's length; True for each sent window (in order) that has an earlier equal.
Matcher = Callable[[Segments, int], np.ndarray]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (sizes[i] of them) for all i."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Bytes, with 16-grams."""

    def grams(first: int, end: int) -> np.ndarray:
        piece = data[first : end + 15]
        eight = np.ndarray((len(piece) - 7,), "<u8", piece, strides=(1,))
        return mix(mix(eight[: end - first] + np.uint64(0x9E3779B97F4A7C15)) ^ eight[8 : end - first + 8])

    return Units(data, range(len(data) + 1), offsets, grams)


def split_blanks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, each with one blank after it: text, where words start, documents' first words."""
    ends = offsets[1:]
    data = np.insert(data, ends, 32)
    offsets = offsets + np.arange(len(offsets))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    # What is kept of white space is the blank after a word; the one after a document ends its last word.
    text = np.where(space, np.uint8(32), data)[keep]
    at = np.append(0, np.flatnonzero(text == 32) + 1)
    sizes = np.diff(np.append(0, np.cumsum(keep))[offsets]) if len(offsets) > 1 else np.zeros(0, np.int64)
    return text, at, np.searchsorted(at, np.append(0, np.cumsum(sizes)))


def hashes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text[at[i]:at[i + 1]], none of them empty; read right to left as a number."""
    sizes = np.diff(at)
    if not len(sizes):
        return np.zeros(0, np.uint64)
    longest = int(sizes.max())
    powers = np.cumprod(np.full(longest, 0xD6E8FEB86659FD93, np.uint64))
    weighted = (text[at[0] : at[-1]] + np.uint64(1)) * powers[spread(np.zeros(len(sizes), np.int64), sizes)]
    return mix(np.add.reduceat(weighted, at[:-1] - at[0]))


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Words, with 8-grams."""
    text, at, docs = split_blanks(data, offsets)

    def grams(first: int, end: int) -> np.ndarray:
        x = hashes(text, at[first : end + 8])
        for k in (1, 2, 4):
            x = mix(x[: len(x) - k] * np.uint64(0x9E3779B97F4A7C15) + x[k:])
        return x

    return Units(text, at, docs, grams)


def binary(text: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(text))])


def joined(text: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """text[first[i]:end[i]] for all i end to end, and where they start (with the end)."""
    sizes = end - first
    return text[spread(first, sizes)], np.append(0, np.cumsum(sizes, dtype=np.int64))


@dataclass
class Runs:
    """Windows first..last (inclusive, by their first unit) with one anchor; twice: it is there more than once."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    twice: np.ndarray

    def take(self, which: np.ndarray) -> Runs:
        return Runs(self.first[which], self.last[which], self.anchor[which], self.twice[which])

    @staticmethod
    def joined(pieces: list[Runs]) -> Runs:
        kinds = {"first": np.int64, "last": np.int64, "anchor": np.uint64, "twice": bool}
        return Runs(*(np.concatenate([np.zeros(0, kind), *(getattr(p, name) for p in pieces)]) for name, kind in kinds.items()))


def _key(x: np.ndarray) -> np.ndarray:
    return mix(x) >> np.uint64(64 - HASH_BITS)


def runs_of(units: Units, length: int, gram: int, within: bool) -> Runs:
    """All windows' runs in order; where a run ends does not matter, only that its windows have one anchor."""
    windows = int(units.docs[-1]) - length + 1
    return Runs.joined([_piece(units, first, min(first + PIECE, windows), length, gram, within) for first in range(0, windows, PIECE)])


def _piece(units: Units, first: int, end: int, length: int, gram: int, within: bool) -> Runs:
    grams = units.grams(first, end + length - gram)
    low, width, reach = grams.copy(), length - gram + 1, 1
    while reach < width:  # the minimum over `reach` grams from each unit on
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    # The last windows of each document would reach over its end.
    border = units.docs[np.searchsorted(units.docs, first + 1) : np.searchsorted(units.docs, end + length - 1)]
    over = np.zeros(end - first + 1, np.int32)
    np.add.at(over, np.maximum(border - length + 1, first) - first, 1)
    np.add.at(over, np.minimum(border, end) - first, -1)
    starts = np.flatnonzero(np.cumsum(over[:-1]) == 0)
    anchor = low[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    since = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
    head = np.flatnonzero(since % RUN == 0)
    a, b, anchor = starts[head], starts[np.append(head[1:], len(starts)) - 1] if len(head) else head, anchor[head]
    twice = np.zeros(len(a), bool)
    if within and len(a):
        size = b - a + length - gram + 1
        same = grams[spread(a, size)] == np.repeat(anchor, size)
        twice = np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64) > 1
    return Runs(a + first, b + first, _key(anchor), twice)


@dataclass
class Sent:
    """What a block sends of its repeated runs: rep[i] is the segment that stands for run i, or -1 where every window of
    the run has an earlier equal in the block; segment are the runs that are sent, by shard and, within, by lot."""

    runs: Runs
    rep: np.ndarray
    segment: np.ndarray
    shard: np.ndarray
    lot: np.ndarray

    def by_shard(self) -> Iterator[tuple[int, slice]]:
        shards, first, n = np.unique(self.shard, return_index=True, return_counts=True)
        for shard, a, size in zip(shards.tolist(), first.tolist(), n.tolist(), strict=True):
            yield shard, slice(a, a + size)


class Finder:
    """One operator's settings.

    within: whether an equal window earlier in the same document counts; else only smaller documents do.
    """

    def __init__(self, make: Callable[[np.ndarray, np.ndarray], Units], match: Matcher, length: int, gram: int, within: bool, parts: int, shards: int, hot_runs: int = HOT_RUNS):
        self.make, self.match, self.length, self.gram, self.within, self.parts, self.shards, self.hot_runs = make, match, length, gram, within, parts, shards, hot_runs

    def load(self, payload: bytes) -> tuple[Units, np.ndarray]:
        table = fr.bytes_to_table(payload)
        return self.make(*fr.text_bytes(table.column("text"))), fr.ids_of(table.column("doc_id"))

    def _edges(self, distinct: np.ndarray) -> np.ndarray:
        """Where each part's anchors begin among sorted ones."""
        return np.searchsorted((distinct * np.uint64(self.parts)) >> np.uint64(HASH_BITS), np.arange(self.parts + 1))

    def anchors(self, block: int, payload: bytes) -> Iterator[tuple[int, bytes]]:
        distinct, counts = np.unique(runs_of(self.load(payload)[0], self.length, self.gram, False).anchor, return_counts=True)
        edges = self._edges(distinct)
        for p in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[p], edges[p + 1])
            yield p, fr.arrays_to_bytes(steps=np.diff(distinct[own], prepend=np.uint64(0)), runs=np.minimum(counts[own], 255).astype(np.uint8))

    def repeated(self, payloads: list[bytes]) -> Iterator[bytes]:
        """Two bits for each anchor: whether another block has it too, and whether it is hot. Anchors are distinct within a block."""
        sent = [fr.bytes_to_arrays(p) for p in payloads]
        lists = [np.cumsum(x["steps"], dtype=np.uint64) for x in sent]
        both = np.concatenate(lists)
        order = np.argsort(both)
        values = both[order]
        head = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        blocks = np.diff(np.append(head, len(values)))
        runs = np.add.reduceat(np.concatenate([x["runs"] for x in sent])[order], head, dtype=np.int64)
        bits = np.empty((2, len(values)), bool)
        bits[0, order] = np.repeat(blocks > 1, blocks)
        bits[1, order] = np.repeat(runs > self.hot_runs, blocks)
        at = 0
        for own in lists:
            yield np.packbits(bits[:, at : at + len(own)], axis=1).tobytes()
            at += len(own)

    def sent(self, units: Units, ids: np.ndarray, bits: dict[int, bytes]) -> Sent:
        runs = runs_of(units, self.length, self.gram, self.within)
        distinct, back, counts = np.unique(runs.anchor, return_inverse=True, return_counts=True)
        answer = np.zeros((2, len(distinct)), bool)
        edges = self._edges(distinct)
        for p in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[p], edges[p + 1])
            answer[:, own] = np.unpackbits(np.frombuffer(bits[p], np.uint8).reshape(2, -1), axis=1, count=own.stop - own.start)
        often = (answer[0] | (counts > 1))[back] | runs.twice
        hot = answer[1][back]
        runs = Runs.joined([runs.take(often & ~hot), self._windows_of(units, runs.take(often & hot))])
        by = np.argsort(runs.first)
        runs = runs.take(by)
        if not len(by):
            return Sent(runs, *(np.zeros(0, np.int64),) * 4)
        content = binary(*joined(units.text, units.bytes_at(runs.first), units.bytes_at(runs.last + self.length))).dictionary_encode().indices.to_numpy()
        row = np.searchsorted(units.docs, runs.first, side="right") - 1
        order = np.argsort(content, kind="stable")  # by row and place within
        c, r, d = content[order], row[order], ids[row[order]]
        new_content = np.append(True, c[1:] != c[:-1])
        head = np.flatnonzero(new_content)
        least = np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(c))))
        new_row = new_content | np.append(True, r[1:] != r[:-1])
        segment = order[new_row & (d == least)]
        anchor = runs.anchor[segment]
        lot = (anchor & np.uint64(LOTS - 1)).astype(np.int64)
        shard = ((anchor >> np.uint64(8)) % np.uint64(self.shards)).astype(np.int64)
        dealt = np.argsort(shard * LOTS + lot, kind="stable")
        number = np.empty(len(segment), np.int64)
        number[dealt] = np.arange(len(segment))
        rep = np.empty(len(c), np.int64)
        rep[order] = np.where((d > least) | (~new_row if self.within else False), -1, number[np.cumsum(new_row & (d == least)) - 1])
        return Sent(runs, rep, segment[dealt], shard[dealt], lot[dealt])

    def _windows_of(self, units: Units, runs: Runs) -> Runs:
        """The runs' windows, each a run of its own whose anchor is a hash of the window."""
        first = spread(runs.first, runs.last - runs.first + 1)
        anchor = _key(hashes(*joined(units.text, units.bytes_at(first), units.bytes_at(first + self.length))))
        return Runs(first, first, anchor, np.zeros(len(first), bool))

    def segments(self, block: int, payload: bytes, bits: dict[int, bytes]) -> pd.DataFrame:
        units, ids = self.load(payload)
        sent = self.sent(units, ids, bits)
        first, last = sent.runs.first[sent.segment], sent.runs.last[sent.segment]
        row = np.searchsorted(units.docs, first, side="right") - 1
        text, at = joined(units.text, units.bytes_at(first), units.bytes_at(last + self.length))
        rows = []
        for shard, own in sent.by_shard():
            rows_there, place = np.unique(row[own], return_inverse=True)
            arrays = {"text": text[at[own.start] : at[own.stop]], "size": np.diff(at[own.start : own.stop + 1]).astype(np.uint32), "windows": (last - first + 1)[own].astype(np.uint8), "lot": sent.lot[own].astype(np.uint8)}
            arrays |= {"doc_id": ids[rows_there], "row": rows_there.astype(np.int32), "place": place.astype(np.uint32)}
            if self.within:
                arrays["start"] = first[own].astype(np.int32)
            rows.append((block, shard, fr.arrays_to_bytes(**arrays)))
        return pd.DataFrame(rows, columns=["block", "part", "payload"])

    def matched(self, blocks: list[int], payloads: list[bytes]) -> list[bytes]:
        sent = [fr.bytes_to_arrays(p) for p in payloads]
        text, size, windows, lot = (np.concatenate([x[c] for x in sent]) for c in ("text", "size", "windows", "lot"))
        size, windows = size.astype(np.int64), windows.astype(np.int64)
        doc_id, row = (np.concatenate([x[c][x["place"]] for x in sent]) for c in ("doc_id", "row"))
        block = np.repeat(np.arange(len(blocks)), [len(x["size"]) for x in sent])
        start = np.concatenate([x["start"] for x in sent]) if self.within else np.zeros(len(size), np.int32)
        source = (block << 32) | row
        at, window_at = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(windows))
        # Lots in order, as many together as make LOT_BYTES.
        lot_bytes = np.cumsum(np.bincount(lot, weights=size, minlength=LOTS))
        together = (lot_bytes // LOT_BYTES).astype(np.int64)[lot]
        order = np.argsort(together, kind="stable")
        flags = np.zeros(window_at[-1], bool)
        for own in np.split(order, np.flatnonzero(np.diff(together[order])) + 1):
            coded = binary(*joined(text, at[own], at[own + 1])).dictionary_encode()
            distinct = coded.dictionary.buffers()
            ends = np.frombuffer(distinct[1], np.int64, len(coded.dictionary) + 1)
            segments = Segments(np.frombuffer(distinct[2], np.uint8, ends[-1]), ends, coded.indices.to_numpy(), doc_id[own], source[own], start[own])
            flags[spread(window_at[own], windows[own])] = self.match(segments, self.length)
        cuts = window_at[np.cumsum([len(x["size"]) for x in sent])[:-1]]
        return [np.packbits(x).tobytes() for x in np.split(flags, cuts)]

    def covered(self, payload: bytes, bits: dict[int, bytes], found: dict[int, bytes]) -> tuple[Units, np.ndarray, Spans]:
        """The units, the ids, and the stretches of units in windows that have an earlier equal."""
        units, ids = self.load(payload)
        sent = self.sent(units, ids, bits)
        size = sent.runs.last - sent.runs.first + 1
        sizes = size[sent.segment]
        flags, at = np.zeros(int(sizes.sum()), bool), np.append(0, np.cumsum(sizes))
        for shard, own in sent.by_shard():
            flags[at[own.start] : at[own.stop]] = np.unpackbits(np.frombuffer(found[shard], np.uint8), count=at[own.stop] - at[own.start])
        # A run that no segment stands for has hits only: one place after the flags, repeated.
        own = sent.rep >= 0
        reads, times = np.where(own, size, 1), np.where(own, 1, size)
        hit = np.append(flags, True)[spread(np.where(own, at[sent.rep], len(flags)), reads)]
        hit = np.repeat(hit, np.repeat(times, reads))
        return units, ids, Spans.of(spread(sent.runs.first, size)[hit], self.length, units)


@dataclass
class Spans:
    """Maximal stretches first[i]..end[i] - 1 of covered units, in order; doc tells whose."""

    first: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(windows: np.ndarray, length: int, units: Units) -> Spans:
        """The stretches that windows (their first units, in order) cover; none reaches over the end of a document."""
        doc = np.searchsorted(units.docs, windows, side="right") - 1
        new = np.ones(len(windows), bool)
        new[1:] = (windows[1:] > windows[:-1] + length) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(windows))[: len(head)] - 1
        return Spans(windows[head], windows[last] + length, doc[head])

    def per_doc(self, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Covered units and stretches of each document."""
        total = np.zeros(docs, np.int64)
        np.add.at(total, self.doc, self.end - self.first)
        return total, np.bincount(self.doc, minlength=docs)

    def lists(self, docs: np.ndarray) -> list[list[int]]:
        """Begin and end of each stretch in turn, from the start of its document, for every document."""
        both = np.stack([self.first - docs[self.doc], self.end - docs[self.doc]], axis=1).ravel().tolist()
        ends = (2 * np.cumsum(np.bincount(self.doc, minlength=len(docs) - 1))).tolist()
        return [both[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def kept_texts(text: np.ndarray, docs: np.ndarray, first: np.ndarray, end: np.ndarray, strip: int = 0) -> list[bytes]:
    """Each document's bytes, from docs[d] to docs[d + 1], outside first[i]:end[i], less strip bytes at the end."""
    edge = np.zeros(len(text) + 1, np.int8)
    edge[first] += 1
    edge[end] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
    left = text[keep].tobytes()
    gone = np.zeros(len(docs), np.int64)
    np.add.at(gone, np.searchsorted(docs, first, side="right"), end - first)
    ends = (docs - np.cumsum(gone)).tolist()
    return [left[a : max(a, b - strip)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def sha256(texts: list[bytes]) -> list[str]:
    return [hashlib.sha256(x).hexdigest() for x in texts]


def remove_repeats(df: DataFrame, finder: Finder, rows_of: Callable[[Units, np.ndarray, Spans, pa.Table], pd.DataFrame], schema: str) -> DataFrame:
    """rows_of(units, ids, covered stretches, documents) over all blocks of df, which has doc_id and text.

    Blocks are stored once, so all rounds see the same ones however the input is planned again.
    """
    blocks = fr.stored(fr.block_rows(df, limit=BLOCK_BYTES))
    bits = fr.stored(fr.by_part(fr.part_rows(blocks, finder.anchors), finder.repeated))
    segments = fr.by_block(blocks, [bits], lambda block, payload, answers: finder.segments(block, payload, answers[0]), fr.PART_SCHEMA)

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        return frame.assign(payload=finder.matched(frame["block"].tolist(), frame["payload"].tolist()))

    found = segments.groupBy("part").applyInPandas(fr.tidy_group(match), fr.PART_SCHEMA)

    def finish(block: int, payload: bytes, answers: list[dict[int, bytes]]) -> pd.DataFrame:
        units, ids, spans = finder.covered(payload, *answers)
        return rows_of(units, ids, spans, fr.bytes_to_table(payload))

    return fr.by_block(blocks, [bits, found], finish, schema)
