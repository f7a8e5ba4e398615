"""FM-index over wavelet trees, and removal of repeated word sequences with it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames as fr
from .anchors import HOT_RUNS, Finder, Segments, Spans, Units, binary, kept_texts, remove_repeats, sha256, spread, word_units


class Bits:
    """A bit vector with rank and select: 64-bit words and the ones before each, a bit and a half a bit in all."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int32))[:-1]

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the one after k others is: its word by the counts, then halves of the word by theirs."""
        word = np.searchsorted(self.before, k.astype(np.int32), side="right") - 1
        rest, x, at = k - self.before[word], self.words[word], word.astype(np.int64) << 6
        for width in (32, 16, 8, 4, 2, 1):
            low = x & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(low)
            upper = rest >= ones
            rest = rest - np.where(upper, ones, 0)
            at += np.where(upper, width, 0)
            x = np.where(upper, x >> np.uint64(width), low)
        return at

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's code in a tree of least total length; 0 where the count is 0, or only one is not."""
    used = np.flatnonzero(counts)
    order = used[np.argsort(counts[used], kind="stable")]
    n, leaf, node = len(order), 0, 0
    weight, joined, parent = counts[order].tolist(), [], [0] * max(2 * len(order) - 1, 0)
    for new in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):  # the two lightest of the leaves and nodes that are left
            if leaf < n and (node == len(joined) or weight[leaf] <= joined[node]):
                total, parent[leaf], leaf = total + weight[leaf], new, leaf + 1
            else:
                total, parent[n + node], node = total + joined[node], new, node + 1
        joined.append(total)
    depth = [0] * len(parent)
    for x in range(len(parent) - 2, -1, -1):
        depth[x] = depth[parent[x]] + 1
    out = np.zeros(len(counts), np.int8)
    out[order] = depth[:n]
    return out


class WaveletTree:
    """A sequence of symbols in the shape of a Huffman tree, about as many bits as its entropy and one a symbol.

    A level has a bit vector of the next code bits of all symbols whose codes go on there, node by node.  Codes grow with
    their length, so at each level the nodes that go on are those from a first prefix on.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        counts = np.bincount(symbols, minlength=size)
        self.absent = counts == 0
        self.sizes = code_lengths(counts)
        longest = int(self.sizes.max(initial=0))
        order = np.lexsort((np.arange(size), self.sizes))
        order = order[self.sizes[order] > 0]
        rest = longest - self.sizes[order].astype(np.int64)
        self.codes = np.zeros(size, np.int64)
        self.codes[order] = (np.cumsum(1 << rest) - (1 << rest)) >> rest
        self.levels = []
        for level in range(longest):
            code, left = self.codes[symbols], self.sizes[symbols] - level
            node = code >> left
            first = int(node[0])
            node -= first
            bit = (code >> (left - 1)) & 1
            starts = np.append(0, np.cumsum(np.bincount(node)))
            bits = Bits(bit)
            before = bits.ones(starts)
            self.levels.append((bits, first, starts[:-1].astype(np.int32), before[:-1].astype(np.int32)))
            # Stable within each node: zeros, then ones.
            zeros = np.diff(starts) - np.diff(before)
            ones = np.cumsum(bit) - bit - before[node]
            place = np.where(bit == 1, starts[node] + zeros[node] + ones, np.arange(len(node)) - ones)
            moved = np.empty_like(symbols)
            moved[place] = symbols
            symbols = moved[self.sizes[moved] > level + 1]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs among the first i; i may have rows of places."""
        sizes = self.sizes[symbol]
        order = np.argsort(-sizes, kind="stable")  # those with longer codes go on
        sizes, code, at = sizes[order], self.codes[symbol[order]], i[..., order]
        active = len(sizes) - np.cumsum(np.bincount(sizes, minlength=len(self.levels) + 1))
        for n, left, (bits, first, starts, before) in zip(active.tolist(), range(len(self.levels)), self.levels, strict=False):
            if n == 0:
                break
            shift = sizes[:n] - left
            node = (code[:n] >> shift) - first
            ones = bits.ones(at[..., :n] + starts[node]) - before[node]
            at[..., :n] = np.where((code[:n] >> (shift - 1)) & 1, ones, at[..., :n] - ones)
        out = np.empty_like(at)
        out[..., order] = at
        return np.where(self.absent[symbol], 0, out)

    @property
    def nbytes(self) -> int:
        return sum(bits.nbytes + starts.nbytes + before.nbytes for bits, _, starts, before in self.levels) + self.absent.nbytes + self.sizes.nbytes + self.codes.nbytes


def suffix_order(keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and whether each differs from the one before it in its first `length` symbols.

    Prefix doubling, for building the index only.  Ranks are dense at every depth; once the largest power of two within
    length is reached, two of them tell the first `length` symbols apart.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank, depth, known = np.empty(n, np.int64), 1, None

    def ranked(ordered: np.ndarray) -> None:
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))

    ranked(keys[order])
    while True:
        if known is None and 2 * depth > length:
            known = rank.copy(), depth
        if rank[order[-1]] == n - 1 and known is not None:
            break
        later = np.full(n, -1)
        later[: n - depth] = rank[depth:]
        both = rank * (n + 1) + later + 1
        order = np.argsort(both)
        ranked(both[order])
        depth *= 2
    own, reach = known
    later = own[np.minimum(order + (length - reach), n - 1)]
    own = own[order]
    return order, np.append(True, (own[1:] != own[:-1]) | (later[1:] != later[:-1]))


class FMIndex:
    """Segments of symbols, each ended by 0, searched backward; symbols are 1 to size - 1.

    What is kept is the wavelet tree over the Burrows-Wheeler transform, where each symbol begins, and one bit a suffix
    with counts for rank and select: whether it differs from the one before in its first `length` symbols.  No suffix array,
    and nothing else of its size, is kept.
    """

    def __init__(self, symbols: np.ndarray, size: int, length: int):
        self.n, self.length = len(symbols), length
        ends = symbols == 0
        # Separators differ from each other, so no window reaches over one.
        order, head = suffix_order(np.where(ends, np.cumsum(ends) - 1, int(ends.sum()) + symbols), length)
        self.tree = WaveletTree(symbols[order - 1], size)
        self.before = np.append(0, np.cumsum(np.bincount(symbols, minlength=size)))[:-1]
        # A last one after the suffixes ends the last interval.
        self.heads = Bits(np.append(head, True))

    @property
    def nbytes(self) -> int:
        return self.tree.nbytes + self.before.nbytes + self.heads.nbytes

    def shortened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number and the interval of the suffixes that agree with the one at low in `length` symbols."""
        number = self.heads.ones(low + 1) - 1
        return number, self.heads.select(number), self.heads.select(number + 1)

    def step(self, symbol: np.ndarray, both: np.ndarray) -> np.ndarray:
        """The intervals (low in the first row, high in the second) of the matches with symbol before them."""
        return self.before[symbol] + self.tree.rank(symbol, both)

    def longest(self, sequences: np.ndarray, place: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval and length of the longest match that begins at each place, of at most so many symbols."""
        out = np.stack([np.zeros(len(place), np.int64), np.full(len(place), self.n), np.zeros(len(place), np.int64)])
        for size in range(int(most.max(initial=0)), 0, -1):
            left = np.flatnonzero((out[2] == 0) & (most >= size))
            both = out[:2, left]
            for back in range(size - 1, -1, -1):
                both = self.step(sequences[place[left] + back], both)
                left, both = left[both[0] < both[1]], both[:, both[0] < both[1]]
            out[:2, left], out[2, left] = both, size
        return tuple(out)

    def matches(self, sequences: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of sequences[at[i]:at[i + 1]]: where backward search holds `length` symbols, the first
        symbol's place in sequences, the number of the interval that it found, and the interval's size.

        All sequences go from right to left together, longer ones further.  A match that grew beyond `length` symbols
        gives up its last one, and more where it does not fit.
        """
        sizes = np.diff(at)
        by = np.argsort(-sizes, kind="stable")
        ends, sizes = at[1:][by], sizes[by]
        longest = int(sizes.max(initial=0))
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        both = np.stack([np.zeros(len(by), np.int64), np.full(len(by), self.n)])
        held = np.zeros(len(by), np.int64)
        found = [(np.zeros(0, np.int64),) * 3]
        for t, n in enumerate(active.tolist()):
            place = ends[:n] - 1 - t
            symbol = sequences[place]
            low, high = self.step(symbol, both[:, :n])
            size = held[:n] + 1
            lost = np.flatnonzero(low >= high)
            if len(lost):
                low[lost], high[lost], size[lost] = self.longest(sequences, place[lost], size[lost] - 1)
            full = np.flatnonzero(size >= self.length)
            number, low[full], high[full] = self.shortened(low[full])
            found.append((place[full], number, high[full] - low[full]))
            size[full] = self.length
            both[0, :n], both[1, :n], held[:n] = low, high, size
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def match_by_fm_index(segments: Segments, length: int) -> np.ndarray:
    """Windows of words that also start in a smaller document, or earlier in their own.

    The shard's segments are indexed and streamed through the index.  Windows are equal where the search gives one
    interval; its smallest document, and its first place in each document, are taken over all windows that gave it.
    """
    text = segments.text
    word_at = np.append(0, np.flatnonzero(text == 32) + 1)
    coded = binary(text, word_at).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64) + 1
    at = np.searchsorted(word_at, segments.at)
    sizes = np.diff(at)
    # The indexed text: each segment and a separator.
    symbols = np.zeros(len(codes) + len(sizes), np.int64)
    symbols[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes
    index = FMIndex(symbols, len(coded.dictionary) + 1, length)
    place, number, _ = index.matches(codes, at)
    windows = sizes - length + 1
    if len(place) != windows.sum():
        raise ValueError("a window of an indexed segment was not found")
    by_place = np.empty(len(codes), np.int64)
    by_place[place] = number
    number = by_place[spread(at[:-1], windows)]

    least = np.full(len(symbols), np.iinfo(np.int64).max)
    np.minimum.at(least, number, np.repeat(segments.least_doc(), windows))
    n = windows[segments.content]
    number = number[spread((np.cumsum(windows) - windows)[segments.content], n)]
    smaller = least[number] < np.repeat(segments.doc_id, n)
    start = spread(segments.start.astype(np.int64), n)
    _, source = np.unique(segments.source, return_inverse=True)
    key = number * len(segments.source) + np.repeat(source, n)
    order = np.argsort(key)
    head = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    first = np.repeat(np.minimum.reduceat(start[order], head), np.diff(np.append(head, len(order))))
    earlier = np.empty(len(order), bool)
    earlier[order] = start[order] > first
    return smaller | earlier


def remove_repeated_words(df: DataFrame, length: int = 20, parts: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_text and kept_sha256 of every row.

    A word goes if a window of length words that covers it has an equal window that starts earlier: in a document
    with a smaller id, or before it in the same document.  Windows are judged on the input.

    A null text has no words; a null id orders before every other and stays null; rows with one id do not remove
    each other's words; repeated rows are answered each; an empty table gives no rows.
    """
    width = fr.partitions(df.sparkSession)
    finder = Finder(word_units, match_by_fm_index, length, 8, True, parts or 2 * width, shards or 4 * width, hot_runs)

    def rows_of(units: Units, ids: np.ndarray, spans: Spans, table: pa.Table) -> pd.DataFrame:
        kept = kept_texts(units.text, units.at[units.docs], units.at[spans.first], units.at[spans.end], strip=1)
        removed, n_spans = spans.per_doc(len(ids))
        return pd.DataFrame({"doc_id": fr.nullable(ids), "n_words": np.diff(units.docs), "n_removed": removed, "n_spans": n_spans, "kept_sha256": sha256(kept), "kept_text": [t.decode("utf-8") for t in kept]})

    schema = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return remove_repeats(fr.with_text(df, id_col, text_col), finder, rows_of, schema)
