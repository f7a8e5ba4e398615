"""A quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Every word is a symbol of its own, a 48-bit hash salted with its language; words that trusted text lacks share the mass
of the open vocabulary.  Counts are sharded by the hash of the n-gram, from the highest order down.  In a part of an
order's keys the n-grams of trusted text meet the distinct n-grams that blocks of documents ask for; the blocks get whole
numbers back, and the next lower order gets what it needs: how many n-grams end in a shorter one (its continuation
count), and for a context the sum of its counts and how many of them are 1, 2 or more.  Blocks interpolate in double
precision.  All counts are taken over all trusted documents, so nothing depends on how blocks are cut.

Questions take more room than the text, so an order's parts go in rounds, and so do the blocks that meet their answers:
what a round shuffles is gone when its results are stored.  Every round reads all documents.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as fr
from .anchors import hashes, mix, split_blanks

START, END = 0, 1
#: Symbols of the open vocabulary that are no counted word: START, END and all other words.
FIRST_WORD = 3
#: Bytes of text in a block: few large ones share more n-grams; it is split into words by pieces.
BLOCK_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
#: Places whose chances are worked out at once, in double precision.
SLICE = 1 << 18
#: Bits of a symbol or an n-gram's key.
KEY_BITS = 48
#: Rounds in which an order's parts are worked on, and in which blocks meet their answers.
ROUNDS = 4

COUNTS = ("c", "total", "n1", "n2", "n3")
STATS = ("ones", "twos", "threes", "fours", "grams", "sum", "known")
LEVEL_SCHEMA = "kind int, block long, part int, payload binary, lang string, " + ", ".join(f"{c} long" for c in STATS)
ANSWER, LOWER, STATISTICS = 0, 1, 2


@dataclass(frozen=True)
class Span:
    """The parts first to end - 1 of all."""

    parts: int
    first: int
    end: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        part = (keys * np.uint64(self.parts)) >> np.uint64(KEY_BITS)
        return (part >= self.first) & (part < self.end)


def _seeds(langs: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array([*langs, None], dtype=object)[:-1], categorize=False)


def _special(which: int, seeds: np.ndarray) -> np.ndarray:
    """START or END of each language."""
    return mix(mix(seeds) + np.uint64(which + 1)) >> np.uint64(64 - KEY_BITS)


def gram_keys(words: list[np.ndarray]) -> np.ndarray:
    """The key of each n-gram; a single word's is its symbol."""
    key = words[0]
    for w in words[1:]:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + w)
    return key if len(words) == 1 else key >> np.uint64(64 - KEY_BITS)


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    most = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def _steps(ascending: np.ndarray) -> np.ndarray:
    return _small(np.diff(ascending, prepend=np.uint64(0)))


def _ascending(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _packed(**columns: np.ndarray) -> bytes:
    """Arrays, the first bytes of all items before the second ones: hashes' bytes do not compress, the others then do."""
    return fr.arrays_to_bytes(**{f"{name} {x.dtype.str}": np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.ravel() for name, x in columns.items()})


def _unpacked(payload: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, raw in fr.bytes_to_arrays(payload).items():
        name, kind = name.split(" ")
        size = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()
    return out


def _edges(ascending: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's keys begin."""
    return np.searchsorted((ascending * np.uint64(parts)) >> np.uint64(KEY_BITS), np.arange(parts + 1))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each once, and where each key is among them."""
    order = np.argsort(keys)
    keys = keys[order]
    head = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(head, dtype=np.int32) - 1
    return keys[head], place


class Grams:
    """Distinct n-grams by key: the words, the language and the whole numbers of each."""

    def __init__(self, words: list[np.ndarray], lang: np.ndarray, langs: list[str], counts: dict[str, np.ndarray], span: Span | None = None):
        """Rows of one key are added up; others than the span's are left out."""
        key = gram_keys(words)
        if span is not None:
            on = np.flatnonzero(span.holds(key))
            key, words, lang, counts = key[on], [w[on] for w in words], lang[on], {c: x[on] for c, x in counts.items()}
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        first = order[head]
        self.key, self.words, self.lang, self.langs = key[head], [w[first] for w in words], lang[first], langs
        self.counts = {c: np.add.reduceat(x[order], head, dtype=np.int64) if len(head) else x.astype(np.int64) for c, x in counts.items()}

    def packed(self, own: slice = slice(None)) -> dict[str, np.ndarray]:
        """These rows by their first word, with words as places among the distinct ones."""
        by = np.argsort(self.words[0][own])
        distinct, place = np.unique(np.concatenate([w[own][by] for w in self.words]), return_inverse=True)
        place = place.reshape(len(self.words), -1)
        arrays = {"words": _steps(distinct), "w0": _small(np.diff(place[0], prepend=0))}
        arrays |= {f"w{k}": _small(w) for k, w in enumerate(place[1:], 1)}
        arrays |= {c: _small(x[own][by]) for c, x in self.counts.items()}
        return arrays | {"lang": _small(self.lang[own][by]), "langs": np.frombuffer(json.dumps(self.langs).encode(), np.uint8)}

    def dealt(self, parts: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """Each part's rows."""
        edges = _edges(self.key, parts)
        for p in np.flatnonzero(np.diff(edges)).tolist():
            yield p, self.packed(slice(edges[p], edges[p + 1]))

    @staticmethod
    def merged(sent: list[dict[str, np.ndarray]], order: int, span: Span | None = None) -> Grams:
        langs = sorted({lang for x in sent for lang in json.loads(x["langs"].tobytes())})
        place = {lang: k for k, lang in enumerate(langs)}
        known = [_ascending(x["words"]) for x in sent]
        words = [np.concatenate([w[np.cumsum(x["w0"], dtype=np.int64)] for w, x in zip(known, sent, strict=True)])]
        words += [np.concatenate([w[x[f"w{k}"]] for w, x in zip(known, sent, strict=True)]) for k in range(1, order)]
        lang = np.concatenate([np.array([place[v] for v in json.loads(x["langs"].tobytes())], np.int64)[x["lang"]] for x in sent])
        return Grams(words, lang, langs, {c: np.concatenate([x[c] for x in sent]) for c in COUNTS if c in sent[0]}, span)

    def lower(self) -> Grams:
        """What the next lower order needs: a continuation for each n-gram's end, its count for its beginning."""
        on = self.counts["c"] > 0
        words, lang, c = [w[on] for w in self.words], self.lang[on], self.counts["c"][on]
        one, none = np.ones(len(c), np.int64), np.zeros(len(c), np.int64)
        counts = {"c": (one, none), "total": (none, c), "n1": (none, c == 1), "n2": (none, c == 2), "n3": (none, c > 2)}
        both = [np.concatenate(x) for x in zip(words[1:], words[:-1], strict=True)]
        return Grams(both, np.tile(lang, 2), self.langs, {k: np.concatenate(x) for k, x in counts.items()})

    def statistics(self) -> pd.DataFrame:
        """Counts of counts of each language; known is how many n-grams do not end in END."""
        c, known = self.counts["c"], self.words[-1] != _special(END, _seeds(self.langs))[self.lang]
        rows = []
        for k, lang in enumerate(self.langs):
            own = (self.lang == k) & (c > 0)
            rows.append((lang, *(int((c[own] == n).sum()) for n in (1, 2, 3, 4)), int(own.sum()), int(c[own].sum()), int((own & known).sum())))
        return pd.DataFrame(rows, columns=["lang", *STATS])


class Block:
    """line holds the symbols of each document between two STARTs and an END; at are the places of words and ENDs."""

    def __init__(self, table: pa.Table):
        self.doc_id, self.mark = fr.ids_of(table.column("doc_id")), table.column("mark").to_numpy()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        self.langs, self.lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        seeds = _seeds(self.langs)
        parts, sizes, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for piece in fr.batches_of(table.to_batches(), PIECE_BYTES):
            text, at, docs = split_blanks(*fr.text_bytes(piece.column("text")))
            n = np.diff(docs)
            parts.append(mix(hashes(text, at) ^ np.repeat(seeds[self.lang[doc : doc + len(n)]], n)) >> np.uint64(64 - KEY_BITS))
            sizes.append(n)
            doc += len(n)
        self.n_words = np.concatenate(sizes)
        length = self.n_words + 3
        ends = np.cumsum(length)
        self.doc = np.repeat(np.arange(len(length), dtype=np.int32), length)
        word = np.ones(len(self.doc), bool)
        for back in (1, length, length - 1):
            word[ends - back] = False
        self.line = np.empty(len(word), np.uint64)
        self.line[word] = np.concatenate(parts)
        lang = self.lang
        self.line[ends - 1] = _special(END, seeds)[lang]
        self.line[ends - length] = self.line[ends - length + 1] = _special(START, seeds)[lang]
        word[ends - 1] = True
        self.at = np.flatnonzero(word).astype(np.int32)  # a block's text is below 2 GB

    def words(self, order: int, last: np.ndarray | slice) -> list[np.ndarray]:
        """The words of the n-grams that end at these places; a slice stands for all that have one."""
        if isinstance(last, slice):
            return [self.line[k : len(self.line) - order + 1 + k] for k in range(order)]
        return [self.line[last - order + 1 + k] for k in range(order)]

    def counted(self, order: int, span: Span) -> Grams:
        """The span's n-grams of the documents that are counted."""
        last = self.at[self.mark[self.doc[self.at]] == 1]
        return Grams(self.words(order, last), self.lang[self.doc[last]], self.langs, {"c": np.ones(len(last), np.uint8)}, span)

    def keys(self, k: int, order: int) -> np.ndarray:
        """The key of the n-gram of k words that ends at each place; of the highest order, at words and ENDs only."""
        return gram_keys(self.words(k, self.at if k == order else slice(None)))

    def asked(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each order, distinct keys, and for the n-gram that ends at each place, where its key is."""
        return [_distinct(self.keys(k, order)) for k in range(1, order + 1)]


def found_in(grams: Grams | None, key: np.ndarray, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The whole numbers of these keys; 0 where trusted text has no such n-gram."""
    if grams is None or not len(grams.key):
        return {c: np.zeros(len(key), np.uint8) for c in columns}
    at = np.minimum(np.searchsorted(grams.key, key), len(grams.key) - 1)
    there = grams.key[at] == key
    return {c: _small(np.where(there, grams.counts[c][at], 0)) for c in columns}


def levels_of(split: Callable[[Callable[[Block], list[tuple[int, bytes]]]], DataFrame], order: int, parts: int, rounds: int) -> list[DataFrame]:
    """The stored rows of each order, from the highest: answers to blocks, what goes to the next lower order, statistics.

    split gives the rows (block, part, payload) that a function makes of each block.
    """

    def send(k: int, span: Span) -> Callable[[Block], list[tuple[int, bytes]]]:
        def run(own: Block) -> list[tuple[int, bytes]]:
            keys = own.keys(k, order)
            keys = np.sort(keys[span.holds(keys)])
            keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
            edges = _edges(keys, span.parts)
            counted = dict(own.counted(order, span).dealt(span.parts)) if k == order else {}
            return [(p, _packed(asked=_steps(keys[edges[p] : edges[p + 1]]), **counted.get(p, {}))) for p in range(span.first, span.end)]

        return run

    def deal(k: int, span: Span) -> Callable[[int, bytes], Iterator[tuple[int, bytes]]]:
        return lambda _, payload: ((p, _packed(**x)) for p, x in Grams.merged([_unpacked(payload)], k, span).dealt(span.parts))

    def level(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        columns = COUNTS[: 1 if k == order else 5]

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            part, out = frame["part"].iloc[0], []
            sent = [_unpacked(p) for p in frame["payload"]]
            own = [x for x in sent if "words" in x]
            grams = Grams.merged(own, k) if own else None
            for block, x in zip(frame["block"], sent, strict=True):
                if "asked" in x:
                    out.append((ANSWER, block, part, _packed(**found_in(grams, _ascending(x["asked"]), columns))))
            if grams is not None and k > 1:
                out.append((LOWER, -1, part, _packed(**grams.lower().packed())))
            made = pd.DataFrame(out, columns=["kind", "block", "part", "payload"])
            if grams is not None:
                made = pd.concat([made, grams.statistics().assign(kind=STATISTICS, block=-1, part=part)], ignore_index=True)
            made = made.reindex(columns=["kind", "block", "part", "payload", "lang", *STATS])
            return made.astype(dict.fromkeys(("block", "part", *STATS), "Int64") | {"lang": object})

        return run

    levels: list[DataFrame] = []
    for k in range(order, 0, -1):
        # Less is stored before the highest order is worked on; single words are few, and parts send rows to all parts.
        turns, own_parts = {order: max(rounds // 2, 1), 1: 1}.get(k, rounds), parts if k > 1 else max(parts // 4, 1)
        cuts = [own_parts * r // turns for r in range(turns + 1)]
        made = None
        for span in (Span(own_parts, a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a):
            rows = split(send(k, span))
            if k < order:
                lower = levels[-1].where(F.col("kind") == LOWER).select(F.lit(-1).cast("long").alias("block"), "payload")
                rows = rows.unionByName(fr.part_rows(lower, deal(k, span)))
            with fr.freed_shuffles(rows.sparkSession):
                own = fr.stored(rows.groupBy("part").applyInPandas(fr.tidy_group(level(k)), LEVEL_SCHEMA))
            made = own if made is None else made.unionByName(own)
        levels.append(made)
    return levels


def discounts(ones: float, twos: float, threes: float, fours: float) -> np.ndarray:
    """What counts of 0, 1, 2 and more are discounted by."""
    n = (ones, twos, threes, fours)
    y = ones / (ones + 2 * twos) if ones + twos else None
    return np.array([0.0] + [max(0.1, min(k - 0.1, k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and y is not None else k * 0.5)) for k in (1, 2, 3)])


def log_chances(own: Block, order: int, answers: list[list[bytes]], discount: dict[int, dict[str, np.ndarray]], base: dict[str, tuple[float, float]]) -> np.ndarray:
    """The logarithm of the chance of what stands at each place of a block, from each order's answers of all parts; nan without a model."""
    values, places = {}, []
    for k, (keys, place) in enumerate(own.asked(order), 1):
        got = [_unpacked(x) for x in answers[k - 1]]
        values |= {(c, k): np.concatenate([x[c] for x in got]) for c in (COUNTS[:1] if k == order else COUNTS)}
        if len(values["c", k]) != len(keys):
            raise ValueError("a block was cut differently when it was read again; store the input first")
        places.append(place)
        del got
    cut = {k: np.array([d.get(v, np.zeros(4)) for v in own.langs]).reshape(-1, 4) for k, d in discount.items()}
    totals, shares = (np.array([base.get(v, (np.nan, np.nan))[n] for v in own.langs]) for n in (0, 1))
    logp = np.empty(len(own.at))
    for lo in range(0, len(own.at), SLICE):
        here = slice(lo, lo + SLICE)
        at = own.at[here]
        lang = own.lang[own.doc[at]]

        def column(name: str, k: int, last: np.ndarray, here: slice = here) -> np.ndarray:
            return values[name, k][places[k - 1][here] if k == order else places[k - 1][last - k + 1]].astype(np.float64)

        p = None
        for k in range(1, order + 1):
            c = column("c", k, at)
            share = c - cut[k][lang, np.minimum(c, 3).astype(np.int8)]
            if p is None:
                p = share / totals[lang] + shares[lang]
                continue
            total = column("total", k - 1, at - 1)
            free = sum(cut[k][lang, j] * column(f"n{j}", k - 1, at - 1) for j in (1, 2, 3))
            p = np.where(total > 0, (share + free * p) / np.maximum(total, 1), p)
        logp[here] = np.log(p)
    return logp


def _round_of(block: int | Column, rounds: int) -> int | Column:
    """The round of a block: its task's number and its own within the task, added up, modulo rounds."""
    return block % ((1 << 32) - 1) % rounds


def perplexities(df: DataFrame, trusted: DataFrame, order: int = 3, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", broadcast_ids: int = fr.BROADCAST_ROWS, rounds: int = ROUNDS, files: bool = False) -> DataFrame:
    """doc_id, lang, n_words, perplexity and held_out of every row, under its language's model of trusted text.

    trusted has the ids of trusted documents.  One third of them, by a hash of the id, is held out of the counts and
    marked, for thresholds that do not favour text which the model has seen; if that leaves a language without
    counts, it has no model.  Perplexity is null for a language without a model.  order is 2 or 3 words.

    The rows are read in every round.  files tells that df comes from files as they are, so that they are cut the same way each
    time; else, and where there are more than broadcast_ids trusted ids, they are stored first.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    parts = parts or 2 * fr.partitions(df.sparkSession)
    chosen = trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chosen = chosen.withColumn("mark", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, 2).otherwise(1).cast("byte"))
    if chosen.limit(broadcast_ids + 1).count() <= broadcast_ids:
        chosen = F.broadcast(chosen)
    else:
        files = False  # rows come out of a shuffle
    docs = fr.with_text(df, id_col, text_col, F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    # 1: counted, 2: held out, 0: not trusted.
    docs = docs.join(chosen, "doc_id", "left").withColumn("mark", F.coalesce("mark", F.lit(0).cast("byte")))
    if files:

        def split(make: Callable[[Block], list[tuple[int, bytes]]]) -> DataFrame:
            return fr.part_rows_of(docs, lambda table: make(Block(table)), BLOCK_BYTES)

        def blocks_of(r: int) -> DataFrame:
            return fr.block_rows(docs, limit=BLOCK_BYTES, pick=lambda block: _round_of(block, rounds) == r)

    else:
        blocks = fr.stored(fr.block_rows(docs, limit=BLOCK_BYTES))

        def split(make: Callable[[Block], list[tuple[int, bytes]]]) -> DataFrame:
            return fr.part_rows(blocks, lambda _, payload: iter(make(Block(fr.bytes_to_table(payload)))))

        def blocks_of(r: int) -> DataFrame:
            return blocks.where(_round_of(F.col("block"), rounds) == r)

    levels = levels_of(split, order, parts, rounds)
    discount: dict[int, dict[str, np.ndarray]] = {}
    for k, level in zip(range(order, 0, -1), levels, strict=True):
        rows = level.where(F.col("kind") == STATISTICS).groupBy("lang").agg(*[F.sum(c).alias(c) for c in STATS]).collect()  # a row a language
        rows = [r for r in rows if r["grams"]]
        discount[k] = {r["lang"]: discounts(*(float(r[c]) for c in STATS[:4])) for r in rows}
    # The sum of the lowest order's counts, and what every word gets of the share that its discounts set free.
    base = {}
    for r in rows:
        d = discount[1][r["lang"]]
        free = d[1] * r["ones"] + d[2] * r["twos"] + d[3] * (r["grams"] - r["ones"] - r["twos"])
        base[r["lang"]] = (float(r["sum"]), free / r["sum"] / (FIRST_WORD + r["known"]))

    def finish(block: int, payload: bytes, found: list[dict[int, bytes]]) -> pd.DataFrame:
        own = Block(fr.bytes_to_table(payload))
        logp = log_chances(own, order, [[of.pop(p) for p in sorted(of)] for of in found], discount, base)
        n = own.n_words + 1
        sums = np.add.reduceat(logp, np.cumsum(n) - n) if len(n) else np.zeros(0)
        return pd.DataFrame({"doc_id": fr.nullable(own.doc_id), "lang": [own.langs[k] for k in own.lang], "n_words": n - 1, "perplexity": np.exp(-sums / n), "held_out": own.mark == 2})

    made = None
    for r in range(rounds):
        answers = [level.where((F.col("kind") == ANSWER) & (_round_of(F.col("block"), rounds) == r)) for level in reversed(levels)]
        with fr.freed_shuffles(df.sparkSession):
            own = fr.stored(fr.by_block(blocks_of(r), answers, finish, "doc_id long, lang string, n_words long, perplexity double, held_out boolean"))
        made = own if made is None else made.unionByName(own)
    return made.withColumn("perplexity", F.nanvl("perplexity", F.lit(None).cast("double")))


def classify(df: DataFrame, trusted: DataFrame, quantile: float = 0.99, margin: float = 1.25, prior_words: float = 20.0, **options: object) -> DataFrame:
    """doc_id, lang, n_words, perplexity, score, threshold and kept of every row.

    The score is the perplexity with prior_words words more of the language's mean, so that a few words decide
    little.  A language's threshold is margin times that quantile (within 0.01 %) of the scores of its held-out
    trusted documents.  Rows above it are not kept.  A row is kept where its language has no model or no held-out
    text, and where it has no word, as nothing then speaks against it.  A null language is a language of its own;
    a null id stays null and is never trusted; repeated rows are answered each; an empty table gives no rows.
    """
    scored = perplexities(df, trusted, **options)
    held = scored.where("held_out and perplexity is not null")

    means = fr.broadcast_if_small(held.groupBy("lang").agg((F.sum(F.log("perplexity") * (F.col("n_words") + 1)) / F.sum(F.col("n_words") + 1)).alias("mean")))
    n = F.col("n_words") + 1
    score = F.exp((F.log("perplexity") * n + F.col("mean") * prior_words) / (n + prior_words))
    limits = fr.broadcast_if_small(held.join(means, "lang").groupBy("lang").agg((F.percentile_approx(score, F.lit(quantile), F.lit(10_000)) * margin).alias("threshold")))
    rows = scored.join(means, "lang", "left").join(limits, "lang", "left").withColumn("score", score)
    kept = F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)) | (F.col("n_words") == 0)
    return rows.select("doc_id", "lang", "n_words", *[F.round(c, 6).alias(c) for c in ("perplexity", "score", "threshold")], kept.alias("kept"))
