"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the bag of the 2- to 4-grams of characters of its words, their borders included, each hashed to a row of an
embedding table; the mean of the rows goes through a linear layer.  Both are trained by stochastic gradient descent in
numpy, on a bounded sample of labelled documents.  As all of it is linear up to the softmax, prediction keeps the product
of the two tables, one number a bucket and language, and adds up each distinct word of a piece of text once.

How sure the softmax is depends on how much text it saw: the logits' scale is a power of the number of subwords,
fitted on sampled documents that the tables were not trained on.  The same documents give the score from which on a
prediction is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames as fr
from .anchors import mix
from .resampling import words_of

#: Rows of the embedding table, and their width.
BUCKETS, WIDTH = 1 << 16, 16
GRAMS = (2, 3, 4)
NO_LETTERS = r"\P{L}+"
#: The answer where there is nothing to go by.
UNKNOWN = "und"
PIECE_BYTES = 1 << 18

#: The words of each stretch that a sampled document gives; stretches lie evenly over the whole document.
STRETCHES = (2, 4, 8, 16, 32, 64)
EXAMPLE_SCHEMA = "doc_id long, lang string, stretch int, grams binary, counts binary"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all subwords of the words, and which word each is of."""
    letters = np.frombuffer(("\n" + "".join(f"{w}\n" for w in words)).encode("utf-32-le"), np.uint32).astype(np.uint64)
    border = letters == 10
    word = np.cumsum(border) - 1
    found, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in GRAMS:
        count = len(letters) - n + 1
        if count <= 0:
            continue
        inside = np.ones(count, bool)
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = mix(h + letters[k : k + count])
            if 0 < k < n - 1:
                inside &= ~border[k : k + count]
        found.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(word[:count][inside])
    return np.concatenate(found), np.concatenate(owner)


def _listed(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the places of all words among them, and where each text's begin (with the end)."""
    words, docs = words_of(pc.utf8_lower(texts), NO_LETTERS)
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().astype(np.int64), docs


def examples(df: DataFrame) -> DataFrame:
    """Stretches of each document (doc_id, text, lang) as buckets of subwords with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("stretch", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
        for table in fr.batches_of(batches, PIECE_BYTES):
            for batch in table.to_batches():
                spelled, place, docs = _listed(batch.column("text"))
                rows = []
                for k, (doc_id, lang) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                    n = int(docs[k + 1] - docs[k])
                    for s, size in enumerate(STRETCHES):
                        first = int(docs[k]) + s * max(n - size, 0) // (len(STRETCHES) - 1)
                        own = place[first : min(first + size, int(docs[k + 1]))]
                        grams, counts = np.unique(subwords([spelled[i] for i in own])[0], return_counts=True)
                        rows.append((doc_id, lang, s, grams.astype("<u2").tobytes(), np.minimum(counts, 65535).astype("<u2").tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return df.mapInArrow(run, EXAMPLE_SCHEMA)


@dataclass
class Bags:
    """Examples as sparse rows: entry i says that example row[i] has the subwords of bucket[i] with a share of weight[i]."""

    row: np.ndarray
    bucket: np.ndarray
    weight: np.ndarray
    size: np.ndarray
    lang: np.ndarray

    @staticmethod
    def of(rows: list, place: dict[str, int]) -> Bags:
        buckets = [np.frombuffer(r["grams"], "<u2").astype(np.int64) for r in rows]
        counts = [np.frombuffer(r["counts"], "<u2").astype(np.float64) for r in rows]
        size = np.array([c.sum() for c in counts])
        row = np.repeat(np.arange(len(rows)), [len(b) for b in buckets])
        both = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        return Bags(row, both(buckets, np.int64), both(counts, np.float64) / np.maximum(size, 1)[row], size, np.array([place[r["lang"]] for r in rows], np.int64))

    def take(self, which: np.ndarray) -> Bags:
        """These examples (ascending)."""
        first, end = np.searchsorted(self.row, which), np.searchsorted(self.row, which, side="right")
        sizes = end - first
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return Bags(np.repeat(np.arange(len(which)), sizes), self.bucket[at], self.weight[at], self.size[which], self.lang[which])

    def mean(self, table: np.ndarray) -> np.ndarray:
        """The mean row of table for each example."""
        return np.stack([np.bincount(self.row, self.weight * column[self.bucket], minlength=len(self.size)) for column in table.T], axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """table has a row a bucket and a column a language; the logits of n subwords are scaled by exp(scale[0] + scale[1] * log(1 + n))."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    scale: tuple[float, float] = (0.0, 0.0)
    threshold: float = 0.0

    def scores(self, mean: np.ndarray, size: np.ndarray) -> np.ndarray:
        return softmax((mean + self.bias) * np.exp(self.scale[0] + self.scale[1] * np.log1p(size))[:, None])


def trained(bags: Bags, langs: list[str], rounds: int, rate: float, batch: int = 32, seed: int = 7) -> Model:
    """Stochastic gradient descent on the cross entropy, with a rate that falls to nothing."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(langs))), np.zeros(len(langs))
    steps = rounds * -(-len(bags.size) // batch)
    done = 0
    for _ in range(rounds):
        order = rng.permutation(len(bags.size))
        for a in range(0, len(order), batch):
            own = bags.take(np.sort(order[a : a + batch]))
            speed = rate * (1 - done / steps)
            done += 1
            hidden = own.mean(table)
            error = softmax(hidden @ out + bias)
            error[np.arange(len(own.lang)), own.lang] -= 1
            back = error @ out.T
            out -= speed * hidden.T @ error
            bias -= speed * error.mean(axis=0)
            buckets, at = np.unique(own.bucket, return_inverse=True)
            for k in range(WIDTH):
                table[buckets, k] -= speed * np.bincount(at, own.weight * back[own.row, k], minlength=len(buckets))
    return Model(langs, (table @ out).astype(np.float32), bias)


def calibrated(model: Model, bags: Bags, precision: float, steps: int = 400) -> Model:
    """The same model with the scale that makes the bags likeliest, and the lowest threshold above which that share is right."""
    if not len(bags.size):
        return model
    mean, logs, truth = bags.mean(model.table) + model.bias, np.log1p(bags.size), np.arange(len(bags.size))
    a, b, speed = 0.0, 0.0, 0.2
    for _ in range(steps):
        times = np.exp(a + b * logs)
        p = softmax(mean * times[:, None])
        # The loss by the log of the scale: what the logits expect less what the right one has.
        slope = times * ((p * mean).sum(axis=1) - mean[truth, bags.lang])
        a, b = a - speed * np.clip(slope.mean(), -1, 1), b - speed * np.clip((slope * logs).mean(), -1, 1) / 10
    p = softmax(mean * np.exp(a + b * logs)[:, None])
    score = p.max(axis=1)
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(p.argmax(axis=1)[order] == bags.lang[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    return Model(model.langs, model.table, model.bias, (float(a), float(b)), float(score[order[good[-1]]]) if len(good) else 1.0)


def learn(df: DataFrame, per_lang: int = 300, most_langs: int = 1000, rounds: int = 5, rate: float = 0.3, precision: float = 0.99) -> Model:
    """A model of the languages of df (doc_id, text, lang, none of them null).

    It is fitted on a sample of about per_lang documents a language, by a hash of the id, of the most_langs most
    frequent languages; of each document it takes six stretches of 2 to 64 words, from all over the text.  A fifth of the
    sampled documents calibrate it.
    """
    counts = df.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    langs = {r["lang"]: r["n"] for r in counts.collect()}
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    unit = 1 << 30
    share = df.sparkSession.createDataFrame([(v, min(unit, per_lang * unit // n)) for v, n in langs.items()], "lang string, most long")
    picked = df.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(unit)) < F.col("most"))
    rows = examples(picked.select("doc_id", "text", "lang")).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5))).collect()  # a bounded sample
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["stretch"], r["grams"]))
    names = sorted(langs)
    place = {v: k for k, v in enumerate(names)}
    fit, rest = (Bags.of([r for r in rows if (r["fold"] == 0) == held], place) for held in (False, True))
    return calibrated(trained(fit, names, rounds, rate), rest, precision)


def predict(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for table in fr.batches_of(batches, PIECE_BYTES):
            for batch in table.to_batches():
                spelled, place, docs = _listed(batch.column("text"))
                bucket, word = subwords(spelled)
                ends, first = docs[1:], docs[:-1] + np.arange(batch.num_rows)
                # Every text's segment ends in a zero, so that none is empty.
                total = lambda x: np.add.reduceat(np.insert(x[place], ends, 0), first)  # noqa: E731, B023
                size = total(np.bincount(word, minlength=len(spelled)))
                sums = [total(np.bincount(word, column[bucket], minlength=len(spelled))) for column in own.table.T]
                p = own.scores(np.stack(sums, axis=1) / np.maximum(size, 1)[:, None], size)
                best = p.argmax(axis=1)
                score = p[np.arange(len(best)), best]
                columns = [batch.column("doc_id"), pa.array(own.langs).take(pa.array(best)), pa.array(score), pa.array(score >= own.threshold)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "accepted"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: object) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every row.

    The languages are learned from the rows with an id, a text with a letter and a language, but for those whose CRC-32 of
    the decimal id leaves 2 modulo 4; these are held_out.  Predictions take the text only, all of it.  accepted says
    whether the score (from 0 to 1, rounded to 6 digits) reaches what `precision` asks for.  A text that is null or has
    no letter is `und` with score 0 and not accepted, and so is every text where nothing is learned.  A null id stays null and
    is not held out; repeated rows are answered each; other columns are ignored; an empty table gives no rows.
    """
    docs = fr.with_text(df, id_col, text_col, F.col(lang_col).cast("string").alias("lang"))
    letter = F.col("text").rlike(r"\p{L}")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = learn(docs.where(letter & ~out & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()), **options)
    if not model.langs:
        return docs.select("doc_id", out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    none = docs.where(~letter).select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    both = predict(docs.where(letter), model).unionByName(none)
    return both.select("doc_id", out.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), "accepted")
