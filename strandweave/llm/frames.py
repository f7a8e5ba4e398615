"""Helpers that every operator here shares: stored intermediates, document blocks and packed rows.

A *block* is a few MB of consecutive documents of one scan task, kept as one row whose payload is a
zstd-compressed Arrow IPC stream.  Per-block work is vectorised in the task, and what blocks exchange
(distinct words, anchor hashes, n-grams) travels as one packed row per block and hash bucket, so a
hot word, line or passage costs one entry a block and never one row an occurrence.
"""

from __future__ import annotations

import ctypes
import json
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20

#: The order of a missing id: before every other one.
NULL_ID = np.iinfo(np.int64).min

BLOCK_SCHEMA = "block long, payload binary"
PART_SCHEMA = "block long, part int, payload binary"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once to spark.checkpoint.dir; lineage ends there and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What queries that are made and run in here have shuffled is deleted when each ends; store what they return."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of a few bytes each (ids, marks) that are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 1 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast where it has at most limit rows; they are counted."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str, hot_share: int = 1024) -> DataFrame:
    """rows with the columns of their group (stored, one row a binary key, with the number of its rows as size).

    Groups of at least 1/hot_share of all rows, at most hot_share of them by counting, are broadcast; the others are
    joined.  Rows of hot groups get a key of their own there, from the column spread; whether that is a group's by
    chance does not matter, as what was broadcast stands.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * hot_share >= max(total, 2 * hot_share)
    columns = [c for c in groups.columns if c != key]
    hot = groups.where(is_hot).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in columns])
    cold = groups.where(~is_hot).select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in columns])
    keyed = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    keyed = keyed.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.col(spread).cast("string").cast("binary")))
    met = keyed.join(cold, F.col("_key") == F.col("_cold"), "left")
    return met.select(*rows.columns, *[F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in columns])


def give_back() -> None:
    """Returns to the system what this process has freed; else it stays with a Python worker until the session ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def tidy_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function of a task's batches, that gives memory back at the end of the task."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def tidy_group(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """run, a function of a group's rows, that gives memory back after each group."""

    def tidied(frame: pd.DataFrame) -> pd.DataFrame:
        out = run(frame)
        give_back()
        return out

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table_to_bytes(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def bytes_to_table(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def arrays_to_bytes(**columns: np.ndarray) -> bytes:
    """Arrays of unequal length, compressed in one go; short, as most of them are sent in small pieces."""
    head = json.dumps([[name, v.dtype.str, len(v)] for name, v in columns.items()]).encode()
    body = b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(v).tobytes() for v in columns.values())])
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(body, asbytes=True)


def bytes_to_arrays(payload: bytes) -> dict[str, np.ndarray]:
    body = pa.decompress(payload[8:], decompressed_size=int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(body[:4], "little")
    out = {}
    for name, kind, n in json.loads(body[4:at]):
        out[name] = np.frombuffer(body, kind, n, at)
        at += out[name].nbytes
    return out


def with_text(df: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """id as long, text as valid UTF-8 (null: empty), and other columns under their own names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), *others)


def batches_of(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The same rows in order, cut where the texts of a piece reach limit bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + limit - size, side="right"))
            stop = max(stop, start + (not held))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - before)
            if stop < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as uint8, and the n+1 offsets of the documents."""
    data, lengths = [], []
    for chunk in column.chunks:
        if not len(chunk):
            continue
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_string(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        lengths.append(np.diff(offsets))
        raw = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] is not None else np.zeros(0, np.uint8)
        data.append(raw[offsets[0] : offsets[-1]])
    if not lengths:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.concatenate(data), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Ids for ordering, NULL_ID where missing."""
    return pa.compute.fill_null(column, int(NULL_ID)).to_numpy().astype(np.int64)


def numbered(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """Blocks with ids that stay the same when the same scan task runs again."""
    part = TaskContext.get().partitionId()
    for n, table in enumerate(batches_of(batches, limit)):
        yield (part << 32) | n, table


def block_rows(df: DataFrame, pack: Callable[[pa.Table], bytes] = table_to_bytes, limit: int = BLOCK_BYTES, pick: Callable[[int], bool] = lambda _: True) -> DataFrame:
    """One row (block, payload) for each few MB of df's column text, of the blocks that pick takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in numbered(batches, limit):
            if not pick(block):
                continue
            yield pa.RecordBatch.from_pydict({"block": [block], "payload": [pack(table)]}, schema=pa.schema([("block", pa.int64()), ("payload", pa.binary())]))

    return df.mapInArrow(tidy_task(run), BLOCK_SCHEMA)


def part_rows_of(df: DataFrame, split: Callable[[pa.Table], list[tuple[int, bytes]]], limit: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, part, payload) that split makes of each block of df, numbered as in block_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in numbered(batches, limit):
            yield _parts(block, split(table))

    return df.mapInArrow(tidy_task(run), PART_SCHEMA)


def _parts(block: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
    return pa.RecordBatch.from_pydict({"block": [block] * len(rows), "part": [p for p, _ in rows], "payload": [x for _, x in rows]}, schema=schema)


def part_rows(blocks: DataFrame, split: Callable[[int, bytes], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Rows (block, part, payload) that split makes of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                yield _parts(block, list(split(block, payload.as_py())))

    return blocks.mapInArrow(tidy_task(run), PART_SCHEMA)


def by_part(parts: DataFrame, answer: Callable[[list[bytes]], Iterator[bytes]]) -> DataFrame:
    """All rows of a part meet in one task; answer gives one payload for each, in the same order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", kind="stable")
        return frame.assign(payload=list(answer(frame["payload"].tolist())))

    return parts.groupBy("part").applyInPandas(tidy_group(run), PART_SCHEMA)


def by_block(blocks: DataFrame, parts: list[DataFrame], finish: Callable[[int, bytes, list[dict[int, bytes]]], pd.DataFrame], schema: str) -> DataFrame:
    """Blocks meet the answers of their parts; finish(block, payload, [part -> answer of each frame]) makes the rows."""
    n = len(parts)
    rows = blocks.select("block", F.lit(-1).alias("kind"), F.lit(0).alias("part"), "payload")
    for kind, frame in enumerate(parts):
        rows = rows.unionByName(frame.select("block", F.lit(kind).alias("kind"), "part", "payload"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["kind"] == -1
        if own.sum() != 1:
            raise ValueError("a block was cut differently when it was read again; store the input first")
        answers: list[dict[int, bytes]] = [{} for _ in range(n)]
        for kind, part, payload in zip(frame["kind"], frame["part"], frame["payload"], strict=True):
            if kind >= 0:
                answers[kind][part] = payload
        return finish(int(frame["block"].iloc[0]), frame.loc[own, "payload"].iloc[0], answers)

    return rows.groupBy("block").applyInPandas(tidy_group(run), schema)


def nullable(ids: np.ndarray) -> pd.Series:
    """Ids for output: NULL_ID is null again."""
    return pd.Series(ids, dtype="Int64").mask(pd.Series(ids == NULL_ID))
