"""Packing token sequences into windows of fixed length with few open windows a task."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import frames as fr

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "unit", "ids"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, unit long, ids binary"


class Packer:
    """At most `open_windows` windows are open; a piece goes where it leaves least room.

    Where it fits nowhere and no more windows may open, the fullest window goes out.  If more than `slack`
    tokens of it are free, the head of the piece fills it first, so a window that goes out has at most
    `slack` tokens of padding.
    """

    def __init__(self, size: int, open_windows: int, slack: int):
        self.size, self.limit, self.slack = size, open_windows, slack
        self.open: list[tuple[int, list]] = []  # (tokens free, pieces)
        self.full: list[list] = []

    def add(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        """ids are a stretch of one document from start on; doc is (doc_id, doc_tokens)."""
        while len(ids) >= self.size:
            self.full.append([(doc, start, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            fits = [(free, i) for i, (free, _) in enumerate(self.open) if free >= len(ids)]
            if fits:
                free, i = min(fits)
                self.open[i][1].append((doc, start, ids))
                self.open[i] = (free - len(ids), self.open[i][1])
                if free == len(ids):
                    self.full.append(self.open.pop(i)[1])
                return
            if len(self.open) < self.limit:
                self.open.append((self.size - len(ids), [(doc, start, ids)]))
                return
            i = min(range(len(self.open)), key=lambda k: self.open[k][0])
            free, pieces = self.open.pop(i)
            if free > self.slack:
                pieces.append((doc, start, ids[:free]))
                start, ids = start + free, ids[free:]
            self.full.append(pieces)

    def rows(self, base: int, first: int, last: bool) -> tuple[list[tuple], int]:
        """Rows of the windows that went out since, and with last of the open ones, which keep their ids."""
        out = []
        done, self.full = self.full, []
        for kept, windows in ((False, done), (True, [p for _, p in self.open] if last else [])):
            for pieces in windows:
                offset = 0
                for (doc_id, tokens), start, ids in pieces:
                    raw = ids.astype("<u4").tobytes()
                    out.append((doc_id, start, len(ids), zlib.crc32(raw), tokens, base + first, offset, base >> 32 if kept else -1, raw if kept else None))
                    offset += len(ids)
                first += 1
        return out, first


def _merger(size: int, fan_in: int, base: int):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["unit"].iloc[0]) // fan_in
        packer = Packer(size, 1, 0)
        for row in frame.sort_values(["sequence_id", "offset"]).itertuples(index=False):
            packer.add((row.doc_id, row.doc_tokens), row.start, np.frombuffer(row.ids, "<u4"))
        rows, _ = packer.rows(base + (group << 32), 0, True)
        out = pd.DataFrame(rows, columns=COLUMNS)
        return out.assign(unit=np.where(out["unit"] < 0, -1, group))

    return merge


def pack_documents(df: DataFrame, path: str, size: int = 2048, end_id: int = 1, open_windows: int = 32, slack: int = 16, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of sequences of at most size ids.

    Every task packs its own documents online and leaves at most open_windows windows open.  What is left is
    merged fan_in tasks at a time, cutting pieces to fill windows, until one open window is left in all.  So
    only a bounded number of ids a task moves, and padding is at most slack a sequence, but for the last one.

    A null text is an empty document, which is the end id alone; a null id stays null; repeated rows are packed
    each; an empty table gives no rows.  sequence_id is unique, not gapless.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, first, packer = TaskContext.get().partitionId() << 32, 0, Packer(size, open_windows, slack)
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in COLUMNS])

        def batch(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first
            rows, first = packer.rows(base, first, last)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for table in fr.batches_of(batches):
            ids, ends = bpe.encode_table(table, path)
            for doc_id, a, b in zip(fr.ids_of(table.column("doc_id")).tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                packer.add((doc_id, b - a + 1), 0, np.append(ids[a:b], np.uint32(end_id)))
            yield from batch(False)
        yield from batch(True)

    placed = fr.stored(fr.with_text(df, id_col, text_col).mapInArrow(fr.tidy_task(run), SCHEMA))
    done, left = [placed.where("unit < 0")], placed.where("unit >= 0")
    top, level = left.agg(F.max("unit")).first()[0], 0
    while top is not None:
        level += 1
        merge = _merger(size, fan_in, level << 56)
        merged = fr.stored(left.groupBy(F.floor(F.col("unit") / fan_in).alias("fan")).applyInPandas(fr.tidy_group(merge), SCHEMA))
        done.append(merged.where("unit < 0"))
        left = merged.where("unit >= 0")
        if top < fan_in:
            done.append(left)
            break
        top //= fan_in
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(int(fr.NULL_ID)))).drop("unit", "ids")
