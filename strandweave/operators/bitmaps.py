"""Inverted indexes of minors as bitmaps of reads, and the sizes of their intersections.

A minor's reads are bits of bitmaps, one for each bucket of 32,768 read ids that has any of them.  All bitmaps of a bucket
meet in one task, where a pair's common reads are the bits of their AND.  That suits minors that many reads have; rare
ones, as noise makes them, are paired more cheaply by joining their reads (`linkage.joint_counts`), as a bucket compares
all of its minors.  A bucket holds 4 kB a minor, and the minors are bounded by the reference's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linkage import KEYS

#: Fixed value: read ids in a bucket.
BUCKET = 32_768

#: Minors of a bucket that are compared at once.
TILE = 64


def index(cells: DataFrame) -> DataFrame:
    """pos, allele, bucket and bits of the cells (read_id, pos, allele); N has bitmaps like any letter, a null read_id none."""
    rows = cells.where("read_id is not null")
    return rows.groupBy("pos", "allele", F.bitmap_bucket_number("read_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("read_id")).alias("bits"))


def sizes(bitmaps: DataFrame) -> DataFrame:
    """pos, allele and n: on how many reads each minor is."""
    return bitmaps.groupBy("pos", "allele").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def reads_of(bitmaps: DataFrame) -> DataFrame:
    """The index turned back into read_id, pos and allele."""

    def listed(frames):
        for frame in frames:
            parts = []
            for row in frame.itertuples(index=False):
                on = np.flatnonzero(np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little"))
                # Positive ids are in the buckets from 1 on, upwards; others from 0 down, downwards.
                ids = (row.bucket - 1) * BUCKET + 1 + on if row.bucket > 0 else row.bucket * BUCKET - on
                parts.append(pd.DataFrame({"read_id": ids, "pos": row.pos, "allele": row.allele}))
            if parts:
                yield pd.concat(parts)

    return bitmaps.mapInPandas(listed, "read_id long, pos int, allele string")


def intersections(bitmaps: DataFrame) -> DataFrame:
    """p1, a1, p2, a2 and n, p1 < p2: how many reads have both minors, where any has."""

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pos", "allele"])
        pos, allele = frame["pos"].to_numpy(), frame["allele"].to_numpy()
        words = np.stack([np.frombuffer(b, np.uint64) for b in frame["bits"]])
        out = []
        for a in range(0, len(words), TILE):
            for b in range(a, len(words), TILE):
                both = np.bitwise_count(words[a : a + TILE, None] & words[None, b : b + TILE]).sum(axis=2, dtype=np.int64)
                i, j = np.nonzero(both)
                later = pos[i + a] < pos[j + b]
                i, j = i[later], j[later]
                out.append(pd.DataFrame({"p1": pos[i + a], "a1": allele[i + a], "p2": pos[j + b], "a2": allele[j + b], "n": both[i, j]}))
        return pd.concat(out, ignore_index=True)

    # A row a pair and bucket, added up before it is sent on.
    found = bitmaps.groupBy("bucket").applyInPandas(pairs, "p1 int, a1 string, p2 int, a2 string, n long")
    return found.groupBy(*KEYS).agg(F.sum("n").alias("n"))
