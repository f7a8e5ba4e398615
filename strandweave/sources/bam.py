"""BAM files, read in parallel: a Spark data source over BGZF blocks.

A file is cut into splits of compressed bytes.  A task looks for the first block in its split and, in what that holds, for the
first record: a place from which records follow each other with sound fields.  It reads all records that begin in a block
of its split, and goes on past the end for the last one's rest.  Files are opened through Arrow's file systems, so
a path may lie in any store that these reach; only the header is read on the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Compressed bytes of a split, and what is read of a file at once.
SPLIT_BYTES, READ_BYTES = 32 << 20, 1 << 20
#: Records that must follow each other for a place to count as the first record's, where the file has so many.
CHAIN = 8
#: Rows of a batch.
BATCH = 4096

#: Fixed values of the format.
CIGAR_OPS, LETTERS = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
BLOCK_MOST = 1 << 16
PAIRS = [a + b for a in LETTERS for b in LETTERS]
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
FIELDS = struct.Struct("<iiBBHHHiiii")

SCHEMA = "rec_id long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string"
ARROW = pa.schema([("rec_id", pa.int64()), *((n, pa.string() if n in ("qname", "rname", "cigar", "rnext", "seq") else pa.int32()) for n in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq"))])


class Bytes:
    """A file's bytes by place, read ahead."""

    def __init__(self, path: str):
        system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from there."""
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, READ_BYTES), max(self.size - at, 0)), at)
        return self.held[at - self.at : at - self.at + n]


def block_size(head: bytes) -> int:
    """The size of the block that begins so, or 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= min(12 + extra, len(head)):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def block_data(block: bytes) -> bytes:
    extra = struct.unpack_from("<H", block, 10)[0]
    data = zlib.decompress(block[12 + extra : -8], -15)
    crc, size = struct.unpack("<II", block[-8:])
    if zlib.crc32(data) != crc or len(data) != size:
        raise ValueError("a block's checksum is wrong")
    return data


def first_block(file: Bytes, start: int, end: int) -> int | None:
    """Where the first block at or after start begins, before end; its successor must be one too, or the end of the file."""
    at = start
    while at < end:
        found = file.get(at, READ_BYTES).find(b"\x1f\x8b\x08\x04")
        if found < 0:
            at += READ_BYTES - 3
            continue
        at += found
        if at >= end:
            return None
        size = block_size(file.get(at, BLOCK_MOST))
        if size and (at + size == file.size or block_size(file.get(at + size, BLOCK_MOST))):
            return at
        at += 1
    return None


class Stream:
    """The data of blocks from one on, with where each block begins in the file and in the data."""

    def __init__(self, file: Bytes, block: int):
        self.file, self.next = file, block
        self.data, self.base = bytearray(), 0
        self.blocks: list[tuple[int, int]] = []

    def more(self) -> bool:
        """Reads one block on; False at the end of the file."""
        if self.next >= self.file.size:
            return False
        size = block_size(self.file.get(self.next, BLOCK_MOST))
        if not size:
            raise ValueError(f"no block at {self.next}")
        self.blocks.append((self.base + len(self.data), self.next))
        self.data += block_data(self.file.get(self.next, size))
        self.next += size
        return True

    def upto(self, end: int) -> bool:
        """Whether there is data up to that place."""
        while self.base + len(self.data) < end:
            if not self.more():
                return False
        return True

    def get(self, at: int, n: int) -> bytes:
        return bytes(self.data[at - self.base : at - self.base + n])

    def forget(self, at: int) -> None:
        """Data before that place isn't needed any more."""
        del self.data[: at - self.base]
        self.base = at
        while len(self.blocks) > 1 and self.blocks[1][0] <= at:
            self.blocks.pop(0)

    def virtual(self, at: int) -> int:
        """The place in the file and in the block's data, as one number in order."""
        begin, block = next(x for x in reversed(self.blocks) if x[0] <= at)
        return block << 16 | at - begin


@dataclass
class Header:
    contigs: list[tuple[str, int]]
    block: int
    at: int


def header(file: Bytes) -> Header:
    """The contigs, and the block and the place in its data where the records begin."""
    stream = Stream(file, 0)

    def number(at: int) -> int:
        if not stream.upto(at + 4):
            raise ValueError("the header ends early")
        return struct.unpack("<i", stream.get(at, 4))[0]

    if not stream.upto(8) or stream.get(0, 4) != b"BAM\x01":
        raise ValueError("no BAM file")
    at = 8 + number(4)
    n, at = number(at), at + 4
    contigs = []
    for _ in range(n):
        size = number(at)
        length = number(at + 4 + size)
        contigs.append((stream.get(at + 4, size - 1).decode(), length))
        at += 8 + size
    stream.upto(at + 1)
    virtual = stream.virtual(at)
    return Header(contigs, virtual >> 16, virtual & 0xFFFF)


def _sound(stream: Stream, at: int, lengths: list[int]) -> int:
    """The size of the record at that place if all of its fields are possible, else 0."""
    if not stream.upto(at + 36):
        return 0
    size, ref, pos, name, _, _, ops, _, letters, other, other_pos, _ = struct.unpack("<i", stream.get(at, 4)) + FIELDS.unpack(stream.get(at + 4, 32))
    if size < 32 or name < 1 or letters < 0 or 32 + name + 4 * ops + (letters + 1) // 2 + letters > size:
        return 0
    for contig, place in ((ref, pos), (other, other_pos)):
        if not -1 <= contig < len(lengths) or place < -1 or (contig >= 0 and place >= max(lengths[contig], 1)):
            return 0
    if not stream.upto(at + 36 + name + 4 * ops):
        return 0
    text = stream.get(at + 36, name)
    if text[-1] or any(not 33 <= c <= 126 for c in text[:-1]):
        return 0
    if any(c & 15 > 8 for c in stream.get(at + 36 + name, 4 * ops)[::4]):
        return 0
    return 4 + size


def first_record(stream: Stream, end: int, lengths: list[int]) -> int | None:
    """The first place in blocks that begin before end from which records follow each other, to the end of the file or CHAIN of them."""
    at = 0
    while True:
        if not stream.upto(at + 1) or stream.virtual(at) >> 16 >= end:
            return None
        place, good = at, 0
        while good < CHAIN and (size := _sound(stream, place, lengths)):
            place, good = place + size, good + 1
        if good == CHAIN or (good and not stream.upto(place + 1) and stream.upto(place)):
            return at
        at += 1


def _long_cigar(tags: bytes) -> list[int] | None:
    """The operations that the tag CG holds, for records of more than 65,535."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            at = tags.index(0, at) + 1
        elif kind == "B":
            part, n = chr(tags[at]), struct.unpack_from("<i", tags, at + 1)[0]
            if name == b"CG" and part == "I":
                return list(struct.unpack_from(f"<{n}I", tags, at + 5))
            at += 5 + n * TAG_SIZES[part]
        else:
            at += TAG_SIZES[kind]
    return None


def record(data: bytes, contigs: list[str]) -> tuple:
    """The columns of a record, but for rec_id, as the text form has them."""
    ref, pos, name, mapq, _, ops, flag, letters, other, other_pos, length = FIELDS.unpack_from(data)
    at = 32 + name
    cigar = list(struct.unpack_from(f"<{ops}I", data, at))
    at += 4 * ops
    seq = "".join(PAIRS[b] for b in data[at : at + (letters + 1) // 2])[:letters]
    at += (letters + 1) // 2 + letters
    if ops == 2 and cigar[0] == letters << 4 | 4 and cigar[1] & 15 == 3:
        cigar = _long_cigar(data[at:]) or cigar
    rname = contigs[ref] if ref >= 0 else "*"
    rnext = "*" if other < 0 else "=" if other == ref else contigs[other]
    return data[32 : 32 + name - 1].decode(), flag, rname, pos + 1, mapq, "".join(f"{c >> 4}{CIGAR_OPS[c & 15]}" for c in cigar) or "*", rnext, other_pos + 1, length, seq or "*"


@dataclass
class Split(InputPartition):
    path: str
    number: int
    start: int
    end: int
    header: Header


class BamReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        out = []
        for number, path in enumerate(files(self.path)):
            file = Bytes(path)
            head = header(file)
            out += [Split(path, number, a, min(a + self.split_bytes, file.size), head) for a in range(0, file.size, self.split_bytes)]
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        file, head = Bytes(partition.path), partition.header
        rows: list[tuple] = []
        for at, data in records_of(file, head, partition.start, partition.end):
            rows.append((partition.number << 56 | at, *record(data, [name for name, _ in head.contigs])))
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def records_of(file: Bytes, head: Header, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The virtual place and the bytes of each record that begins in a block between start and end."""
    if start <= head.block < end:
        stream, at = Stream(file, head.block), head.at
    else:
        block = first_block(file, max(start, head.block), end)
        if block is None:
            return
        stream = Stream(file, block)
        at = first_record(stream, end, [n for _, n in head.contigs])
        if at is None:
            return
    while stream.upto(at + 4) and stream.virtual(at) >> 16 < end:
        size = struct.unpack("<i", stream.get(at, 4))[0]
        if not stream.upto(at + 4 + size):
            raise ValueError("the last record ends early")
        yield stream.virtual(at), stream.get(at + 4, size)
        at += 4 + size
        stream.forget(at)


def files(path: str) -> list[str]:
    """The file, or a folder's .bam files in order."""
    system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    if system.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    found = sorted(f.path for f in system.get_file_info(pafs.FileSelector(inner)) if f.path.lower().endswith(".bam"))
    return [f"{path.rstrip('/')}/{f.rsplit('/', 1)[1]}" for f in found]


class BamSource(DataSource):
    """spark.read.format("bam").load(path); option splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Alignment records, with rec_id in file order."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", str(split_bytes)).load(path)


def bam_header(spark: SparkSession, path: str) -> DataFrame:
    """contig, length and interval of the first contig."""
    contigs = header(Bytes(files(path)[0])).contigs[:1]
    rows = spark.createDataFrame(contigs, "contig string, length int")
    return rows.withColumn("interval", F.concat("contig", F.lit(":0-"), F.col("length").cast("string")))
