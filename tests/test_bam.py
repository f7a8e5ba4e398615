"""BAM files of small blocks, read in small splits, against the same records as SAM."""

import random
import struct
import zlib

import pytest

from strandweave.session import ship
from strandweave.sources import bam, text

EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzf(data, size):
    """Blocks of size bytes each, whatever records end where."""
    out = []
    for a in range(0, len(data), size):
        piece = data[a : a + size]
        made = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = made.compress(piece) + made.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join(out) + EOF


def encoded(line, names):
    qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq = line
    ops, n = [], ""
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | bam.CIGAR_OPS.index(c))
            n = ""
    tags = b"NMC\x02" + b"RGZx y\0" + b"ZBBs" + struct.pack("<i2h", 2, 5, -5)
    letters = "" if seq == "*" else seq
    if len(ops) > 65535:
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(letters) << 4 | 4, 100 << 4 | 3]
    ref = names.index(rname) if rname != "*" else -1
    other = -1 if rnext == "*" else ref if rnext == "=" else names.index(rnext)
    codes = [bam.LETTERS.index(c) for c in letters] + [0] * (len(letters) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    name = qname.encode() + b"\0"
    body = bam.FIELDS.pack(ref, pos - 1, len(name), mapq, 0, len(ops), flag, len(letters), other, pnext - 1, tlen) + name + struct.pack(f"<{len(ops)}I", *ops) + packed + b"\xff" * len(letters) + tags
    return struct.pack("<i", len(body)) + body


def lines_of(n, long=()):
    rng = random.Random(9)
    out = []
    for i in range(n):
        size = rng.randrange(1, 60) if i not in long else 9000
        a = rng.randrange(0, size)
        cigar = "".join(f"{k}{op}" for k, op in ((a, "S"), (size - a, "M"), (rng.randrange(0, 3), "D")) if k)
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        rname = "ref1" if rng.random() < 0.8 else "other"
        out.append((f"r{i // 2}", (99 if i % 2 else 147) if i % 4 < 2 else 0, rname, rng.randrange(1, 500), rng.randrange(0, 61), cigar, "=" if rname == "ref1" or i % 3 else "ref1", rng.randrange(1, 500), rng.randrange(-300, 300), seq))
    return [*out, ("gone", 4, "*", 0, 0, "*", "*", 0, 0, "*")]


def written(folder, lines, size):
    names = [("ref1", 9500), ("other", 9500)]
    head = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in names)
    (folder / "s.sam").write_text(head + "".join("\t".join([*map(str, x), "*"]) + "\n" for x in lines))
    data = b"BAM\x01" + struct.pack("<i", len(head)) + head.encode() + struct.pack("<i", len(names))
    data += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in names)
    (folder / "s.bam").write_bytes(bgzf(data + b"".join(encoded(x, [n for n, _ in names]) for x in lines), size))
    return str(folder / "s.sam"), str(folder / "s.bam")


@pytest.mark.parametrize(("size", "split"), [(200, 700), (4000, 1500), (65280, 1 << 20)])
def test_same_records_as_sam(spark, tmp_path, size, split):
    """Blocks that end within records, splits without a record's begin, and one record over many splits."""
    ship(spark)
    sam, binary = written(tmp_path, lines_of(300, long={150}), size)
    want = [tuple(r)[1:] for r in text.sam(spark, sam).orderBy("rec_id").collect()]
    frame = bam.bam(spark, binary, split)
    assert [tuple(r)[1:] for r in frame.orderBy("rec_id").collect()] == want
    assert frame.rdd.getNumPartitions() > 5 or split > 10000
    assert text.sam_header(spark, binary).first() == text.sam_header(spark, sam).first()


def test_same_reads_as_sam(spark, tmp_path):
    ship(spark)
    sam, binary = written(tmp_path, lines_of(60), 500)
    columns = ["name", "l", "l_off", "r", "r_off"]
    one, two = (sorted(map(tuple, text.short_reads(spark, p).select(*columns).collect())) for p in (sam, binary))
    assert one == two
    assert len(one) > 10
    assert sorted(r["seq"] for r in text.long_reads(spark, binary).collect()) == sorted(r["seq"] for r in text.long_reads(spark, sam).collect())


def test_long_cigar_and_damage(tmp_path):
    seq = "A" * 65_600
    cigar = "1M1I" * 32_800
    line = ("x", 0, "ref1", 5, 60, cigar, "*", 0, 0, seq)
    _, binary = written(tmp_path, [line], 30_000)
    file = bam.Bytes(binary)
    head = bam.header(file)
    (_, data), = bam.records_of(file, head, 0, file.size)
    assert bam.record(data, ["ref1", "other"])[5] == cigar
    broken = bytearray((tmp_path / "s.bam").read_bytes())
    broken[60] ^= 255
    (tmp_path / "t.bam").write_bytes(broken)
    with pytest.raises((ValueError, zlib.error)):
        bam.header(bam.Bytes(str(tmp_path / "t.bam")))
    with pytest.raises(ValueError, match="no block|no BAM"):
        bam.header(bam.Bytes(__file__))


def test_every_split_of_a_file(tmp_path):
    """However a file is cut in two, both parts together have each record once."""
    _, binary = written(tmp_path, lines_of(40), 150)
    file = bam.Bytes(binary)
    head = bam.header(file)
    whole = [at for at, _ in bam.records_of(file, head, 0, file.size)]
    assert len(whole) == 41
    for cut in range(1, file.size, 37):
        assert [at for a, b in ((0, cut), (cut, file.size)) for at, _ in bam.records_of(file, head, a, b)] == whole
