"""SimHash near-duplicates: bit-sliced comparison of fingerprints within buckets that hold every close pair."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames as fr
from .anchors import mix
from .components import components

#: Bits of one word of a fingerprint.
BITS = 64
#: Columns that name a meeting, and one that was cut again.
MEETING, CUT = ("band", "key", "a", "b"), ("band", "key", "a", "b", "c", "d")
#: Shingles that a meeting brings together to be checked, but for single texts that have more.
MEETING_SHINGLES = 1 << 22


def shingle_hashes(text: str, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of width words, in slices; a shorter text is one shingle, none has none."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), 1 << 16):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist(), strict=True)], dtype=np.uint64)


def fingerprint_of(hashes: Iterable[np.ndarray], words: int = 1) -> np.ndarray:
    """Words of 64 bits; a bit is 1 if it is set in over half of the hashes; 0 where there are none.

    The first word takes the hashes as they are, each further one a mix of them.
    """
    ones, n = np.zeros((words, BITS), np.int64), 0
    for h in hashes:
        for k in range(words):
            own = mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else h
            bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255  # so many rows add up within a byte
            ones[k] += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
        n += len(h)
    return np.packbits((2 * ones > n) & (n > 0), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: str, width: int = 3, seed: int = 42, words: int = 1) -> np.ndarray:
    """Of the text's shingles; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text, width, seed), words)


def fingerprints(df: DataFrame, width: int = 3, seed: int = 42, words: int = 1, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint's words as big-endian bytes; with digest, also one of the set of shingles, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in fr.batches_of(batches):
            fps, digests, sizes = [], [], []
            for text in table.column("text").to_pylist():
                hashes = shingle_hashes(text, width, seed)
                if digest:
                    hashes = list(hashes)
                    own = _set(hashes)
                    digests.append(_digest(own))
                    sizes.append(len(own))
                fps.append(fingerprint_of(hashes, words).astype(">u8").tobytes())
            found = {"doc_id": table.column("doc_id").combine_chunks(), "fp": pa.array(fps, pa.binary())}
            if digest:
                found |= {"digest": pa.array(digests, pa.binary()), "size": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    return fr.with_text(df, id_col, text_col).mapInArrow(fr.tidy_task(run), "doc_id long, fp binary" + ", digest binary, size long" * digest)


def stretches(radius: int, spare: int) -> np.ndarray:
    """Masks over 64 bits, at least one of which hides all differences of two fingerprints within radius.

    The bits are cut into radius + spare stretches, of which spare at least are then alike; each choice of spare
    stretches is a mask.  More spare stretches make longer keys, for more fingerprints.
    """
    edges = np.linspace(0, BITS, radius + spare + 1).round().astype(int).tolist()
    cut = [sum(1 << b for b in range(a, z)) for a, z in zip(edges[:-1], edges[1:], strict=True)]
    return np.array([[sum(cut[i] for i in chosen)] for chosen in combinations(range(len(cut)), spare)], dtype=np.uint64)


def apart(similarity: float) -> float:
    """The share of bits in which fingerprints of equally long texts of that Jaccard similarity are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def found_share(distances: np.ndarray, likely: np.ndarray, bits: int, width: int, tables: int) -> float:
    """The share of pairs, of distances that are so likely, that are alike under one of so many masks of width bits."""
    return float((likely * (1 - (1 - (1 - distances / bits) ** width) ** tables)).sum())


def samples(rows: int, similarity: float, words: int, radius: int, recall: float = 0.98, load: int = 5) -> np.ndarray:
    """Masks of bits drawn at random (with a fixed seed), for fingerprints that differ too much to cut into stretches.

    A mask has log2(rows) - load bits, so a bucket holds about 2 ** load unrelated rows at every size, and there
    are as many masks as it takes for two texts of that similarity to be within radius and share a bucket with
    probability recall, over all distances that they may have if bits are independent.
    """
    bits, share = words * BITS, apart(similarity)
    width = max(12, int(np.ceil(np.log2(max(rows, 2)))) - load)
    d = np.arange(radius + 1)
    ways = np.concatenate([[0.0], np.cumsum(np.log((bits - d[:-1]) / (d[:-1] + 1)))])
    likely = np.exp(ways + d * np.log(share) + (bits - d) * np.log1p(-share))
    tables = 1
    while found_share(d, likely, bits, width, tables) < recall:
        tables += 1
    rng = np.random.default_rng(7)
    masks = np.zeros((tables, words), np.uint64)
    for t in range(tables):
        for bit in rng.choice(bits, width, replace=False).tolist():
            masks[t, bit // BITS] |= np.uint64(1 << bit % BITS)
    return masks


def close_rows(fps: np.ndarray, group: np.ndarray, radius: int, slice_size: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group within radius; rows of a group stand together.

    fps has a column for each word.  The fingerprints are stored as bit planes, 64 rows to a word; each group starts a new word.  A query
    row meets a word of its group's planes one plane at a time: the difference bits go into carry-save
    counters of 1, 2, 4, ... for all 64 rows at once, and every 8 planes the (query, word) blocks in which
    all rows exceed the radius are abandoned.
    """
    n = len(fps)
    if n < 2:
        return
    heads = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff([*heads, n])
    words = -(-sizes // 64)
    first_word = np.concatenate([[0], np.cumsum(words)])
    of = np.repeat(np.arange(len(heads)), sizes)
    lane = first_word[of] * 64 + np.arange(n) - heads[of]
    total = int(first_word[-1])
    row_at = np.full(total * 64, -1, np.int64)
    row_at[lane] = np.arange(n)
    planes = np.empty((BITS * fps.shape[1], total), np.uint64)
    for b in range(len(planes)):
        bits = np.zeros(total * 64, np.uint8)
        bits[lane] = (fps[:, b // BITS] >> np.uint64(b % BITS)) & np.uint64(1)
        planes[b] = np.packbits(bits, bitorder="little").view("<u8")
    used = np.packbits(row_at >= 0, bitorder="little").view("<u8")

    levels = int(radius + 1).bit_length()
    start_at = (1 << levels) - 1 - radius  # so that the counter overflows beyond the radius
    count = words[of]
    ends = np.cumsum(count)
    for lo in range(0, int(ends[-1]), slice_size):
        flat = np.arange(lo, min(lo + slice_size, int(ends[-1])))
        query = np.searchsorted(ends, flat, side="right")
        word = first_word[of[query]] + flat - (ends[query] - count[query])
        ahead = word >= lane[query] >> 6  # each pair once
        query, word = query[ahead], word[ahead]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        counters = [np.full(len(word), full if start_at >> k & 1 else 0, np.uint64) for k in range(levels)]
        over = ~used[word]
        for b in range(len(planes)):
            if b % BITS == 0:
                own = fps[query, b // BITS]
            carry = planes[b][word] ^ (np.uint64(0) - ((own >> np.uint64(b % BITS)) & np.uint64(1)))
            for k in range(levels):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7:
                live = over != full
                if not live.all():
                    query, word, own, over = query[live], word[live], own[live], over[live]
                    counters = [c[live] for c in counters]
                if not len(word):
                    break
        if len(word):
            near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(near)
            other = row_at[word[which] * 64 + bit]
            mine = query[which]
            keep = lane[other] > lane[mine]
            yield mine[keep], other[keep]


def join_rows(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Unites the trees of each pair of rows; root then holds every row's tree."""
    a, b = root[left], root[right]
    apart = a != b
    if not apart.any():
        return
    pairs = np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs.tolist():
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    while not np.array_equal(up := root[root], root):
        root[:] = up


def meetings(nodes: DataFrame, masks: np.ndarray, cell: int = 4096) -> DataFrame:
    """Rows (band, key, a, b, node, fp) of all places where nodes (node, fp) that are alike under a mask meet.

    Buckets of more than cell rows are dealt to cells, and every two cells of a bucket meet in a task of their own, so no
    task holds more than about two cells.
    """
    schema = pa.schema([("node", pa.int64()), ("fp", pa.binary()), ("band", pa.int32()), ("key", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _matrix(batch.column("fp"), masks.shape[1])
            for band, mask in enumerate(masks):
                key = np.zeros(len(fps), np.uint64)
                for k in range(masks.shape[1]):
                    key = mix(key ^ (fps[:, k] & mask[k]))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("fp"), pa.array(np.full(len(fps), band, np.int32)), pa.array(key.view(np.int64))], schema=schema)

    rows = nodes.select("node", "fp").mapInArrow(fr.tidy_task(keyed), "node long, fp binary, band int, key long")
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = F.ceil(F.col("n") / cell).cast("int")
    rows = rows.join(sizes, ["band", "key"]).withColumn("cells", cells).withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return rows.select("band", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "fp")


def each_meeting(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, keys: tuple[str, ...] = MEETING) -> DataFrame:
    """What work makes of tables that hold whole meetings, and the number of each row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            group = _groups(held, keys)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield from work(held.slice(0, last), group[:last])
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from work(held, _groups(held, keys))

    return rows.repartition(fr.partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "node").mapInArrow(fr.tidy_task(run), schema)


def links(nodes: DataFrame, masks: np.ndarray, radius: int, cell: int = 4096) -> DataFrame:
    """Edges (u, v) that join all nodes (node, fp) whose fingerprints are alike under a mask and differ in at most radius bits.

    Fingerprints are distinct.  Of each meeting only a spanning forest goes out, never all pairs.
    """

    def forest(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        root = np.arange(table.num_rows)
        for left, right in close_rows(_matrix(table.column("fp"), masks.shape[1]), group, radius):
            join_rows(root, left, right)
        linked = np.flatnonzero(root != np.arange(len(root)))
        node = table.column("node").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["u", "v"])

    return each_meeting(meetings(nodes, masks, cell), forest, "u long, v long")


def _matrix(column: pa.Array | pa.ChunkedArray, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, words).astype(np.uint64)


def _groups(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    values = np.stack([table.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
    return np.cumsum(np.append(False, (values[1:] != values[:-1]).any(axis=1)))


def cut_meetings(met: DataFrame, most: int = MEETING_SHINGLES) -> DataFrame:
    """met with columns c and d, so that (meeting, c, d) holds about `most` shingles: the sum of its column size.

    The rows of a larger meeting are dealt to cells of half as many, and every two cells meet, so no pair is lost.
    """
    heavy = met.groupBy(*MEETING).agg(F.ceil(F.sum("size") * 2 / most).cast("int").alias("cells")).where(F.col("cells") > 2)
    rows = met.join(fr.broadcast_if_small(fr.stored(heavy)), list(MEETING), "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", "node"), F.col("cells")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return rows.withColumns({"c": F.least("own", "other"), "d": F.greatest("own", "other")}).drop("cells", "own", "other")


def _set(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def jaccards(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The similarity of a sorted set of shingles to each of others; two empty sets are alike."""
    sizes = np.array([len(x) for x in others])
    if not len(own):
        return (sizes == 0).astype(float)
    values = np.concatenate(others)
    there = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    total = np.append(0, np.cumsum(there))
    ends = np.cumsum(sizes)
    both = total[ends] - total[ends - sizes]
    return both / (len(own) + sizes - both)


def first_met(fps: np.ndarray, band: np.ndarray, masks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs are alike under no mask before that of the band where they meet: each pair meets often and counts once."""
    first = np.ones(len(left), bool)
    for k in range(int(band[left].max(initial=0))):
        asked = np.flatnonzero(first & (band[left] > k))
        differ = ((fps[left[asked]] ^ fps[right[asked]]) & masks[k]).any(axis=1)
        first[asked] = differ
    return first


def unite(root: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, distance: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Checks pairs of rows, nearest first and none within one tree, and unites the trees of those that have the similarity."""
    u, v = [], []
    order = np.lexsort((distance, left))
    left, right = left[order], right[order]
    most = 1
    while len(left):
        apart_now = root[left] != root[right]
        left, right = left[apart_now], right[apart_now]
        if not len(left):
            break
        # Of each row the nearest few, twice as many as before.
        head = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
        rank = np.arange(len(left)) - np.repeat(head, np.diff(np.append(head, len(left))))
        now, most = rank < most, 2 * most
        tried_l, tried_r = left[now], right[now]
        cut = np.flatnonzero(np.append(True, tried_l[1:] != tried_l[:-1]))
        alike = np.concatenate([jaccards(sets[tried_l[a]], [sets[r] for r in tried_r[a:b]]) for a, b in zip(cut, [*cut[1:], len(tried_l)], strict=True)]) >= similarity
        for x, y in zip(tried_l[alike].tolist(), tried_r[alike].tolist(), strict=True):
            if root[x] != root[y]:
                u.append(x)
                v.append(y)
                join_rows(root, np.array([x]), np.array([y]))
        left, right = left[~now], right[~now]
    return u, v


def similar_links(df: DataFrame, nodes: DataFrame, width: int, seed: int, similarity: float, words: int, id_col: str, text_col: str, most: int = MEETING_SHINGLES) -> DataFrame:
    """Verified edges (u, v) that join all nodes (node, digest, fp) found to have that similarity.

    Nodes that have a candidate take their sets of shingles to the meetings where the candidate is first met; pairs are
    checked there, and only a spanning forest of the verified ones goes out.  Meetings with many shingles are cut, so
    that what a task holds does not grow with the length of the texts.
    """
    share, bits = apart(similarity), words * BITS
    radius = int(bits * share + 3 * np.sqrt(bits * share * (1 - share)))
    masks = samples(nodes.count(), similarity, words, radius)
    docs = fr.with_text(df, id_col, text_col).withColumn("node", F.coalesce("doc_id", F.lit(int(fr.NULL_ID))))

    def pairs(table: pa.Table, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        fps, band = _matrix(table.column("fp"), words), table.column("band").to_numpy()
        for left, right in close_rows(fps, group, radius):
            first = first_met(fps, band, masks, left, right)
            left, right = left[first], right[first]
            yield left, right, np.bitwise_count(fps[left] ^ fps[right]).sum(axis=1)

    def candidates(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        has = np.zeros(table.num_rows, bool)
        for left, right, _ in pairs(table, group):
            has[left] = has[right] = True
        yield from table.filter(pa.array(has)).to_batches()

    def check(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        root, node = np.arange(table.num_rows), table.column("node").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        for left, right, distance in pairs(table, group):
            u, v = unite(root, sets, left, right, distance, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(node[u], pa.int64()), pa.array(node[v], pa.int64())], names=["u", "v"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in fr.batches_of(batches):
            own = [_set(list(shingle_hashes(t, width, seed))) for t in table.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([table.column("node").combine_chunks(), pa.array([_digest(x) for x in own], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in own], pa.binary())], names=["node", "digest", "shingles"])

    met = fr.stored(each_meeting(meetings(nodes, masks), candidates, "band int, key long, a int, b int, node long, fp binary"))
    asked = fr.broadcast_if_small(fr.stored(met.select("node").distinct()))
    own = docs.join(asked, "node", "left_semi").select("node", "text").mapInArrow(fr.tidy_task(shingled), "node long, digest binary, shingles binary")
    # Rows that share an id may differ in text; a node's own sets are those of its digests.
    sets = own.join(nodes.join(asked, "node", "left_semi").select("node", "digest"), ["node", "digest"], "left_semi").dropDuplicates(["node", "digest"])
    sized = cut_meetings(met.join(nodes.select("node", "digest", "fp", "size"), ["node", "fp"]), most)
    rows = sized.join(sets, ["node", "digest"]).select(*CUT, "node", "fp", "shingles")
    return each_meeting(rows, check, "u long, v long", CUT)


def near_groups(df: DataFrame, width: int = 3, radius: int = 2, spare: int = 2, seed: int = 42, similarity: float | None = None, words: int = 4, id_col: str = "doc_id", text_col: str = "text", meeting_shingles: int = MEETING_SHINGLES) -> DataFrame:
    """doc_id, fingerprint, component_id and group_size of every row.

    Without similarity, fingerprints have 64 bits and all that differ in at most radius bits are linked.  With it,
    they have `words` words and only find candidates, within the expected distance of texts of that Jaccard
    similarity and three standard deviations; a link is a pair whose sets of shingles have that similarity.

    Rows with one fingerprint (with similarity: one set of shingles) are one node, whose number is their smallest id; close nodes are linked and
    component_id is the smallest id reachable.  Texts without words have fingerprint zero and are linked like
    any other; a null text has no words.  A null id orders before every other one and stays null in both columns.
    Repeated rows are answered each; an empty table gives no rows.  Rows come back to their node's label by a join
    that spreads the rows of the largest nodes.
    """
    words, key = (1, "fp") if similarity is None else (words, "digest")
    docs = fr.stored(fingerprints(df, width, seed, words, id_col, text_col, similarity is not None).withColumn("doc_id", F.coalesce("doc_id", F.lit(int(fr.NULL_ID)))))
    if similarity is None:
        nodes = fr.stored(docs.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
        edges = links(nodes, stretches(radius, spare), radius)
    else:
        nodes = fr.stored(docs.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.count(F.lit(1)).alias("n")))
        edges = similar_links(df, nodes, width, seed, similarity, words, id_col, text_col, meeting_shingles)
    # Rows of different texts may share an id; their fingerprints are then one node.
    labels = nodes.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labels.groupBy("component").agg(F.sum("n").alias("group_size"))
    labels = fr.stored(labels.join(sizes, "component").select(key, "component", "group_size", "n"))
    null_id = F.lit(int(fr.NULL_ID))
    return fr.join_groups(docs, labels, key, "n", "doc_id").select(
        F.nullif(F.col("doc_id"), null_id).alias("doc_id"),
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.nullif(F.col("component"), null_id).alias("component_id"),
        "group_size",
    )
