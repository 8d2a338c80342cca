"""Near-duplicates by SimHash, found exactly through a Gray-ordered hierarchical index."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import partitions_for, spread_join, whole_text
from peneira.llm.components import components
from peneira.llm.encoding import texts
from peneira.operators.keyed import keep_first
from peneira.session import stage

SHINGLE_WORDS, SEED, DISTANCE = 4, 42, 4
# Two fingerprints within DISTANCE bits agree on at least two of DISTANCE + 2 segments.
SEGMENTS = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))
TOP_BITS = tuple(itertools.combinations(range(len(SEGMENTS)), 2))
FANOUTS = (16, 16, 8)
BLOCK_ROWS = 2048
SMALL_GROUP = 64
CHUNK_ROWS = 1 << 17
INDEX_ROWS = 250_000
PAIR_CHUNK = 1 << 12
PAIRS_PER_TASK = 500


# ---- fingerprints ----


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the text's word shingles, repeats included; 0 for a text without words.

    ``bytes.lower`` and ``bytes.split`` touch A-Z and the blanks 0x20, 0x09-0x0D alone.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)],
        dtype=np.uint64,
    )
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 65536):  # long texts in bounded steps
        bits = np.unpackbits(hashes[part : part + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` (signed long) of each row's whole text; texts stay where they are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in texts(batches):
            fps = np.array([fingerprint(t) for t in words], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    return chosen.mapInArrow(work, "doc_id long, text_hash long, fp long")


# ---- bit order: chosen segments first ----

_SIGN = np.uint64(1 << 63)


def _order(pair: int) -> list[tuple[int, int]]:
    first = TOP_BITS[pair]
    return [SEGMENTS[s] for s in first] + [SEGMENTS[s] for s in range(len(SEGMENTS)) if s not in first]


def permuted(fp: np.ndarray, pair: int) -> np.ndarray:
    """Fingerprints with the bits of the pair's segments moved to the top."""
    out = np.zeros_like(fp)
    for low, high in _order(pair):
        width = np.uint64(high - low)
        out = (out << width) | ((fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1))
    return out


def restored(perm: np.ndarray, pair: int) -> np.ndarray:
    out, at = np.zeros_like(perm), 64
    for low, high in _order(pair):
        at -= high - low
        out |= ((perm >> np.uint64(at)) & np.uint64((1 << (high - low)) - 1)) << np.uint64(low)
    return out


def top_width(pair: int) -> int:
    return sum(SEGMENTS[s][1] - SEGMENTS[s][0] for s in TOP_BITS[pair])


_WIDTHS = np.array([top_width(p) for p in range(len(TOP_BITS))], dtype=np.uint64)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of a code word in the Gray sequence, where neighbours differ in one bit."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


# ---- the index ----


class Index:
    """Three levels of nodes over at most BLOCK_ROWS codes in Gray order.

    Level 0 are the codes. A node keeps the mask of the bits all codes under it share and
    their pattern; groups are runs of the Gray order, so much is shared.
    """

    def __init__(self, codes: np.ndarray):
        self.levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
        for size in FANOUTS:
            patterns, masks = self.levels[-1]
            starts = np.arange(0, len(patterns), size)
            every = np.bitwise_and.reduceat(patterns | ~masks, starts)
            some = np.bitwise_or.reduceat(patterns & masks, starts)
            shared = np.bitwise_and.reduceat(masks, starts) & ~(every ^ some)
            self.levels.append((some & shared, shared))

    def size(self, level: int) -> int:
        return len(self.levels[level][0])


class Links:
    """Union-find over codes that keeps a spanning forest only."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.flatnonzero(self.root != np.arange(len(self.root)))
        return nodes, self.root[nodes]


def link_codes(left: np.ndarray, right: np.ndarray | None = None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of codes within ``distance``: inside ``left``, or between ``left`` and ``right``.

    Codes come in Gray order. Pairs of nodes are followed downwards; differences in the bits
    both share add up on the way (a level counts only bits its parents didn't share), and
    a pair whose sum exceeds ``distance`` is dropped with all under it. Where not even the
    bits left open can exceed it, both nodes are linked as a whole. Links are numbered over
    ``left`` followed by ``right``.
    """
    same = right is None
    mine = Index(left)
    other = mine if same else Index(right)
    shift = 0 if same else len(left)
    links = Links(len(left) + (0 if same else len(right)))
    start = np.zeros(1, dtype=np.int64)
    none = np.zeros(1, dtype=np.uint64)
    work = [(len(FANOUTS), start, start, none, none.astype(np.int64))]
    while work:
        level, a, b, known, apart = work.pop()
        if len(a) > PAIR_CHUNK:
            cut = len(a) // 2
            work += [(level, *(v[:cut] for v in (a, b, known, apart))), (level, *(v[cut:] for v in (a, b, known, apart)))]
            continue
        (patterns_a, masks_a), (patterns_b, masks_b) = mine.levels[level], other.levels[level]
        both = masks_a[a] & masks_b[b]
        apart = apart + np.bitwise_count((patterns_a[a] ^ patterns_b[b]) & both & ~known)
        near = apart <= distance
        a, b, both, apart = a[near], b[near], both[near], apart[near]
        if level == 0:
            links.add(a, b + shift)
            continue
        whole = apart + np.bitwise_count(~both) <= distance
        span = int(np.prod(FANOUTS[:level]))
        for x, y in zip(a[whole].tolist(), b[whole].tolist(), strict=True):
            ours = np.arange(x * span, min((x + 1) * span, mine.size(0)))
            theirs = np.arange(y * span, min((y + 1) * span, other.size(0))) + shift
            links.add(ours, np.full(len(ours), theirs[0]))
            links.add(theirs, np.full(len(theirs), ours[0]))
        a, b, both, apart = (v[~whole] for v in (a, b, both, apart))
        # Children of each pair: every child of a with every child of b.
        size = FANOUTS[level - 1]
        step = np.arange(size)
        grid_a = (a[:, None] * size + step)[:, :, None]
        grid_b = (b[:, None] * size + step)[:, None, :]
        there = (grid_a < mine.size(level - 1)) & (grid_b < other.size(level - 1))
        if same:
            there &= grid_a <= grid_b
        origin, i, j = np.nonzero(there)
        if len(origin):
            work.append((level - 1, a[origin] * size + i, b[origin] * size + j, both[origin], apart[origin]))
    return links.edges()


def _link_small(codes: np.ndarray, group: np.ndarray, links: Links, offset: int) -> None:
    """Link codes of small groups directly: rows one, two, three... places apart, all groups at once."""
    rows = np.arange(len(codes))
    step = 1
    while len(rows := rows[rows + step < len(codes)]) and len(rows := rows[group[rows] == group[rows + step]]):
        near = np.bitwise_count(codes[rows] ^ codes[rows + step]) <= DISTANCE
        links.add(rows[near] + offset, rows[near] + step + offset)
        step += 1


_OUT = "a long, b long, block long, pair int, top long, mask long, pattern long, codes binary"
_OUT_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _link_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    empty = [pa.nulls(len(a), k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *empty], _OUT_NAMES)


def _index_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the groups of one range of the sorted index, and blocks of groups that may go beyond.

    Rows are ``pair, rank`` in order. A group is the rows of one pair with equal top bits. A
    range's first and last group may go on in its neighbours, and a group over BLOCK_ROWS is
    cut; blocks of these are emitted for comparison with each other.
    """
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    held_pair, held_rank = np.zeros(0, np.int32), np.zeros(0, np.uint64)
    first = True

    def tops(pair: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return rank >> (np.uint64(64) - _WIDTHS[pair])

    def emit(pair: np.ndarray, rank: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal block, first
        top = tops(pair, rank)
        change = np.flatnonzero((pair[1:] != pair[:-1]) | (top[1:] != top[:-1])) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [len(pair)]])
        codes = gray_code(rank)
        links = Links(len(codes))
        sizes = ends - starts
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        rows = np.flatnonzero(small)
        if len(rows):
            own = Links(len(rows))
            _link_small(codes[rows], np.repeat(np.arange(len(sizes)), sizes)[rows], own, 0)
            x, y = own.edges()
            links.add(rows[x], rows[y])
        open_ends = [k for k in {0 if first else -1, len(sizes) - 1 if last else -1} if k >= 0]
        for k in sorted({*np.flatnonzero(sizes > SMALL_GROUP).tolist(), *open_ends}):
            spanning = sizes[k] > BLOCK_ROWS or k in open_ends
            for at in range(starts[k], ends[k], BLOCK_ROWS):
                end = min(at + BLOCK_ROWS, ends[k])
                if sizes[k] > SMALL_GROUP:
                    x, y = link_codes(codes[at:end])
                    links.add(x + at, y + at)
                if spanning:
                    patterns, masks = Index(codes[at:end]).levels[-1]
                    block += 1
                    values = (None, None, block, int(pair[at]), int(top[at]), int(masks.view(np.int64)[0]), int(patterns.view(np.int64)[0]), codes[at:end].tobytes())
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], _OUT_NAMES)
        first = False
        x, y = links.edges()
        for p in np.unique(pair[x]).tolist():
            own = pair[x] == p
            yield _link_rows(restored(codes[x[own]], p), restored(codes[y[own]], p))

    for batch in batches:
        held_pair = np.concatenate([held_pair, batch.column("pair").to_numpy(zero_copy_only=False)])
        held_rank = np.concatenate([held_rank, batch.column("rank").to_numpy(zero_copy_only=False).view(np.uint64) ^ _SIGN])
        if len(held_pair) < CHUNK_ROWS:
            continue
        top = tops(held_pair, held_rank)
        begin = len(held_pair) - 1 - int(np.argmax(((held_pair != held_pair[-1]) | (top != top[-1]))[::-1])) + 1
        if held_pair[0] == held_pair[-1] and top[0] == top[-1]:
            begin = 0
        # The group still open waits for its end, whatever its size is: it's a range's share of 8-byte ranks.
        if begin:
            yield from emit(held_pair[:begin], held_rank[:begin], False)
            held_pair, held_rank = held_pair[begin:], held_rank[begin:]
    if len(held_pair):
        yield from emit(held_pair, held_rank, True)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``a, b``: links among distinct fingerprints (column ``fp``) that span every linked class.

    Each pair of segments gives a bit order with those segments on top. All orders are sorted
    by Gray rank, which keeps codes with equal top bits together. Two fingerprints within
    DISTANCE meet in such a group for some pair of segments, so no link is lost; a group
    emits no more links than it has rows.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for pair in range(len(TOP_BITS)):
                rank = gray_rank(permuted(codes, pair)) ^ _SIGN  # signed order as Spark sorts it
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), pair, np.int32)), pa.array(rank.view(np.int64))], ["pair", "rank"])

    rows = fps.count() * len(TOP_BITS)
    orders = fps.select("fp").mapInArrow(explode, "pair int, rank long")
    ranged = orders.repartitionByRange(partitions_for(rows, INDEX_ROWS), "pair", "rank").sortWithinPartitions("pair", "rank")
    found = stage(ranged.mapInArrow(_index_ranges, _OUT), "gray-index")
    inside = found.where("block IS NULL").select("a", "b")
    blocks = found.where("block IS NOT NULL").select("block", "pair", "top", "mask", "pattern", "codes")
    return inside.unionByName(_across_blocks(blocks))


def _across_blocks(blocks: DataFrame) -> DataFrame:
    """Links between blocks of one group: block nodes are compared first, then their codes."""
    nodes = blocks.drop("codes")
    other = nodes.select("pair", "top", *[F.col(c).alias(f"{c}_b") for c in ("block", "mask", "pattern")])
    shared = F.col("mask").bitwiseAND(F.col("mask_b"))
    apart = F.bit_count(F.col("pattern").bitwiseXOR(F.col("pattern_b")).bitwiseAND(shared))
    pairs = stage(
        nodes.join(other, ["pair", "top"]).where((F.col("block") < F.col("block_b")) & (apart <= DISTANCE)).select("pair", "block", "block_b"),
        "block-pairs",
    )
    codes_a = blocks.select("block", F.col("codes").alias("left"))
    codes_b = blocks.select(F.col("block").alias("block_b"), F.col("codes").alias("right"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = (np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64))
                x, y = link_codes(*codes)
                every = np.concatenate(codes)
                ends = (restored(every[x], pair).view(np.int64), restored(every[y], pair).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], ["a", "b"])

    dealt = pairs.join(codes_a, "block").join(codes_b, "block_b").select("pair", "left", "right")
    return dealt.repartition(partitions_for(pairs.count(), PAIRS_PER_TASK)).mapInArrow(link, "a long, b long")


# ---- classes of documents ----


def _classes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp, least, class_size``; ``least`` is the first row of the class by id (null last)."""
    rows = stage(fingerprints(docs), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("least")
    distinct = stage(rows.groupBy("fp").agg(least, F.count(F.lit(1)).alias("n")), "distinct-fps")
    labels = components(fingerprint_links(distinct), "a", "b").withColumnRenamed("node", "fp")
    labelled = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    classes = labelled.groupBy("label").agg(F.min("least").alias("least"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("fps"))
    table = spread_join(labelled.select("fp", "label", "n"), classes, ["label"], F.col("fp"), "fps").select("fp", "least", "class_size", "n")
    return spread_join(rows, table, ["fp"], F.xxhash64("doc_id", "text_hash"), "n").drop("n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id, class_size`` of every row.

    Documents whose fingerprints differ in DISTANCE bits or fewer are linked; a class is all
    that links reach, and its id is the smallest ``doc_id`` in it. Null and empty texts have
    fingerprint zero and are linked like others. Rows with a null id take part; a class has a
    null id only if all its rows have. Repeated rows are rows of one class. An empty table
    gives no rows; other columns are ignored.
    """
    return _classes(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"), "class_size"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the smallest id (null last), columns unchanged.

    Rows are told apart by id and text; of rows alike in both, one stays.
    """
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    stays = (
        _classes(docs).where(first.eqNullSafe(F.col("least")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(F.count(F.lit(1)).alias("_same"))
    )
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    left = rows.join(stage(stays, "kept"), same)
    once = left.where("_same = 1")
    several = keep_first(left.where("_same > 1"), ["_id", "_hash"], [F.col("_row.text")])
    return once.unionByName(several).select("_row.*")
