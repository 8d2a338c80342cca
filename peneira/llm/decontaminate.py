"""Training passages that repeat test items: n-gram seeds, then local alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import fresh, whole_text
from peneira.llm.encoding import texts
from peneira.llm.hashing import groups, ngram_hashes, word_hashes
from peneira.session import stage

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
SHARE = 0.5
LEAST_WORDS, ENOUGH_WORDS = 8, 25
ITEMS_PER_BLOCK, BLOCK_BYTES = 20_000, 16 << 20
# An n-gram is rare with so many occurrences in all texts, or one in 2^RARE_BITS words.
RARE_LEAST, RARE_BITS = 1, 20
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
FILTER_BITS = 22
HITS_PER_STEP = 1 << 16
WINDOW_WORDS = 1 << 16


@dataclass(frozen=True)
class Seeds:
    """N-grams of one length in order, each with the item it is from and its place there."""

    n: int
    grams: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    known: np.ndarray

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``hashes``' n-grams that are seeds, and the first row of each in ``grams``."""
        grams = ngram_hashes(hashes, self.n)
        near = np.flatnonzero(self.known[grams >> np.uint64(64 - FILTER_BITS)])
        rows = np.searchsorted(self.grams, grams[near])
        rows = np.minimum(rows, max(len(self.grams) - 1, 0))
        real = self.grams[rows] == grams[near] if len(self.grams) else np.zeros(len(near), bool)
        return near[real], rows[real]


def _seeds(n: int, grams: np.ndarray, owners: np.ndarray, places: np.ndarray) -> Seeds:
    order = np.argsort(grams, kind="stable")
    grams = grams[order].astype(np.uint64)
    known = np.zeros(1 << FILTER_BITS, dtype=bool)
    known[grams >> np.uint64(64 - FILTER_BITS)] = True
    return Seeds(n, grams, owners[order], places[order], known)


class Items:
    """Words and seeds of a bounded block of test items; at first every n-gram of SEED_WORDS words is a seed."""

    def __init__(self, ids: list[int], item_texts: list[str]):
        hashes, bounds = word_hashes(item_texts)
        self.ids = ids
        self.flat, self.starts = hashes, bounds[:-1]
        self.words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.spans = np.array([len(w) for w in self.words], dtype=np.int64)
        self.needed = np.array([needed(n) for n in self.spans])
        self.seeds = [_seeds(SEED_WORDS, *self._grams(SEED_WORDS))]
        self._table: WordTable | None = None

    def table(self) -> WordTable:
        """Made where it is first asked for: it is no part of what is broadcast."""
        if self._table is None:
            self._table = WordTable(self.words)
        return self._table

    def _grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [ngram_hashes(words, n) for words in self.words]
        counts = [len(g) for g in own]
        grams = np.concatenate(own) if own else np.zeros(0, np.uint64)
        return grams, np.repeat(np.arange(len(own)), counts), np.concatenate([np.arange(c) for c in counts] or [np.zeros(0, np.int64)])

    def keep_rare(self, grams: np.ndarray, counts: np.ndarray, corpus_words: int) -> None:
        """Choose seeds by how often the n-grams ``grams`` (ascending) occur in the whole corpus.

        An n-gram that occurs, but rarely, is a seed. Every run of SEED_WORDS + 1 words whose
        two n-grams are both frequent is one as a whole. So each run of that many words of
        an item holds a seed, wherever it occurs; n-grams that occur nowhere are left out.
        """
        own, owners, places = self._grams(SEED_WORDS)
        at = np.minimum(np.searchsorted(grams, own), max(len(grams) - 1, 0))
        found = np.where(grams[at] == own, counts[at], 0) if len(grams) else np.zeros(len(own), np.int64)
        rare = (found > 0) & ((found <= max(RARE_LEAST, corpus_words >> RARE_BITS)) | (self.spans[owners] == SEED_WORDS))
        longer, of, place = self._grams(SEED_WORDS + 1)
        first = np.concatenate([[0], np.cumsum(np.maximum(self.spans - SEED_WORDS + 1, 0))])[of] + place
        frequent = (found > 0) & ~rare
        both = frequent[first] & frequent[first + 1] if len(longer) else np.zeros(0, bool)
        self.seeds = [_seeds(SEED_WORDS, own[rare], owners[rare], places[rare]), _seeds(SEED_WORDS + 1, longer[both], of[both], place[both])]


def needed(words: int) -> float:
    """Alignment score from which an item of so many words counts as repeated.

    Half of the best possible score, but at least LEAST_WORDS matching words (all of a
    shorter item); ENOUGH_WORDS matching words suffice for any item.
    """
    return min(max(SHARE * MATCH * words, MATCH * min(words, LEAST_WORDS)), MATCH * ENOUGH_WORDS)


def align(windows: np.ndarray, widths: np.ndarray, items: np.ndarray, spans: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of an item in each row of ``windows`` and where it ends.

    ``items`` is one item for all rows, or one row of words per window. Rows are padded to one
    width; ``widths`` and ``spans`` are their true ones. Gaps along a row follow from a running
    maximum, so a word of all items against all windows is one step.
    """
    count, width = windows.shape
    items = np.broadcast_to(items, (count, items.shape[-1]))
    spans = np.full(count, items.shape[1]) if spans is None else spans
    previous = np.zeros((count, width + 1), dtype=np.int32)
    best, end = np.zeros(count, dtype=np.int32), np.zeros(count, dtype=np.int64)
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    padding = np.arange(width) >= widths[:, None]
    for k in range(items.shape[1]):
        score = np.where(windows == items[:, k : k + 1], MATCH, MISMATCH).astype(np.int32)
        score[padding] = MISMATCH * 1000
        row = np.zeros_like(previous)
        row[:, 1:] = np.maximum(np.maximum(previous[:, :-1] + score, previous[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        row[:, 1:][padding] = 0
        top = row.argmax(axis=1)
        value = row[np.arange(count), top]
        better = (value > best) & (k < spans)
        best[better], end[better] = value[better], top[better]
        previous = row
    return best, end


class WordTable:
    """Words of all items with how often each item has them, looked up by item and word at once."""

    def __init__(self, words: list[np.ndarray]):
        owners = np.repeat(np.arange(len(words)), [len(w) for w in words])
        keys = self._keys(owners, np.concatenate(words) if words else np.zeros(0, np.uint64))
        self.keys, self.often = np.unique(keys, return_counts=True)

    @staticmethod
    def _keys(owners: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (words + owners.astype(np.uint64)) * MIX ^ owners.astype(np.uint64) * STEP

    def reachable(self, owners: np.ndarray, starts: np.ndarray, widths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A bound on ``align``'s score of each window: all words of the window that its item has, as often as it has them at most.

        Two words whose keys collide only raise the bound.
        """
        if not len(self.keys):
            return np.zeros(len(owners), np.int64)
        window = np.repeat(np.arange(len(owners)), widths)
        at = np.arange(len(window)) - np.repeat(np.cumsum(widths) - widths, widths) + np.repeat(starts, widths)
        keys = self._keys(owners[window], hashes[at])
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        shared = self.keys[place] == keys
        pairs, met = np.unique(window[shared] * len(self.keys) + place[shared], return_counts=True)
        found = np.minimum(met, self.often[pairs % len(self.keys)])
        return MATCH * np.bincount(pairs // len(self.keys), found, len(owners)).astype(np.int64)


def _windows(
    items: Items, seeds: Seeds, places: np.ndarray, rows: np.ndarray, text: np.ndarray, bounds: np.ndarray
) -> Iterator[tuple[int, np.ndarray]]:
    """Each item hit, with the distinct ``text, anchor`` of the windows to align it in; ``rows`` are first rows of n-grams."""
    if not len(rows):
        return
    counts = np.searchsorted(seeds.grams, seeds.grams[rows], side="right") - rows
    starts = np.flatnonzero(np.diff(np.cumsum(counts) // HITS_PER_STEP, prepend=-1))
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
        some = slice(start, stop)
        count = counts[some]
        hit = np.repeat(np.arange(len(count)), count)
        met = np.repeat(rows[some], count) + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        owner, k = seeds.owners[met], text[some][hit]
        anchor = (places[some][hit] - seeds.places[met] - bounds[k]) // items.spans[owner]
        found = np.unique(np.stack([owner, k, anchor], axis=1), axis=0)
        cuts = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
        for first, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)], strict=True):
            yield int(found[first, 0]), found[first:end, 1:]


def _inside(seeds: Seeds, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, row and text of the hits that lie within one text."""
    places, rows = seeds.hits(hashes)
    text = np.searchsorted(bounds, places, side="right") - 1
    inside = places + seeds.n <= bounds[text + 1]
    return places[inside], rows[inside], text[inside]


def _candidates(items: Items, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for seeds in items.seeds:
        yield from _windows(items, seeds, *_inside(seeds, hashes, bounds), bounds)


def _worth(items: Items, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``item, text, start, end`` of the windows whose words alone could reach the item's score, by the item's length."""
    found = [np.column_stack([np.full(len(w), item), w]) for item, w in _candidates(items, hashes, bounds)]
    if not found:
        return np.zeros((0, 4), np.int64)
    owner, k, anchor = np.unique(np.concatenate(found), axis=0).T
    span = items.spans[owner]
    # Half an item's words may be added or left out before the last of them.
    starts = np.maximum(bounds[k], bounds[k] + (anchor - 1) * span)
    ends = np.minimum(bounds[k + 1], bounds[k] + (anchor + 3) * span)
    windows = np.column_stack([owner, k, starts, ends])
    table, can = items.table(), np.zeros(len(owner), dtype=bool)
    for a, b in _steps(ends - starts):
        can[a:b] = table.reachable(owner[a:b], starts[a:b], (ends - starts)[a:b], hashes) >= items.needed[owner[a:b]]
    windows = windows[can]
    return windows[np.argsort(items.spans[windows[:, 0]], kind="stable")]


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of about WINDOW_WORDS words together."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // WINDOW_WORDS, prepend=-1)).tolist()
    yield from zip(cuts, [*cuts[1:], len(sizes)], strict=True)


def _leaks(items: Items, group: list[str]) -> Iterator[tuple[int, int, float, int, int]]:
    """``text, item, score, matched share, end word`` of the best alignment of each text and item that repeats."""
    hashes, bounds = word_hashes(group)
    windows = _worth(items, hashes, bounds)
    if not len(windows):
        return
    # Windows are padded to the widest of their step; they come by length of item, so to little more than their own.
    for a, b in _steps(windows[:, 3] - windows[:, 2]):
        owner, text, starts, ends = windows[a:b].T
        widths, spans = ends - starts, items.spans[owner]
        padded = hashes[np.minimum(starts[:, None] + np.arange(int(widths.max())), len(hashes) - 1)]
        words = items.flat[np.minimum(items.starts[owner][:, None] + np.arange(int(spans.max())), len(items.flat) - 1)]
        best, end = align(padded, widths, words, spans)
        for j in np.flatnonzero(best >= items.needed[owner]).tolist():
            k, item = int(text[j]), int(owner[j])
            yield k, item, float(best[j]) / (MATCH * int(spans[j])), int(best[j]), int(starts[j] + end[j] - bounds[k])


def _blocks(benchmark: DataFrame) -> list[list]:
    """Rows of the test items in blocks of bounded number and size: each block is searched by passes of its own."""
    rows = benchmark.select("item_id", whole_text().alias("text")).distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(-(-size["n"] // ITEMS_PER_BLOCK), -(-size["bytes"] // BLOCK_BYTES))
    if n <= 1:
        return [rows.collect()] if size["n"] else []
    dealt = stage(rows.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n))), "items")
    return [block for k in range(2 * n) if (block := dealt.where(F.col("_block") == k).collect())]


def _items(block: list, texts_of: DataFrame) -> Items:
    """A block's items with seeds chosen by their counts over all of ``texts_of``' only column.

    Counts are summed per task and then per n-gram; as many reach the driver as the block has n-grams.
    """
    items = Items([r["item_id"] for r in block], [r["text"] for r in block])
    name = texts_of.columns[0]
    shared = texts_of.sparkSession.sparkContext.broadcast(items)  # at most ITEMS_PER_BLOCK items of about BLOCK_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value.seeds[0]
        met, words = np.zeros(len(seeds.grams), np.int64), 0
        for _, whole in texts(batches, name):
            for some in groups(whole):
                hashes, bounds = word_hashes([whole[j] for j in some])
                words += len(hashes)
                met += np.bincount(_inside(seeds, hashes, bounds)[1], minlength=len(met))
        at = np.flatnonzero(met)
        rows = [pa.array(np.append(seeds.grams[at].view(np.int64), 0)), pa.array(np.append(met[at], words)), pa.array(np.append(np.zeros(len(at), bool), True))]
        yield pa.RecordBatch.from_arrays(rows, ["gram", "n", "total"])

    found = texts_of.mapInArrow(count, "gram long, n long, total boolean").groupBy("gram", "total").agg(F.sum("n").alias("n")).toPandas()
    grams = found.loc[~found["total"], "gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    items.keep_rare(grams[order], found.loc[~found["total"], "n"].to_numpy(np.int64)[order], int(found.loc[found["total"], "n"].sum()))
    return items


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, aligned_score, end_word``: documents that repeat a test item.

    ``score`` is the best alignment's share of the item's own score. Words are runs of
    letters and digits, lower-cased. Seeds are the n-grams of an item that are rare in the whole
    corpus, and longer ones where frequent words leave none (``Items.keep_rare``): a passage with
    SEED_WORDS + 1 words of the item in a row is always aligned, one with SEED_WORDS where they
    are rare. An item with fewer than SEED_WORDS words is not searched for. Null and empty texts repeat nothing; repeated rows are each
    reported; an empty table on either side gives no rows; other columns are ignored. Seeds
    meet the passages inside the task that reads them, so no text is shuffled.
    """
    result = None
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    schema = "doc_id long, item_id long, score double, aligned_score int, end_word long"
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(_items(block, chosen.select("text")))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            items = shared.value
            for part, words in texts(batches):
                ids = part.column("doc_id").to_pylist()
                best: dict[tuple[int, int], tuple] = {}
                for some in groups(words):
                    for k, item, share, score, end in _leaks(items, [words[j] for j in some]):
                        key = (some[k], item)
                        if key not in best or best[key][1] < score:
                            best[key] = (share, score, end)
                rows = [(ids[k], items.ids[item], *v) for (k, item), v in sorted(best.items())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

        found = chosen.mapInArrow(search, schema)
        result = found if result is None else result.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text repeats no test item, all columns as they were."""
    name = fresh(docs, "_text")
    left = docs.withColumn(name, whole_text())
    corpus = left.select(name)
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(_items(block, corpus))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for part, words in texts(batches, name):
                keep = np.ones(len(words), dtype=bool)
                for some in groups(words):
                    for k, *_ in _leaks(shared.value, [words[j] for j in some]):
                        keep[some[k]] = False
                yield part.filter(pa.array(keep))

        left = left.mapInArrow(clean, left.schema)
    return left.drop(name)
