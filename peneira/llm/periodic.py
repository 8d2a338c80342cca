"""Periodic runs of words: k-gram seeds on diagonals, one extension per diagonal stretch.

A run of period ``q`` and at least ``3 q`` words is a stretch of at least ``2 q`` matches on the
diagonal of lag ``q``. For lags up to ``k`` every such stretch of a run of LEAST_WORDS words or
more holds a whole ``k``-gram for ``k`` = 16, and from there on for ``k`` = 32, 64 and so on with
lags from ``k / 2`` to ``k``. So each band of lags has its own index of k-grams.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import whole_text
from peneira.llm.encoding import texts

LEAST_WORDS = 24
LEAST_PERIODS = 3
# Overlap every run of a lag up to itself guarantees: the least of max(24 - q, 2 q) is 16, at q = 8.
BASE_GRAM = 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]
Edit = Callable[[int | None, list[str]], list[str]]


def _codes(words: list[str]) -> np.ndarray:
    """Words as numbers, equal where the words are."""
    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def _recurring(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurs more than once, ascending, and their keys renumbered."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
    number = np.empty(len(key), np.int64)
    number[order] = np.where(new[:-1] & new[1:], -1, np.cumsum(new[:-1]))
    several = number >= 0
    return at[several], number[several]


def _doubled(at: np.ndarray, gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """From recurring k-grams to recurring 2k-grams: both halves must recur, k words apart."""
    right = np.searchsorted(at, at + k)
    right[right == len(at)] = 0
    both = at[right] == at + k
    if not both.any():
        return at[:0], gram[:0]
    return _recurring(at[both], gram[both] * (int(gram.max()) + 1) + gram[right[both]])


def _stretches(at: np.ndarray, gram: np.ndarray, k: int, least: int) -> Iterator[tuple[int, int, int]]:
    """``lag, first, last``: seeds that follow each other on the diagonals of lags from ``least`` to ``k``.

    A seed is an occurrence of a k-gram with the next one of the same gram. Other pairs of
    occurrences need not be formed: with ``k`` at or over the period, a run's gram cannot recur
    before one period is over without a smaller period holding for the whole stretch. Seeds
    are taken by lag, then place; as long as a seed lies one word after the last, the
    extension of the first has covered it, so only what lies beyond the furthest place
    covered on its diagonal starts a new one.
    """
    order = np.lexsort((at, gram))
    places, grams = at[order], gram[order]
    lag = np.diff(places)
    seed = (grams[1:] == grams[:-1]) & (lag >= least) & (lag <= k)
    first, lag = places[:-1][seed], lag[seed]
    order = np.lexsort((first, lag))
    first, lag = first[order], lag[order]
    beyond = np.flatnonzero((np.diff(lag, prepend=-1) != 0) | (np.diff(first, prepend=-2) != 1))
    for a, b in zip(beyond, np.append(beyond[1:], len(first))[: len(beyond)], strict=True):
        yield int(lag[a]), int(first[a]), int(first[b - 1])


def find_runs(words: list[str]) -> list[Run]:
    """``start, length, period`` of all runs by start, then period.

    Grams are compared through numbers that are equal exactly where the grams are. Places
    whose gram occurs once are left out of the next, longer grams, so ordinary text is spent
    after a few doublings; there are as many doublings as the logarithm of the words.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    at, gram = _recurring(np.arange(n), _codes(words))
    k, runs = 1, []
    while len(at) and k < BASE_GRAM:
        at, gram = _doubled(at, gram, k)
        k *= 2
    least = 1
    while len(at) and LEAST_PERIODS * least <= n:
        for lag, first, last in _stretches(at, gram, k, least):
            length = last - first + k + lag
            if length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                runs.append((first, length, lag))
        at, gram = _doubled(at, gram, k)
        least, k = k + 1, 2 * k
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[Run]) -> list[str]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    return [words[k] for k in kept]


_RUNS = "array<struct<start: long, length: long, period: long>>"
_ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row.

    ``runs`` holds start, length and period in words by start, then period; ``collapsed`` is
    the text with one period left of each run, words joined by one blank. ``edit`` may replace
    a document's words before the search. Null and empty texts and texts of blanks have no
    words, so no runs and an empty ``collapsed``; repeated rows are searched and returned each;
    a null id stays null; an empty table gives no rows; other columns are ignored. A text is
    searched whole where it is read, with memory in proportion to its words; nothing is
    shuffled.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, whole in texts(batches):
            found, left = [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), whole, strict=True):
                words = _WORD.findall(text)
                words = edit(doc_id, words) if edit else words
                runs = find_runs(words)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                left.append(" ".join(collapse(words, runs)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, _ARROW_RUNS), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return chosen.mapInArrow(search, f"doc_id long, runs {_RUNS}, collapsed string")


def plant(doc_id: int | None, words: list[str]) -> list[str]:
    """Every tenth document, by the checksum of its id, made periodic from some word on; a null id is left alone."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _greatest(runs: Column) -> Column:
    """The run of greatest length over period; cross products compare the fractions exactly."""

    def better(best: Column, r: Column) -> Column:
        more = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | more, r).otherwise(best)

    # Runs come by start, then period, so of equal ones the first is the right one.
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def document_runs(docs: DataFrame) -> DataFrame:
    """Count, greatest run and digests of every document with planted runs, from ``periodic_runs``."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    best = F.col("best")
    return periodic_runs(docs, edit=plant).withColumn("best", _greatest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
