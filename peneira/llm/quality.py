"""Quality classifier from weak labels: noisy heuristics, their estimated accuracies, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import fresh, whole_text
from peneira.llm.encoding import texts
from peneira.llm.hashing import groups, word_hashes

SAMPLE_ROWS = 5000
HASH_BITS = 11
STEPS, RATE, DECAY = 200, 8.0, 1e-4
EM_ROUNDS = 60
KEEP_FROM = 0.5
BINS = 8


def _chars(members: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[[ord(c) for c in members]] = 1
    return table


_UPPER = _chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _chars("abcdefghijklmnopqrstuvwxyz")
_WIDE = np.concatenate([np.zeros(128, np.int64), np.ones(128, np.int64)])
_BLANK = _chars(" \t\n\r\x0b\x0c")
_DIGIT = _chars("0123456789")
_SYMBOL = _chars("*$#%&^~<>{}[]\\`")
_COUNTS = {
    "upper": _UPPER, "letters": _UPPER + _LOWER, "other": _WIDE + _DIGIT, "blank": _BLANK,
    "symbols": _SYMBOL, "shouts": _chars("!"), "columns": _chars("|"), "stops": _chars(".?!"),
}


@dataclass(frozen=True)
class Labeller:
    """Votes 2 (bad) from ``bad_from``, 1 (good) up to ``good_to``, else 0; abstains on texts under ``words``.

    A labeller for one defect never says good: that one defect is missing says little.
    """

    name: str
    bad_from: float
    words: int = 3
    good_to: float = -1.0


LABELLERS = (
    Labeller("symbols", 0.05),
    Labeller("capitals", 0.3, 8),
    Labeller("shouting", 0.15),
    Labeller("repeats", 0.15, 12),
    Labeller("columns", 0.1),
    Labeller("unlettered", 0.2, 8, good_to=0.1),
    Labeller("unbroken", 150.0, 8, good_to=40.0),
    Labeller("unruly", 0.2, 8, good_to=0.03),
)


def statistics(group: Sequence[str]) -> np.ndarray:
    """One row per text and one column per labeller, and the number of words as the last column."""
    data = [t.encode() + b"\n" for t in group]
    raw = np.frombuffer(b"".join(data), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]]).astype(np.int64)
    c = {name: np.add.reduceat(table[raw], starts) for name, table in _COUNTS.items()}
    hashes, bounds = word_hashes(group)
    words = np.diff(bounds)
    text = np.repeat(np.arange(len(group)), words)
    again = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    repeats = np.bincount(text[1:][again], minlength=len(group))
    visible = np.maximum(np.array([len(d) for d in data]) - c["blank"], 1)
    n = np.maximum(words, 1)
    return np.column_stack(
        [
            c["symbols"] / visible,
            c["upper"] / np.maximum(c["letters"], 1),
            c["shouts"] / n,
            repeats / n,
            c["columns"] / n,
            1 - (c["letters"] + c["other"]) / visible,
            n / (c["stops"] + 1),
            (c["symbols"] + c["columns"] + c["shouts"] + repeats) / n,
            words,
        ]
    )


def votes(stats: np.ndarray) -> np.ndarray:
    """Texts x labellers: 0 abstains, 1 good, 2 bad."""
    out = np.zeros((len(stats), len(LABELLERS)), dtype=np.int64)
    for k, rule in enumerate(LABELLERS):
        speaks = stats[:, -1] >= rule.words
        out[speaks & (stats[:, k] <= rule.good_to), k] = 1
        out[speaks & (stats[:, k] >= rule.bad_from), k] = 2
    return out


def pattern_of(ballots: np.ndarray) -> np.ndarray:
    return ballots @ (3 ** np.arange(len(LABELLERS)))


def ballots_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class LabelModel:
    """Share of good texts and, per labeller and class, how often it abstains, says good, says bad.

    Silence tells nothing: a text on which all are silent is good with the corpus's own share.
    """

    prior: float
    tables: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """Expectation-maximisation over the histogram of vote patterns.

        The votes of a labeller are taken as independent of the others given the class. The
        start is the majority of votes (a bad one counts twice, silence is good) with one
        dissent in ten.
        """
        ballots = ballots_of(patterns)
        lead = (ballots == 1).sum(axis=1) - 2.0 * (ballots == 2).sum(axis=1)
        good = np.where(lead < 0, 0.1, 0.9)
        model = cls(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
        for _ in range(EM_ROUNDS):
            for side, weight in ((0, (1 - good) * counts), (1, good * counts)):
                for vote in range(3):
                    model.tables[:, side, vote] = weight @ (ballots == vote) + 0.01
                model.tables[:, side] /= model.tables[:, side].sum(axis=1, keepdims=True)
            model.prior = float((good @ counts + 1) / (counts.sum() + 2))
            good = model.posterior(patterns)
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a text with these votes is good."""
        ballots = ballots_of(patterns)
        logs = np.log(self.tables) * (np.arange(3) > 0)  # silence is no evidence
        rows = np.arange(len(LABELLERS))
        sides = [logs[rows, side, ballots].sum(axis=1) for side in (0, 1)]
        margin = sides[1] - sides[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


_EDGES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4])
WIDTH = (1 << HASH_BITS) + BINS * len(LABELLERS)


def features(group: Sequence[str], stats: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams (root of their share, whole text) and the statistics in steps."""
    data = [t.encode() for t in group]
    out = np.zeros((len(group), WIDTH), dtype=np.float32)
    for k, d in enumerate(data):
        counts = np.zeros(1 << HASH_BITS, dtype=np.int64)
        for at in range(0, max(len(d) - 2, 0), 1 << 20):  # long texts in bounded steps
            raw = np.frombuffer(d[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
            code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
            counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS), minlength=1 << HASH_BITS)
        total = counts.sum()
        if total:
            out[k, : 1 << HASH_BITS] = np.sqrt(counts / total)
    for k in range(len(LABELLERS)):
        step = np.searchsorted(_EDGES, stats[:, k], side="right").clip(0, BINS - 1)
        out[np.arange(len(group)), (1 << HASH_BITS) + BINS * k + step] = 0.3
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of all ``parts`` in order; each part is let go once it is copied, so they are not held twice."""
    out = np.empty((sum(map(len, parts)), WIDTH), dtype=np.float32)
    parts.reverse()
    at = 0
    while parts:
        part = parts.pop()
        out[at : at + len(part)] = part
        at += len(part)
    return out


def train(x: np.ndarray, good: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights and offset for soft labels of rows that count ``times`` each, by accelerated gradient steps."""
    share = times / times.sum()
    mean = good @ share
    w, bias = np.zeros(x.shape[1], dtype=np.float64), float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    ahead_w, ahead_b = w.copy(), bias
    for t in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead_w.astype(np.float32) + ahead_b, -40, 40)))
        slip = (p - good) * share
        next_w = ahead_w - RATE * (x.T @ slip.astype(np.float32) + DECAY * ahead_w)
        next_b = ahead_b - 0.5 * float(slip.sum())
        pace = t / (t + 3)
        ahead_w, ahead_b = next_w + pace * (next_w - w), next_b + pace * (next_b - bias)
        w, bias = next_w, next_b
    return w, bias


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, group: Sequence[str], stats: np.ndarray) -> np.ndarray:
        """Chance that each text is good."""
        return 1 / (1 + np.exp(-np.clip(features(group, stats) @ self.weights.astype(np.float32) + self.bias, -40, 40)))


def training_sample(docs: DataFrame, share: float) -> DataFrame:
    """``text, times``: the distinct texts of about ``share`` of the rows, and how many of the rows drawn have each.

    Rows are drawn by a hash of id and text, so copies of a text are drawn apart and in
    proportion; rows that repeat id and text count once.
    """
    rows = docs.select(F.xxhash64("doc_id", whole_text()).alias("row"), whole_text().alias("text"))
    drawn = rows.where(F.pmod("row", F.lit(1_000_003)) < share * 1_000_003)
    return drawn.groupBy("text").agg(F.count_distinct("row").alias("times"))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Estimate labeller accuracies on every row of ``docs``; train on about ``sample_rows`` of them.

    Vote patterns number at most 3 to the power of the labellers, so their histogram over the
    whole corpus is a small table. The sample is drawn by a hash of id and text; its expected size
    never exceeds ``sample_rows``, whatever copies there are. Only weights come back to the driver.
    """

    def poll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for _, words in texts(batches):
            for some in groups(words):
                found += np.bincount(pattern_of(votes(statistics([words[k] for k in some]))), minlength=len(found))
        rows = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(found[rows])], ["pattern", "n"])

    plain = docs.select(whole_text().alias("text"))
    histogram = plain.mapInArrow(poll, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not histogram:
        return Scorer(LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)), np.zeros(WIDTH), 0.0)
    counts = np.array([r["n"] for r in histogram], dtype=np.float64)
    labels = LabelModel.fit(np.array([r["pattern"] for r in histogram]), counts)
    share = min(1.0, sample_rows / counts.sum())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, good, times = [], [], []
        for part, words in texts(batches):
            times.append(part.column("times").to_numpy(zero_copy_only=False).astype(np.float64))
            for some in groups(words):
                group = [words[k] for k in some]
                stats = statistics(group)
                parts.append(features(group, stats))
                good.append(labels.posterior(pattern_of(votes(stats))))
        if parts:
            w, bias = train(_stacked(parts), np.concatenate(good), np.concatenate(times))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([bias])], ["w", "bias"])

    trained = training_sample(docs, share).repartition(1).mapInArrow(learn, "w binary, bias double").collect()
    if not trained:
        return Scorer(labels, np.zeros(WIDTH), float(np.log(labels.prior / (1 - labels.prior))))
    return Scorer(labels, np.frombuffer(trained[0]["w"]), trained[0]["bias"])


def quality_scores(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """``doc_id, score, weak_label, kept`` of every row.

    ``weak_label`` is the posterior from the votes alone, ``score`` the scorer's; a row is
    kept from KEEP_FROM on. Null and empty texts get no vote and the corpus's own share as
    evidence; repeated rows score alike; an empty table gives no rows; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer or fit(docs))  # a fixed number of weights

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, words in texts(batches):
            score, weak = np.zeros(len(words)), np.zeros(len(words))
            for some in groups(words):
                group = [words[k] for k in some]
                stats = statistics(group)
                score[some] = own.score(group, stats)
                weak[some] = own.labels.posterior(pattern_of(votes(stats)))
            columns = [part.column("doc_id"), pa.array(score), pa.array(weak), pa.array(score >= KEEP_FROM)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "weak_label", "kept"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return chosen.mapInArrow(rate, "doc_id long, score double, weak_label double, kept boolean")


def keep_good(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer or fit(docs))
    name = fresh(docs, "_text")
    marked = docs.withColumn(name, whole_text())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in texts(batches, name):
            keep = np.zeros(len(words), dtype=bool)
            for some in groups(words):
                group = [words[k] for k in some]
                keep[some] = shared.value.score(group, statistics(group)) >= KEEP_FROM
            yield part.filter(pa.array(keep))

    return marked.mapInArrow(choose, marked.schema).drop(name)
