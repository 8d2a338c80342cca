"""Runs of repeated words against every lag tried in turn."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from corpus_fixtures import LONG, clashing, docs, empty, found  # noqa: F401

from peneira.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def smallest_period(words):
    """By the failure function of the stretch itself."""
    fail, k = [0], 0
    for w in words[1:]:
        while k and words[k] != w:
            k = fail[k - 1]
        k += words[k] == w
        fail.append(k)
    return len(words) - fail[-1]


def all_runs(words):
    """Each lag's maximal stretches, long enough and with no smaller period."""
    n, out = len(words), []
    codes = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if n else np.zeros(0)
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        step = np.diff(same.astype(int))
        for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
            length = int(b - a + q)
            if length >= max(24, 3 * q) and smallest_period(words[a : a + length]) == q:
                out.append((int(a), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def samples():
    rng = random.Random(12)
    for alphabet in (1, 2, 3, 50):
        for n in (0, 1, 23, 24, 25, 60, 200):
            yield [str(rng.randrange(alphabet)) for _ in range(n)]
    for _ in range(300):
        words = []
        while len(words) < 250:
            piece = [rng.choice("abc") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 32, 33, 40)))]
            words += piece * rng.choice((1, 1, 2, 3, 4, 9)) + piece[: rng.randrange(len(piece) + 1)]
        yield words
    for q in (1, 8, 16, 17, 31, 32, 33, 64, 65, 100):
        unit = [rng.choice("ab") + str(k % 3) for k in range(q)]
        yield ["x"] * 5 + unit * 3 + ["y"]
        yield unit * 3
        yield (unit * 3)[:-1]
    for _ in range(20):  # runs within runs
        inner = [rng.choice("ab") for _ in range(3)] * 9
        yield (inner + ["z", *inner[:7]]) * 4


def test_runs_are_those_of_every_lag():
    for words in samples():
        assert periodic.find_runs(words) == all_runs(words), words


def test_collapse_drops_what_a_run_repeats():
    words = list("xabababababababababababababy")
    runs = periodic.find_runs(words)
    assert runs == [(1, 26, 2)]
    assert "".join(periodic.collapse(words, runs)) == "xaby"


def test_one_word_repeated_is_one_extension():
    words = ["same"] * 300_000
    assert periodic.find_runs(words) == [(0, 300_000, 1)]
    assert periodic.collapse(words, [(0, 300_000, 1)]) == ["same"]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_over_the_whole_table(spark):
    texts = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert set(got) == {k for k, _ in texts}
    total = 0
    for doc_id, text in texts:
        words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text))
        runs = all_runs(words)
        total += len(runs)
        r = got[doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        dropped = {i for a, length, q in runs for i in range(a + q, a + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        lines = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (best[0] if best[0] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert total > 10


def test_awkward_rows(spark, docs, clashing, empty):
    assert periodic.document_runs(empty).count() == 0
    plain = periodic.periodic_runs(docs)
    assert found(plain) == found(periodic.periodic_runs(clashing))
    rows = {r["doc_id"]: r for r in plain.collect()}
    assert plain.count() == docs.count()
    assert not rows[5]["runs"] and rows[5]["collapsed"] == rows[6]["collapsed"] == rows[7]["collapsed"] == ""
    assert [tuple(r) for r in rows[8]["runs"]] == [(0, 44000 + 4000 * (len(LONG.split()) // 4000 - 11), len(LONG.split()) // 4000)]
    assert len(rows[8]["collapsed"].split()) == len(LONG.split()) // 4000
    assert None in rows


@pytest.mark.parametrize("doc_id", [None, 3, 10])
def test_planting_keeps_the_number_of_words(doc_id):
    words = [str(k) for k in range(100)]
    assert len(periodic.plant(doc_id, words)) == 100
