import itertools
import random

import pytest
from conftest import rows

from peneira.operators import keyed, similarity
from peneira.operators.groups import dup_groups


def corpus(seed):
    """Random texts, near copies, a template filling a third, and exact copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(40)]
    for t in texts[:15]:
        parts = t.split()
        if parts:
            parts[rng.randrange(len(parts))] = "novo"
        texts.append(" ".join(parts))
    texts += [" ".join(words[:30]) + f" fim{i % 4}" for i in range(30)] + ["um dois", "um dois", "so", ""]
    return list(enumerate(texts))


def shingle_set(text, n=5):
    w = text.split()
    if not w:
        return frozenset()
    return frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([text])


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(keyed, "ROWS_PER_CELL", 3)
    docs = corpus(int(threshold * 10))
    leaders = {}
    for i, t in docs:
        if shingle_set(t):
            leaders.setdefault(shingle_set(t), []).append(i)
    expected = {(ids[0], i, 1.0) for ids in leaders.values() for i in ids[1:]}
    for (a, x), (b, y) in itertools.combinations([(ids[0], s) for s, ids in leaders.items()], 2):
        j = len(x & y) / len(x | y)
        if j >= threshold:
            expected.add((min(a, b), max(a, b), round(j, 12)))
    found = similarity.near_dup_pairs(
        spark.createDataFrame(docs, "id long, text string"), "id", "text", threshold
    )
    assert {(r["id_a"], r["id_b"], round(r["jaccard"], 12)) for r in found.collect()} == expected


def test_groups_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)]  # a chain
    edges += [(0, i) for i in range(1, 30)]  # a star
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = rows(dup_groups(spark.createDataFrame(edges, "id_a long, id_b long")))
    assert got == sorted([(x, find(x)) for x in linked], key=repr)
