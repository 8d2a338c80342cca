"""What the classifier takes of a worker's memory."""

import tracemalloc

import numpy as np

from peneira.llm import hashing, quality

TEXT = "uma linha de palavras, com Maiúsculas e 12 números. " * 400


def _peak(work) -> float:
    """Most megabytes held while ``work`` runs, tables that stay included."""
    hashing._powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_statistics_of_a_group_take_little_memory():
    many = [TEXT] * 200  # four megabytes

    def work():
        for some in hashing.groups(many):
            quality.statistics([many[k] for k in some])

    assert _peak(work) < 30


def test_groups_do_not_change_statistics(monkeypatch):
    many = [TEXT[:n] for n in (0, 5, 900, 20_000)] * 5
    whole = quality.statistics(many)
    for size in (1, 10_000, 1 << 30):
        monkeypatch.setattr(hashing, "GROUP_BYTES", size)
        found = np.concatenate([quality.statistics([many[k] for k in some]) for some in hashing.groups(many)])
        assert np.array_equal(found, whole)


def test_features_are_let_go_as_they_are_stacked():
    parts = [np.full((5, quality.WIDTH), k, dtype=np.float32) for k in range(4)]
    expected = np.concatenate(parts)
    assert np.array_equal(quality._stacked(parts), expected)
    assert not parts
    assert quality._stacked([]).shape == (0, quality.WIDTH)
