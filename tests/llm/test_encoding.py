"""Ids of words with marks at their end: those of the whole text, without a call of the library for each word."""

import random

from peneira.llm.encoding import Encoder


def test_words_with_marks_are_two_pieces():
    own = Encoder()
    plain, calls = own._plain, []
    own._plain = lambda text: calls.append(text) or plain(text)
    text = " ".join(f"{word}{mark}" for word in ("casa", "Então", "WORD", "éa") for mark in ("!!!", "$$$$", ".%%", ",", ")", "_", "...|"))
    assert own.ids(text) == plain(text)
    assert len(calls) <= 7  # the runs of marks, once each


def test_marks_anywhere_give_the_ids_of_the_whole_text():
    own, rng = Encoder(), random.Random(5)
    parts = ["foo", "Bar", "é", "中", "ߣ", "́", "ª", "'s", "'", "!!!", "$", "_", "1", "²", "<|endoftext|>", "<|", "|>", "\n", "\n\n", "\t", " ", " ", " "]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert own.ids(text) == own._plain(text), repr(text)
