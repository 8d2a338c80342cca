"""Token ids of whole texts, by a public vocabulary file and the tokenizers library."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa

VOCABULARY = "byte_bpe_50k.json"
MEMO_WORDS = 500_000
MEMO_CHARS = 48
_LOOSE = re.compile(r" (?=\s|\Z)")
_UNIT = re.compile(r"(?s)(?<=.)(?= \S)")
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
# Up to here Python and the vocabulary's own pattern agree on what a letter is.
_LAST_LETTER = "ɏ"
# After letters a run of these is one piece of its own; an apostrophe may begin a piece with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKED = re.compile(f"[^\\W\\d_]*[{re.escape(MARKS)}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file; an absolute path stays as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stay, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


class _Memo(dict):
    """Ids of words, as bytes; a word that is asked for the first time is encoded and kept.

    The words of the generation before are taken over as they come up again.
    """

    def __init__(self, encode: Callable[[str], bytes], older: dict[str, bytes] | None = None):
        super().__init__()
        self.encode, self.older = encode, older or {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
        if len(word) <= MEMO_CHARS and "\n" not in word[1:]:
            self[word] = found
        return found


class Encoder:
    """Encodes whole texts and remembers the ids of words it has met.

    The vocabulary's pattern always begins a new piece at a blank followed by a visible
    character, so a text may be encoded unit by unit and the results joined: the ids equal
    those of the whole text. Words are remembered in two generations of a fixed size, so
    memory stays bounded whatever the corpus holds.
    """

    def __init__(self, name: str = VOCABULARY, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.blank = self.letters[32]
        # Each id as a little-endian unsigned 32-bit integer.
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        # A token that the library finds in the text before the pattern does could lie across such a run's start.
        self.marks = "" if any(_MARKED.fullmatch(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) else MARKS
        self.memo_words = memo_words
        self.memo = _Memo(self._after_blank)
        self.bare = _Memo(self._alone)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids))

    @staticmethod
    def _lines(word: str) -> list[str]:
        """``word`` cut at all its single line breaks between visible characters: no part has one left to cut at."""
        return _LINE.split(word) if "\n" in word else [word]

    def _letters_only(self, word: str, before: str) -> bytes | None:
        """Ids of a word of letters alone: it is a single piece for the model."""
        if not word.isalpha():
            return None
        if not word.isascii():
            if max(word) > _LAST_LETTER:
                return None
            word = "".join(map(self.letters.__getitem__, word.encode()))
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(before + word)])

    def _marked(self, word: str, memo: _Memo) -> bytes | None:
        """Ids of letters with marks after them: two pieces, each remembered."""
        letters = word.rstrip(self.marks) if self.marks else word
        if len(letters) == len(word) or not letters.isalpha() or letters[-1] > _LAST_LETTER:
            return None
        return memo[letters] + self.bare[word[len(letters) :]]

    def _after_blank(self, word: str) -> bytes:
        """Ids of a blank and one word; it holds no blank itself.

        Marks at its end and a line break between two words are pieces of their own.
        """
        found = self._letters_only(word, self.blank)
        if found is None:
            found = self._marked(word, self.memo)
        if found is not None:
            return found
        lines = self._lines(word)
        if len(lines) > 1:
            return self.bare["\n"].join([self.memo[lines[0]], *map(self.bare.__getitem__, lines[1:])])
        return self._plain(" " + word)

    def _alone(self, word: str) -> bytes:
        """Ids of a word with nothing before it."""
        found = self._letters_only(word, "")
        if found is None:
            found = self._marked(word, self.bare)
        if found is not None:
            return found
        lines = self._lines(word)
        if len(lines) > 1:
            return self.bare["\n"].join(map(self.bare.__getitem__, lines))
        return self._plain(word)

    def ids(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.memo) + len(self.bare) > self.memo_words:
            self.memo, self.bare = _Memo(self._after_blank, dict(self.memo)), _Memo(self._alone, dict(self.bare))
        if _LOOSE.search(text):
            first, *rest = _UNIT.split(text)
            words = [unit[1:] for unit in rest]
        else:
            first, *words = text.split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.memo.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(name)


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with their texts, null as empty; few rows at a time bound memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, [t or "" for t in part.column(column).to_pylist()]
