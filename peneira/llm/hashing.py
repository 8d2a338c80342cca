"""Hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

# Sums, powers and marks take some fifty bytes for each byte of a group, and workers keep what they once took.
GROUP_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
# A word is a run of ASCII letters and digits and of bytes of other scripts.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
    return _powers


def _hash_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``data``.

    Sums of bytes times powers of an odd base are taken once over everything; a word's share,
    divided by the power at its start, depends on the word alone.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    value ^= value >> np.uint64(29)
    value *= _MIX
    return value ^ (value >> np.uint64(32)), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at a blank; a longer run without one stays whole."""
    at = 0
    while len(data) - at > 2 * GROUP_BYTES:
        end = data.find(b" ", at + GROUP_BYTES)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def groups(texts: Sequence[str]) -> Iterator[list[int]]:
    """Numbers of consecutive texts of about GROUP_BYTES together."""
    some, size = [], 0
    for k, t in enumerate(texts):
        some.append(k)
        size += len(t)
        if size >= GROUP_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and where each text's words begin (with the end)."""
    found, counts = [], []
    if len(texts) == 1:
        found = [_hash_bytes(piece)[0] for piece in _pieces(texts[0].lower().encode())]
        counts = [sum(map(len, found))]
    elif texts:
        data = [t.lower().encode() for t in texts]
        hashes, starts = _hash_bytes(b"\n".join(data))
        limits = np.cumsum([len(d) + 1 for d in data])
        found, counts = [hashes], np.diff(np.searchsorted(starts, limits), prepend=0)
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return hashes, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; runs over a text's end are for the caller to leave out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + hashes[k : k + len(out)]
        out ^= out >> np.uint64(31)
    return out * _MIX
