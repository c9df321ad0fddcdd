"""Words of many texts at once, as spans and hashes of their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from webcorpus.llm.hashing import Spans, mix

_LETTERS = mix(np.arange(256, dtype=np.uint64), seed=3)

#: ``[^\x20\x09-\x0D]+``, which is what ``bytes.split()`` gives
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALPHANUMERIC = np.ones(256, bool)
ALPHANUMERIC[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: A-Z in lower case, all other bytes as they are
LOWER = np.arange(256)
LOWER[ord("A"):ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (one more entry for the end)."""
    n = len(data)
    member = inside[data]
    starts, ends = member.copy(), member.copy()
    if n:
        starts[1:] &= ~member[:-1]
        ends[:-1] &= ~member[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        starts[edges] = member[edges]
        ends[edges - 1] = member[edges - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    letters = _LETTERS[LOWER] if lower else _LETTERS
    return Spans(letters[data], seed=1)(starts, ends)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _LETTERS[data]
