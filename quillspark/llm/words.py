"""Words and word hashes of many texts at once, as numpy arrays.

A word is a run of bytes other than ASCII white space, A-Z in lower case; each character from U+3000 to U+9FFF (Chinese,
Japanese, their punctuation) is a word of its own, as such text has no spaces. A run of more than PIECE bytes is cut into
words of PIECE bytes. A word's hash is a polynomial of its bytes modulo 2**64, taken from running sums, then mixed; so no
Python code runs for each word, and no more than PIECE bytes are expanded at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled in pieces that end at white space or before a character that is a word.
PIECE = 1 << 18
#: First bytes in UTF-8 of the characters that are words, each of three bytes.
FIRST_BYTE, LAST_BYTE = 0xE3, 0xE9
BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(BASE), series(pow(BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of texts number ``0 .. n - 1``: those of text ``i`` are at ``first[i]:first[i + 1]``."""

    hash: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, start, stop of the words in ``data``; a word also ends at each of the offsets ``breaks``."""
    power, back = _powers(PIECE)
    ink = ~_WHITE[data]
    edge = np.zeros(len(data) + 4, bool)
    edge[breaks] = True
    own = np.flatnonzero((data >= FIRST_BYTE) & (data <= LAST_BYTE))
    edge[own] = True
    edge[own + 3] = True
    edge = edge[: len(data) + 1]
    before = np.r_[False, ink[:-1]] & ~edge[:-1]
    after = np.r_[ink[1:], False] & ~edge[1:]
    start, stop = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * back[start]), start, stop


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of PIECE bytes at most that end at a text's end, after white space or before a character that is a word.

    Only a run of more than PIECE bytes without such a place, which then begins its range, is cut within.
    """
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + PIECE)
        if stop < end:
            i = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[i] > at:
                stop = int(offsets[i])
            else:
                some = data[at:stop]
                white = np.flatnonzero(_WHITE[some])
                own = np.flatnonzero((some >= FIRST_BYTE) & (some <= LAST_BYTE))
                places = [x for x in (int(white[-1]) + 1 if len(white) else 0, int(own[-1]) if len(own) else 0) if x]
                stop = at + max(places) if places else stop
        yield at, stop
        at = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """The bytes of an Arrow array of strings (null: empty), the texts' offsets in them, and their words."""
    texts = pa.array(texts, pa.large_binary()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_binary())
    texts = texts.fill_null(b"")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    found = []
    for at, stop in _cuts(data, offsets):
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, "right")] - at
        h, a, b = _piece(data[at:stop], inside)
        found.append((h, a + at, b + at))
    h, a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return data, offsets, Words(h, a, b, np.searchsorted(a, offsets))


def by_bytes(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together (a longer text alone)."""
    size, at = 0, 0
    lengths = np.asarray(pc.binary_length(texts.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False))
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield at, len(lengths)
