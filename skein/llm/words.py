"""Words of whole texts as 64-bit keys, computed for a block of rows at once.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; A-Z count as a-z. A key is a polynomial over a random table of
byte values, taken modulo 2^64 and mixed, so that distinct words share a key with a chance of about 2^-64 a pair.
Everything here is a function of the text alone: any executor, asked again, gives the same keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = int(_rng.integers(1, 2**63)) | 1
_UNBASE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs, raw


def blocks(offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    n, at = len(offs) - 1, 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


class Words:
    """Words of rows ``[at, to)``: ``start``/``end`` (bytes within ``data``), ``row`` (from 0), ``key``."""

    def __init__(self, offs: np.ndarray, raw: np.ndarray, at: int, to: int):
        lo, hi = int(offs[at]), int(offs[to])
        self.data = data = raw[lo:hi]
        self.rows = to - at
        self.offs = offs[at : to + 1] - lo
        # Word bounds are found per row: a row's first byte starts a word even right after another row's word.
        solid = ~_SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        begins = self.offs[:-1][self.offs[:-1] < self.offs[1:]]
        first[begins] = solid[begins]
        ends = begins_end = self.offs[1:][self.offs[:-1] < self.offs[1:]] - 1
        last[ends] = solid[begins_end]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.offs, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows)
        if len(data):
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
            self.key = mix((sums[self.end] - sums[self.start]) * _power(_UNBASE, len(data))[self.start])
        else:
            self.key = np.zeros(0, np.uint64)


def word_key(word: str) -> int:
    """The key of one word, as ``Words`` gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Words(np.array([0, len(raw)]), raw, 0, 1).key[0])
