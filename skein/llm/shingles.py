"""Distinct word shingles of whole texts and their min-max signatures (kernels for ``near_dup``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from skein.llm.words import Words, blocks, mix, text_buffers

WIDTH = 5
#: A band takes ROWS values; every permutation gives two, its minimum and its maximum.
BANDS, ROWS = 36, 4
PERMUTATIONS = BANDS * ROWS // 2

#: Ranges of a bin sketch, and how far below the threshold an estimate may lie.
BINS, SPREAD = 1024, 4.5
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(54)

_rng = np.random.default_rng(710)
_FACTOR = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_PLACE = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, WIDTH, dtype=np.uint64)]
_SALT = [np.uint64(int(x)) for x in _rng.integers(1, 2**63, WIDTH + 1, dtype=np.uint64)]
_BAND_SALT = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)
_BAND_PLACE = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
#: Band i takes values i*ROWS... of the order below: neighbours come from different permutations.
_ORDER = np.concatenate([np.arange(PERMUTATIONS), PERMUTATIONS + np.roll(np.arange(PERMUTATIONS), 1)])


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys of every row, ascending in a row, and each row's bounds within them (rows + 1)."""
    key, n = words.key, len(words.key)
    short = words.counts < WIDTH
    out, sizes = [], np.zeros(words.rows, np.int64)
    if n >= WIDTH:
        run = np.zeros(n - WIDTH + 1, np.uint64)
        for k in range(WIDTH):
            run += key[k : n - WIDTH + 1 + k] * _PLACE[k]
        run = mix(run + _SALT[WIDTH])
    begins = np.concatenate([[0], np.cumsum(words.counts)])
    for i in range(words.rows):
        a, b = begins[i], begins[i + 1]
        if a == b:
            continue
        if short[i]:
            total = _SALT[b - a]
            with np.errstate(over="ignore"):
                for k in range(b - a):
                    total = total + key[a + k] * _PLACE[k]
            got = mix(np.array([total], np.uint64))
        else:
            got = np.sort(run[a : b - WIDTH + 1])
            if len(got) > 1:
                got = got[np.concatenate([[True], got[1:] != got[:-1]])]
        out.append(got)
        sizes[i] = len(got)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 * PERMUTATIONS values of every nonempty row: minima, then maxima."""
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    out = np.zeros((2 * PERMUTATIONS, len(starts)), np.uint64)
    if not len(starts):
        return out.T
    for k in range(PERMUTATIONS):
        y = sets * _FACTOR[k] + _SHIFT[k]
        np.minimum.reduceat(y, starts, out=out[k])
        np.maximum.reduceat(y, starts, out=out[PERMUTATIONS + k])
    return mix(out.T)


def band_keys(signature: np.ndarray) -> np.ndarray:
    cut = signature[:, _ORDER].reshape(len(signature), BANDS, ROWS)
    return mix((cut * _BAND_PLACE).sum(axis=2, dtype=np.uint64) + _BAND_SALT)


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of every row's set; equal sets, equal keys. An empty set has none."""
    full = bounds[:-1] < bounds[1:]
    starts = bounds[:-1][full]
    keys = np.zeros((len(full), 2), np.uint64)
    if len(starts):
        keys[full, 0] = np.add.reduceat(mix(sets + np.uint64(1)), starts)
        keys[full, 1] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return [k.tobytes() if f else None for k, f in zip(keys, full, strict=True)]


def bin_sketches(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One byte for each of BINS equal ranges of keys: of the range's least key, or 0 where it has none."""
    out = np.zeros((len(bounds) - 1, BINS), np.uint8)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a < b:
            at = np.searchsorted(sets[a:b], _EDGES)
            full = np.flatnonzero(np.diff(np.append(at, b - a)))
            out[i, full] = 1 + (sets[a:b][at[full]] % np.uint64(255)).astype(np.uint8)
    return out


def may_reach(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs of bin sketches leave room for a similarity of ``least``: the estimate lies at most SPREAD standard
    deviations (of drawing bins without replacement from the union) and a step and a half below it."""
    same = ((x == y) & (x > 0)).sum(axis=-1)
    filled = np.maximum(((x | y) > 0).sum(axis=-1), 1)
    union = (nx + ny) / (1 + least)
    deviation = np.sqrt(least * (1 - least) / filled * np.clip(1 - filled / union, 0, 1))
    return same / filled >= least - SPREAD * deviation - 1.5 / filled


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, set_key, bands); the last two are null for an empty set."""
    for batch in batches:
        offs, raw = text_buffers(batch.column(1))
        for at, to in blocks(offs):
            sets, bounds = shingle_sets(Words(offs, raw, at, to))
            sizes = np.diff(bounds)
            keys = band_keys(signatures(sets, bounds))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, to - at),
                    pa.array(sizes, pa.int64()),
                    pa.array(set_keys(sets, bounds), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]), pa.int32()), pa.array(keys.ravel().view(np.int64), pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, set_key, shingles, sketch)."""
    for batch in batches:
        offs, raw = text_buffers(batch.column(1))
        for at, to in blocks(offs):
            sets, bounds = shingle_sets(Words(offs, raw, at, to))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, to - at),
                    pa.array(set_keys(sets, bounds), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64), pa.int64())),
                    pa.array([x.tobytes() for x in bin_sketches(sets, bounds)], pa.binary()),
                ],
                ["doc_id", "set_key", "shingles", "sketch"],
            )
