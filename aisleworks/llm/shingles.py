"""Sets of hashed word shingles, computed for a batch of texts at once with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from aisleworks.llm.common import mix64

WORDS = 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[0x41:0x5B] += np.uint64(32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_SHORT = np.uint64(0xD1B54A32D192ED03)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, ``A-Z`` lower-cased, and the number of words of each text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + rows + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(0, dtype=np.uint64), np.zeros(rows, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[first:last]
    bounds = offsets - first
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    text_starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[text_starts] = inside[text_starts]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(begins[at])  # positions in the bytes of words alone
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(rows, dtype=np.int64)
    lengths = np.diff(np.append(starts, len(at)))
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE))
    within = np.arange(len(at)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(_LOWER[data[at]] * powers[within], starts)
    hashes = mix64(sums + lengths.astype(np.uint64) * _SHORT)
    words = np.searchsorted(at[starts], bounds)
    return hashes, np.diff(words)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its five-word shingles.

    A text of one to four words has one shingle, its whole sequence; a null text or one without words has none.
    """
    hashes, counts = word_hashes(column)
    ends = np.cumsum(counts)
    sets = []
    rolled = None
    if len(hashes) >= WORDS:
        rolled = hashes[: len(hashes) - WORDS + 1] * _PLACE[0]
        for k in range(1, WORDS):
            rolled += hashes[k : len(hashes) - WORDS + 1 + k] * _PLACE[k]
        rolled = mix64(rolled)
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        start = end - count
        if count >= WORDS:
            sets.append(np.unique(rolled[start : end - WORDS + 1]))
        elif count:
            mixed = np.sum(hashes[start:end] * _PLACE[:count], dtype=np.uint64, keepdims=True)
            sets.append(mix64(mixed + _SHORT * np.array([count], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def set_fingerprint(values: np.ndarray) -> int:
    """A signed 64-bit hash of a set of hashes, the same for equal sets."""
    with np.errstate(over="ignore"):
        total = np.sum(mix64(values ^ _BASE), dtype=np.uint64) + np.uint64(len(values)) * _SHORT
    return int(mix64(np.array([total])).view(np.int64)[0])
