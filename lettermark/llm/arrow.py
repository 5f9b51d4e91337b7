"""Helpers for functions that run over Arrow batches: text as bytes, words, and rows of one key."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes outside space and the control characters 9 to 13.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Digits, a-z and every byte of a character beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, NULL as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together; a longer text has a range of its own."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of True that stay within one row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(mask) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    starts = np.flatnonzero(mask & (~before | cut[:-1]))
    ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return starts, ends


_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 3
_BACK = pow(_STEP, -1, 1 << 64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, kept once for each Python worker."""
    kept = sys.__dict__.setdefault("_lettermark_powers", [np.zeros(0, np.uint64)] * 2)
    if len(kept[0]) <= n:
        size = max(n, 1 << 20)
        kept[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, base, np.uint64)))) for base in (np.uint64(_STEP), np.uint64(_BACK))]
    return kept[0], kept[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes, from one running sum over all of them."""
    up, down = _powers_to(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def keyed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by the keys; holds one key's rows at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        table = pa.Table.from_batches([batch])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (a or first != last):
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.concat_tables(held)
