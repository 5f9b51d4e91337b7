"""Pairs inside lists, counted in the task that holds the lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermark.functions.permutation import group_codes

HELD_ROWS = 250_000  # rows of whole lists that are paired at once
HELD_PAIRS = 2_000_000  # pairs that are added up at once


class _Sums:
    """Weights added up by a whole number."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self.held.append((codes, weights))
        self.rows += len(codes)
        if self.rows > HELD_PAIRS:
            done = self.total()
            self.held, self.rows = [done], len(done[0]) // 2

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        codes, weights = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 2
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def _rows(table: pa.Table, keys: list[str], at: np.ndarray, one: pa.Array, two: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    rest = pa.nulls(len(n), pa.binary())
    return pa.RecordBatch.from_arrays(
        [*[table.column(k).combine_chunks().take(pa.array(at)) for k in keys], one, two, pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), np.int64)), rest],
        names=[*keys, "j1", "j2", "n", "_part", "_tile"],
    )


def _tile(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole lists; a list begins where `_k` is 1."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        starts = np.flatnonzero(batch.column("_k").to_numpy() == 1)
        if rows + batch.num_rows >= HELD_ROWS and len(starts):
            held.append(batch.slice(0, int(starts[-1])))
            if sum(b.num_rows for b in held):
                yield pa.Table.from_batches(held)
            held, rows, batch = [], 0, batch.slice(int(starts[-1]))
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _pair(batches: Iterator[pa.RecordBatch], keys: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """Counts (keys, j1, j2, n) of what a task holds; of lists with more than `block` values the tiles of their pairs."""
    for table in _lists(batches):
        values = table.column("_j").combine_chunks().dictionary_encode()
        codes, names = values.indices.to_numpy().astype(np.int64), values.dictionary
        first = table.column("_k").combine_chunks().to_numpy() == 1
        first[0] = True
        new = first.copy()
        new[1:] |= codes[1:] != codes[:-1]
        entry = np.flatnonzero(new)
        times = np.diff(np.r_[entry, len(codes)]).astype(np.int64)
        of, code = (np.cumsum(first) - 1)[entry], codes[entry]
        group = group_codes(table, keys)[entry]
        row_of_group = np.zeros(int(group.max()) + 1, np.int64)
        row_of_group[group] = entry
        wide = len(names)
        sums = _Sums()
        twice = times > 1
        sums.add((group[twice] * wide + code[twice]) * wide + code[twice], times[twice] * (times[twice] - 1) // 2)
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        size = np.diff(np.r_[start, len(of)])
        short = np.repeat(size <= block, size)
        left = np.flatnonzero(short)
        for lag in range(1, int(size[size <= block].max(initial=0))):
            left = left[left + lag < len(of)]
            left = left[of[left + lag] == of[left]]
            sums.add((group[left] * wide + code[left]) * wide + code[left + lag], times[left] * times[left + lag])
        found, n = sums.total()
        yield _rows(table, keys, row_of_group[found // wide // wide], names.take(pa.array(found // wide % wide)), names.take(pa.array(found % wide)), n)
        for a, length in zip(start[size > block].tolist(), size[size > block].tolist(), strict=True):
            list_of = pa.RecordBatch.from_arrays([names.take(pa.array(code[a : a + length])), pa.array(times[a : a + length])], names=["j", "m"])
            blocks = [list_of.slice(s, block) for s in range(0, length, block)]
            one = [table.column(k).combine_chunks().take(pa.array(entry[a : a + 1])) for k in keys]
            for x, b in enumerate(blocks):
                # the pairs of one block with itself and those behind it; a row for each, so that tasks share them
                tiles = [_tile(b) + _tile(c) for c in blocks[x:]]
                full = [pa.concat_arrays([c] * len(tiles)) for c in one]
                none = pa.nulls(len(tiles), names.type)
                parts = pa.array(np.arange(len(tiles)) * len(blocks) + x)
                yield pa.RecordBatch.from_arrays(
                    [*full, none, none, pa.nulls(len(tiles), pa.int64()), parts, pa.array(tiles, pa.binary())], names=[*keys, "j1", "j2", "n", "_part", "_tile"]
                )


def _finish(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts as they are, tiles as the counts of their pairs."""
    for batch in batches:
        tile = batch.column("_tile").is_valid().to_numpy(zero_copy_only=False)
        plain = batch.select([*keys, "j1", "j2", "n"])
        yield plain.filter(pa.array(~tile))
        for at in np.flatnonzero(tile).tolist():
            source = pa.BufferReader(batch.column("_tile")[at].as_py())
            left, right = (pa.ipc.open_stream(source).read_all().combine_chunks() for _ in range(2))
            i, k = np.meshgrid(np.arange(left.num_rows), np.arange(right.num_rows), indexing="ij")
            inside = (i < k if left.equals(right) else i >= 0).reshape(-1)
            i, k = i.reshape(-1)[inside], k.reshape(-1)[inside]
            n = left.column("m").to_numpy()[i] * right.column("m").to_numpy()[k]
            one = plain.slice(at, 1)
            j1, j2 = (t.column("j").combine_chunks().take(pa.array(x)) for t, x in ((left, i), (right, k)))
            yield pa.RecordBatch.from_arrays([*[pa.repeat(one.column(c)[0], len(n)) for c in keys], j1, j2, pa.array(n)], names=plain.schema.names)


def counted_pairs(rows: DataFrame, keys: list[str], list_of: str, value: str, block: int) -> DataFrame:
    """(keys, j1, j2, n): how often two values meet in a list, each list being the rows of one `list_of` under one key.

    Rows come to the task sorted by list and value, or stay where they are if they lie together already; there, equal
    values collapse and pairs are added up before any of them is a row. Lists of more than `block` different values
    are cut into tiles of `block` by `block` values, which tasks share.
    """
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    held = list(names.values())
    kind = lambda c: rows.schema[c].dataType.simpleString()
    ddl = "".join(f"{names[k]} {kind(k)}, " for k in keys) + f"j1 {kind(value)}, j2 {kind(value)}, n bigint"
    place = F.row_number().over(Window.partitionBy(list_of, *keys).orderBy(value)).alias("_k")
    lists = rows.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(names[k]) for k in keys], F.col(value).alias("_j"), place)
    partial = lists.mapInArrow(lambda batches: _pair(batches, held, block), f"{ddl}, _part bigint, _tile binary")
    done = partial.repartition(*held, "j1", "j2", "_part").mapInArrow(lambda batches: _finish(batches, held), ddl)
    return done.groupBy(*held, "j1", "j2").agg(F.sum("n").alias("n")).select(*[F.col(names[k]).alias(k) for k in keys], "j1", "j2", "n")
