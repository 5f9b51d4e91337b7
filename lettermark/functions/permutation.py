"""Random orders inside groups of any size, carried as packed columns.

A row is too wide for a shuffle that each iteration needs: its group, iteration, hash and value take several times what
they tell. Here a task sorts what it holds by hash and sends one row for each group and hash block: the hashes and
the values as compressed columns. Blocks of bounded size are merged, cut at the same positions and laid side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermark.functions.keys import null_safe_join
from lettermark.session import cut_lineage

HELD_ROWS = 200_000  # rows a task sorts at once before it sends them
CHUNK = 65_536  # positions that are laid side by side at once


def packed(column: pa.Array | pa.ChunkedArray | np.ndarray) -> bytes:
    """A column as compressed bytes; whole numbers go byte plane by byte plane, so that few digits take few bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not isinstance(column, np.ndarray) and pa.types.is_integer(column.type) and not column.null_count:
        column = column.to_numpy()
    codec = pa.Codec("zstd", compression_level=1)
    if isinstance(column, np.ndarray):
        planes = np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()
        head = f"{column.dtype.str} {len(planes)} ".encode()
        return head + codec.compress(planes, asbytes=True)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("v", column.type)]), options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_batch(pa.record_batch([column], names=["v"]))
    return b" " + sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> np.ndarray | pa.Array:
    """What `packed` was given; numbers as a numpy array."""
    if data[:1] == b" ":
        with pa.ipc.open_stream(pa.py_buffer(data)[1:]) as source:
            return source.read_all().column(0).combine_chunks()
    kind, size, planes = data.split(b" ", 2)
    kind = np.dtype(kind.decode())
    raw = np.frombuffer(pa.Codec("zstd").decompress(planes, int(size), asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def joined(parts: list[np.ndarray | pa.Array]) -> np.ndarray | pa.Array:
    """Parts of one column, with and without NULLs, as one."""
    if all(isinstance(p, np.ndarray) for p in parts):
        return np.concatenate(parts)
    kind = next(p.type for p in parts if not isinstance(p, np.ndarray))
    return pa.concat_arrays([pa.array(p, kind) if isinstance(p, np.ndarray) else p for p in parts])


def taken(column: np.ndarray | pa.Array, order: np.ndarray) -> np.ndarray | pa.Array:
    return column[order] if isinstance(column, np.ndarray) else column.take(pa.array(order))


def group_codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number from 0 on for each combination of keys; NULL is a key of its own."""
    group = np.zeros(table.num_rows, np.int64)
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        mixed = group * len(codes.dictionary) + codes.indices.to_numpy()
        seen = np.flatnonzero(np.bincount(mixed, minlength=1)) if mixed.max(initial=0) < 1 << 22 else np.unique(mixed)
        group = np.searchsorted(seen, mixed)
    return group


def _words(column: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """Hashes of 8 or 16 bytes as one or two columns of whole numbers in the same order."""
    column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    raw = np.frombuffer(column.buffers()[2], ">u8", len(column) * width // 8, int(at)).reshape(-1, width // 8)
    return [raw[:, k].astype(np.uint64) for k in range(width // 8)]


def _by_hash(words: list[np.ndarray]) -> np.ndarray:
    return np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words[::-1])


def _send(batches: Iterator[pa.RecordBatch], keys: list[str], hashes: int, width: int, digits: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys, order, block, hashes, data): what a task holds, sorted by hash inside each group, order and block.

    Order 0 sorts the unit by the first hash, order i the value by hash i.
    """

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        group = group_codes(table, keys)
        small = group.astype(np.uint16) if group.max() < 1 << 16 else group
        columns = [c.to_numpy() if pa.types.is_integer(c.type) and not c.null_count else c for c in (table.column(n).combine_chunks() for n in ("unit", "value"))]
        for i in range(hashes):
            words = _words(table.column(f"h{i}"), width)
            order = _by_hash(words)
            order = order[np.argsort(small[order], kind="stable")]
            words = [w[order] for w in words]
            block = (words[0] >> np.uint64(64 - 4 * digits)).astype(np.int64) if digits else np.zeros(len(order), np.int64)
            of = group[order]
            cuts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (block[1:] != block[:-1])])
            data = taken(columns[min(i, 1)], order)
            ends = [*cuts[1:].tolist(), len(order)]
            first = pa.array(order[cuts])
            yield pa.RecordBatch.from_arrays(
                [
                    *[table.column(k).combine_chunks().take(first) for k in keys],
                    pa.array(np.full(len(cuts), i, np.int32)),
                    pa.array(block[cuts]),
                    pa.array([b"".join(len(x).to_bytes(4, "big") + x for w in words for x in [packed(w[a:b])]) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                    pa.array([packed(data[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                ],
                names=[*keys, "_order", "_block", "_hashes", "_data"],
            )

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= HELD_ROWS:
            yield from flush(held)
            held, rows = [], 0
    if held:
        yield from flush(held)


def _merge(table: pa.Table, keys: list[str], width: int) -> pa.Table:
    """The rows of one block in the order of their hashes, in chunks; `_tie` if equal hashes leave the order open."""
    words, parts = [[] for _ in range(width // 8)], []
    for hashes, data in zip(table.column("_hashes"), table.column("_data"), strict=True):
        raw = hashes.as_py()
        for w in words:
            size = int.from_bytes(raw[:4], "big")
            w.append(unpacked(raw[4 : 4 + size]))
            raw = raw[4 + size :]
        parts.append(unpacked(data.as_py()))
    words = [np.concatenate(w) for w in words]
    order = _by_hash(words)
    data = taken(joined(parts), order)
    same = np.flatnonzero(np.logical_and.reduce([w[order[1:]] == w[order[:-1]] for w in words]))
    tie = False
    if len(same):
        a, b = taken(data, same), taken(data, same + 1)
        tie = a.tolist() != b.tolist()
    starts = range(0, len(order), CHUNK)
    one = table.slice(0, 1).select([*keys, "_order", "_block"])
    return pa.table(
        {
            **{c: pa.repeat(one.column(c)[0], len(starts)) for c in one.column_names},
            "_start": pa.array(starts, pa.int64()),
            "_n": pa.array([len(data[s : s + CHUNK]) for s in starts], pa.int64()),
            "_tie": pa.array([tie] * len(starts)),
            "_data": pa.array([packed(data[s : s + CHUNK]) for s in starts], pa.binary()),
        }
    )


def _lay(table: pa.Table, keys: list[str], orders: int, unit: pa.DataType, value: pa.DataType) -> pa.Table:
    """Rows (keys, unit, values): the unit at each position of a chunk and the value there in each order."""
    chunk = table.column("_chunk")[0].as_py()
    low, high = chunk * CHUNK, (chunk + 1) * CHUNK
    parts: list[list] = [[] for _ in range(orders)]
    pieces = table.select(["_order", "_start", "_n", "_data"]).sort_by([("_order", "ascending"), ("_start", "ascending")])
    for order, start, n, data in zip(*[pieces.column(c).to_pylist() for c in pieces.column_names], strict=True):
        parts[order].append(unpacked(data)[max(low - start, 0) : min(high - start, n)])
    units, *values = [pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip((joined(p) for p in parts), [unit] + [value] * orders)]
    n, runs = len(units), len(values)
    if any(len(v) != n for v in values):
        raise ValueError("orders of one group differ in length")
    across = np.arange(n * runs).reshape(runs, n).T.reshape(-1)
    flat = pa.concat_arrays(values).take(pa.array(across))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * runs + 1, runs), pa.int32()), flat)
    return pa.table({**{k: pa.repeat(table.column(k)[0], n) for k in keys}, "unit": units, "values": lists})


def side_by_side(
    rows: DataFrame, keys: list[str], unit: str, value: str, hashes: list[Column], digits: int, width: int = 8
) -> DataFrame:
    """(keys, unit, values): in each group, units by the first hash beside the values by each further hash.

    `hashes` are texts of 32 hex digits; the first `digits` of them cut a group into blocks that one task can order.
    The first `width` bytes are sent; if that leaves an order open that shows, all 16 are. No key may be NULL.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = {c: rows.schema[c].dataType for c in (*keys, unit, value)}
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    held, orders = list(names.values()), len(hashes)
    ddl = ", ".join(f"{names[k]} {kind[k].simpleString()}" for k in keys)
    sent = rows.select(
        *[F.col(k).alias(names[k]) for k in keys], F.col(unit).alias("unit"), F.col(value).alias("value"),
        *[F.substring(F.unhex(h), 1, width).alias(f"h{i}") for i, h in enumerate(hashes)],
    ).mapInArrow(
        lambda batches: _send(batches, held, orders, width, digits),
        f"{ddl}, _order int, _block bigint, _hashes binary, _data binary",
    )
    merged = cut_lineage(
        sent.groupBy(*held, "_order", "_block").applyInArrow(
            lambda table: _merge(table, held, width),
            f"{ddl}, _order int, _block bigint, _start bigint, _n bigint, _tie boolean, _data binary",
        )
    )
    if width < 16 and not merged.filter("_tie").isEmpty():
        return side_by_side(rows, keys, unit, value, hashes, digits, 16)
    if digits:
        before = Window.partitionBy(*held, "_order").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = merged.groupBy(*held, "_order", "_block").agg(F.sum("_n").alias("_c"))
        offsets = offsets.select(*held, "_order", "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
        merged = null_safe_join(merged, offsets, [*held, "_order", "_block"], "inner").withColumn("_start", F.col("_start") + F.col("_off"))
    reached = F.sequence(F.floor(F.col("_start") / CHUNK), F.floor((F.col("_start") + F.col("_n") - 1) / CHUNK))
    unit_type, value_type = to_arrow_type(kind[unit]), to_arrow_type(kind[value])
    laid = (
        merged.select(*held, "_order", "_start", "_n", "_data", F.explode(reached).alias("_chunk"))
        .groupBy(*held, "_chunk")
        .applyInArrow(
            lambda table: _lay(table, held, orders, unit_type, value_type),
            f"{ddl}, unit {kind[unit].simpleString()}, values array<{kind[value].simpleString()}>",
        )
    )
    return laid.select(*[F.col(names[k]).alias(k) for k in keys], F.col("unit").alias(unit), "values")
