"""Product codes of vectors: Lloyd rounds whose assignments skip work by Drake-Hamerly bounds, in whole numbers.

Components become integers; each of the equal parts of a vector is coded by the nearest of its position's entries.

1. The first assignment measures every entry. It leaves with each part its entry, the `b` next closest entries with
   their lower bounds, and one outer bound for all others, as a written table.
2. After entries have moved, a bound falls by its entry's movement (the outer one by the largest). A part whose exact
   distance lies below all bounds keeps its entry. Otherwise the listed entries that its bounds do not rule out are
   measured, and only where the outer bound does not hold either are all entries.
3. How many listed entries were in doubt decides the length of the next lists.

Bounds are distances rounded down, movements are rounded up, and distances are exact integers, so a bound never decides
what the integers do not: whatever it leaves open is settled by integers, with ties to the lower index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.functions.keys import null_safe_join
from lettermark.session import cut_lineage

#: Integer components below this keep squared distances of a part exact in double precision (checked with its length).
EXACT = 1 << 53


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances int64[rows, entries] of integer rows to integer entries.

    A matrix product in double precision where every sum is below 2**53, and so exact; Python's integers beyond.
    """
    most = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if x.shape[1] * most * most < EXACT:
        a, c = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1) - 2.0 * (a @ c.T)).astype(np.int64)
    wide = x.astype(object)[:, None, :] - entries.astype(object)
    return (wide * wide).sum(2)


def own_squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to one integer row each."""
    d = x - entry
    most = int(np.abs(d).max(initial=0))
    if x.shape[1] * most * most < 1 << 62:
        return (d * d).sum(1)
    d = d.astype(object)
    return (d * d).sum(1)


def floor_root(squares: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    if squares.dtype == object:
        return np.array([math.isqrt(int(s)) for s in squares.ravel()], np.int64).reshape(squares.shape)
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def ceil_root(squares: np.ndarray) -> np.ndarray:
    root = floor_root(squares)
    return root + (root * root < squares).astype(np.int64)


class State:
    """Per part: its entry, the listed entries by rising bound, their bounds, and the outer bound."""

    def __init__(self, code: np.ndarray, near: np.ndarray, low: np.ndarray):
        self.code, self.near, self.low = code, near, low  # [rows], [rows, b], [rows, b + 1]


def measured(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[State, np.ndarray]:
    """State and exact squared distance of parts after measuring every entry."""
    d = squared(x, entries)
    order = np.argsort(d, axis=1, kind="stable")
    b = max(0, min(b, len(entries) - 1))
    rows = np.arange(len(x))
    code, near = order[:, 0], order[:, 1 : b + 1]
    low = np.full((len(x), b + 1), np.iinfo(np.int64).max)
    low[:, :b] = floor_root(np.take_along_axis(d, near, 1))
    if b + 1 < len(entries):
        low[:, b] = floor_root(d[rows, order[:, b + 1]])
    return State(code, near, low), d[rows, code]


def moved(state: State, moves: np.ndarray) -> State:
    """The state after entry k has moved by at most moves[k]."""
    low = state.low.copy()
    far = low == np.iinfo(np.int64).max
    low[:, :-1] -= moves[state.near]
    low[:, -1] -= int(moves.max(initial=0))
    low = np.where(far, np.iinfo(np.int64).max, np.maximum(low, -1))
    return State(state.code, state.near, low)


def reassigned(x: np.ndarray, entries: np.ndarray, state: State) -> tuple[State, np.ndarray, np.ndarray]:
    """New state, exact squared distances, and how many listed entries stood in doubt (one more than all: measured anew).

    `state` already allows for the movement. An entry is out of reach only where its bound is above the distance
    rounded down, so an equally near entry of a lower index is never missed.
    """
    wide = state.near.shape[1]
    code, near, low = state.code.copy(), state.near.copy(), state.low.copy()
    exact = own_squared(x, entries[code])
    doubt = low <= floor_root(exact)[:, None]
    anew = np.flatnonzero(doubt[:, -1])
    count = np.where(doubt[:, -1], wide + 1, doubt[:, :-1].sum(1))
    for k in range(wide):
        some = np.flatnonzero(doubt[:, k] & ~doubt[:, -1])
        if not len(some):
            continue
        other = near[some, k]
        d = own_squared(x[some], entries[other])
        wins = (d < exact[some]) | ((d == exact[some]) & (other < code[some]))
        # The loser takes the place in the list, with its own distance as the bound.
        low[some, k] = floor_root(np.where(wins, exact[some], d))
        near[some, k] = np.where(wins, code[some], other)
        code[some], exact[some] = np.where(wins, other, code[some]), np.where(wins, d, exact[some])
    if len(anew):
        fresh, exact[anew] = measured(x[anew], entries, wide)
        code[anew], near[anew], low[anew] = fresh.code, fresh.near, fresh.low
    return State(code, near, low), exact, count


def narrowed(state: State, b: int) -> State:
    """The state with a list of `b` entries; what leaves it is covered by the outer bound."""
    wide = state.near.shape[1]
    if b >= wide:
        return state
    order = np.argsort(state.low[:, :wide], axis=1, kind="stable")
    near, inner = np.take_along_axis(state.near, order, 1), np.take_along_axis(state.low[:, :wide], order, 1)
    outer = np.minimum(inner[:, b], state.low[:, -1])
    return State(state.code, near[:, :b], np.concatenate((inner[:, :b], outer[:, None]), 1))


def next_width(counts: np.ndarray, wide: int) -> int:
    """The least list that holds the entries in doubt of all but a hundredth of the parts; never longer than now."""
    inside = counts[counts <= wide]
    return wide if 100 * len(inside) < 99 * len(counts) else max(1, min(wide, int(np.quantile(counts, 0.99, method="higher"))))


def integer_vectors(vectors: DataFrame, scale: int = 256, parts: int = 16) -> DataFrame:
    """(vec_id, label, x): floor(scale * component) of the vectors that can be coded, as a written table.

    Vectors that are NULL or hold a NULL or non-finite component are left out, and so are those that cannot be cut into
    `parts` or have another length than the first. A component must stay below 2**62 after scaling; more is an error.
    """
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    kept = vectors.select("vec_id", "label", "embedding").where(F.coalesce(usable, F.lit(False)) & fits)
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    safe = F.when(F.exists("embedding", lambda v: F.abs(v.cast("double") * scale) >= 2.0**62), F.raise_error(F.lit("component too large to code"))).otherwise(whole)
    kept = cut_lineage(kept.select("vec_id", "label", safe.alias("x")))
    length = kept.agg(F.min_by(F.size("x"), F.struct(F.col("vec_id").isNull(), "vec_id", "x"))).first()[0]
    return kept if length is None else kept.where(F.size("x") == length)


def _rows(batch: pa.RecordBatch, name: str, parts: int) -> np.ndarray:
    """A list column as int64[rows, parts, rest]."""
    flat = batch.column(name).flatten()
    return np.asarray(flat, np.int64).reshape(batch.num_rows, parts, -1)


def _moves(old: np.ndarray | None, new: np.ndarray) -> np.ndarray | None:
    """How far each entry moved at most, rounded up: int64[parts, entries]."""
    if old is None:
        return None
    return np.stack([ceil_root(own_squared(o, n)) for o, n in zip(old, new, strict=True)])


def assign(table: DataFrame, books: np.ndarray, b: int, moves: np.ndarray | None = None, keep: bool = True) -> DataFrame:
    """`table` with every part assigned to `books` int64[parts, entries, length]: code, error, and the state if kept.

    Without `moves` all entries are measured and lists of `b` are kept. With them the state in `table` decides what is
    left to measure, and the rows of a batch choose the length of their next lists by the entries that stood in doubt.
    """
    parts = len(books)
    state = ", near binary, low array<long>, width int" if keep else ""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, x, found, counts = batch.num_rows, _rows(batch, "x", parts), [], []
        error: np.ndarray = np.zeros(n, np.int64)
        if moves is not None:
            wide = batch.column("width")[0].as_py()
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint8).reshape(n, parts, wide).astype(np.int64)
            low = _rows(batch, "low", parts)
        for p in range(parts):
            if moves is None:
                new, exact = measured(x[:, p], books[p], b)
            else:
                new, exact, count = reassigned(x[:, p], books[p], moved(State(old[:, p], near[:, p], low[:, p]), moves[p]))
                counts.append(count)
            error = error + exact
            found.append(new)
        codes = np.stack([s.code for s in found], 1).astype(np.uint8)
        columns = [batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([int(e) for e in error], pa.int64())]
        names = ["vec_id", "label", "x", "code", "error"]
        if keep:
            if moves is not None and wide:
                width = next_width(np.concatenate(counts), wide)
                found = [narrowed(s, width) for s in found]
            listed = np.stack([s.near for s in found], 1).astype(np.uint8)
            bounds = np.stack([s.low for s in found], 1).reshape(n, -1)
            columns += [pa.array([r.tobytes() for r in listed], pa.binary()), pa.array(list(bounds), pa.list_(pa.int64())), pa.array(np.full(n, listed.shape[2], np.int32))]
            names += ["near", "low", "width"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                if moves is None:
                    yield one(batch)
                    continue
                width = np.asarray(batch.column("width"))
                for w in np.unique(width):
                    yield one(batch.take(pa.array(np.flatnonzero(width == w))))

    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    return table.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<long>, code binary, error long{state}")


def recentred(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books with every used entry replaced by floor(sum / count) of its parts.

    Each task sends one row for every entry it used; only the sums of all entries, whose number is fixed, reach the driver.
    """
    parts, entries, length = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, length), object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch, "x", parts).reshape(-1, length)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            place = (code + np.arange(parts) * entries).ravel()
            count += np.bincount(place, minlength=len(count))
            if int(np.abs(x).max(initial=0)) * len(x) < EXACT:
                part = np.stack([np.bincount(place, x[:, k], len(count)) for k in range(length)], 1).astype(np.int64)
            else:
                part = np.zeros((len(count), length), object)
                np.add.at(part, place, x.astype(object))
            total += part
        used = np.flatnonzero(count)
        if len(used):
            rows = [(int(i), int(count[i]), [str(v) for v in total[i]]) for i in used]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["place", "n", "sums"])

    found = table.select("x", "code").mapInArrow(sums, "place int, n long, sums array<string>")
    each = [F.sum(F.get("sums", k).cast("decimal(38,0)")).alias(f"s{k}") for k in range(length)]
    out = books.reshape(parts * entries, length).copy()
    for row in found.groupBy("place").agg(F.sum("n").alias("n"), *each).collect():
        out[row["place"]] = [int(row[f"s{k}"]) // row["n"] for k in range(length)]
    return out.reshape(books.shape)


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, b: int = 8) -> DataFrame:
    """Per vector of `vectors` (vec_id, embedding, label) that can be coded: vec_id, code, error, label_error, codebooks_sha256.

    `code` has two hex digits a part, `error` the squared distances summed over parts, `label_error` its sum over equal
    labels, NULL labels together. The books start from the vectors with the smallest vec_ids (equal ids: by components;
    NULL ids come last); with fewer vectors than `entries` there are fewer entries. See `integer_vectors` for what is left out.
    Rows that repeat an id are vectors of their own, other columns are ignored, an empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must fit one byte")
    table = integer_vectors(vectors, scale, parts)
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return table.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = np.stack([np.array(r["x"], np.int64).reshape(parts, -1) for r in first], 1)
    old = None
    for _ in range(rounds):
        table = cut_lineage(assign(table, books, b, _moves(old, books)))
        old, books = books, recentred(table, books)
    final = cut_lineage(assign(table, books, b, _moves(old, books), keep=False).select("vec_id", "label", "code", "error"))
    by_label = final.groupBy("label").agg(F.sum("error").cast("long").alias("label_error"))
    coded = final.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    return null_safe_join(coded, by_label, ["label"], "inner").select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
