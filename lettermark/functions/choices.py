"""Serial choice inside many small problems, many problems at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOT_ROWS = 100_000  # rows of whole problems that are sorted and settled at once


def whole_problems(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of about LOT_ROWS rows that hold all rows of each of their keys; the input lies by key."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and any(c[0] != x for c, x in zip(columns, last, strict=True))
        starts = np.flatnonzero(new)
        if len(starts) and rows + batch.num_rows >= LOT_ROWS:
            cut = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
        last = [c[-1] for c in columns]
    if rows:
        yield pa.Table.from_batches(held)


def choose(batches: Iterator[pa.RecordBatch], value: list[str]) -> Iterator[pa.RecordBatch]:
    """Serial choice in each stratum and problem: grants, and where the next round goes on.

    Rows are the treated types of the round with their next candidates. A type whose candidates run out while nearer
    unseen ones may exist keeps what it has and ends the round; the next one looks twice as far.
    """
    whole = ["_s", "g", "t", "ordinal", "c", "units"]
    then = ["next", "left", "width"]
    for table in whole_problems(batches, ["_s", "g"]):
        number = lambda c, none=0: table.column(c).combine_chunks().fill_null(none).to_numpy()  # noqa: B023, E731
        first = [np.nan_to_num(number(v, -np.inf), nan=-np.inf, posinf=np.inf, neginf=-np.inf) for v in ["gap", *value]]
        order = np.lexsort([*first[::-1], number("ordinal"), number("g"), number("_s")])
        s, g, ordinal, need, width, t, c, room = (number(x).astype(np.int64)[order] for x in ("_s", "g", "ordinal", "need", "width", "t", "c", "room"))
        limit, gap = number("limit")[order], first[0][order]
        near = table.column("c").combine_chunks().is_valid().to_numpy(zero_copy_only=False)[order] & (gap < limit)
        problem = np.r_[True, (s[1:] != s[:-1]) | (g[1:] != g[:-1])]
        start = np.flatnonzero(problem | np.r_[True, ordinal[1:] != ordinal[:-1]])
        end = np.r_[start[1:], len(s)].tolist()
        at = start.tolist()
        opens = problem[start].tolist()
        far = (limit[start] != np.inf).tolist()
        s_, g_, t_, ordinal_, need_, width_ = (x[start].tolist() for x in (s, g, t, ordinal, need, width))
        near_, c_, room_ = near.tolist(), c.tolist(), room.tolist()
        grants: list[tuple[int, int]] = []  # row, units
        moves: list[tuple[int, int, int, int | None, int]] = []
        free: dict[int, int] = {}
        ended = False
        for k, a in enumerate(at):
            if opens[k]:
                free, ended = {}, False
                moves.append((s_[k], g_[k], 0, None, 0))
            if ended:
                continue
            left = need_[k]
            for row in range(a, end[k]):
                if not left:
                    break
                if near_[row]:
                    units = min(left, free.setdefault(c_[row], room_[row]))
                    if units:
                        free[c_[row]] -= units
                        left -= units
                        grants.append((row, units))
            ended = bool(left) and far[k]
            moves[-1] = (s_[k], g_[k], ordinal_[k], left, 2 * width_[k]) if ended else (s_[k], g_[k], ordinal_[k] + 1, None, width_[k])
        took = np.array([row for row, _ in grants], np.int64)
        of = {"_s": s, "g": g, "t": t, "ordinal": ordinal, "c": c}
        won = {**{n: pa.array(of[n][took], pa.int64()) for n in of}, "units": pa.array([u for _, u in grants], pa.int64())}
        won |= {v: pa.array(number(v, np.nan)[order][took], pa.float64(), from_pandas=True) for v in ["gap", *value]}
        won |= {n: pa.nulls(len(took), pa.int64()) for n in then}
        moved = {n: pa.nulls(len(moves), pa.int64() if n in whole else pa.float64()) for n in [*whole, "gap", *value]}
        moved |= {n: pa.array([m[i] for m in moves], pa.int64()) for i, n in enumerate(["_s", "g", *then])}
        names = [*whole, "gap", *value, *then]
        for part in (won, moved):
            yield pa.RecordBatch.from_arrays([part[n] for n in names], names=names)
