"""Many matching problems settled at once, against a loop over each."""

import random

import pyarrow as pa
import pytest

from lettermark.functions import choices

NAMES = ["_s", "g", "t", "ordinal", "need", "width", "limit", "c", "room", "gap", "v0", "v1"]


def serial(rows):
    """The rule, one problem after the other: (grants, moves)."""
    grants, moves = [], []
    for key in sorted({r[:2] for r in rows}):
        mine = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], -1 if r[9] is None else r[9], r[10] or 0, r[11] or 0))
        free, move = {}, None
        for ordinal in sorted({r[3] for r in mine}):
            own = [r for r in mine if r[3] == ordinal]
            left = own[0][4]
            for r in own:
                if r[7] is not None and r[9] < r[6] and left:
                    units = min(left, free.setdefault(r[7], r[8]))
                    free[r[7]] -= units
                    left -= units
                    if units:
                        grants.append((*key, r[2], ordinal, r[7], units, r[9], r[10], r[11]))
            move = (*key, ordinal + 1, None, own[0][5])
            if left and own[0][6] != float("inf"):
                move = (*key, ordinal, left, 2 * own[0][5])
                break
        moves.append(move)
    return grants, moves


@pytest.mark.parametrize("lot", [1, 30, 100_000])
def test_many_problems_equal_a_loop(monkeypatch, lot):
    monkeypatch.setattr(choices, "LOT_ROWS", lot)
    rng = random.Random(lot)
    rows = []
    for s in range(40):
        for g in range(3):
            width = rng.choice([1, 2, 8])
            for t in range(rng.randrange(1, 6)):
                limit, need = rng.choice([0.5, 2.0, float("inf")]), rng.randrange(1, 4)
                near = [(c, rng.randrange(1, 4), c / 8 if t % 2 else abs(c - 4) / 8, float(c), 0.5) for c in rng.sample(range(9), rng.randrange(9))]
                rows += [(s, g, 100 * s + t, t + 3, need, width, limit, *n) for n in near or [(None,) * 5]]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.int64(), pa.int64(), *[pa.float64()] * 3]
    table = pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(NAMES, types))})
    out = [r for b in choices.choose(iter(table.to_batches(max_chunksize=7)), ["v0", "v1"]) for r in b.to_pylist()]
    names = ["_s", "g", "t", "ordinal", "c", "units", "gap", "v0", "v1"]
    got = [tuple(r[n] for n in names) for r in out if r["t"] is not None]
    moved = [tuple(r[n] for n in ("_s", "g", "next", "left", "width")) for r in out if r["t"] is None]
    grants, moves = serial(rows)
    assert got == grants and sorted(moved) == sorted(moves)
