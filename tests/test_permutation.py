"""Orders side by side and pairs inside lists, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettermark.functions import pairs, permutation
from lettermark.operators import novelty

SCHEMA = "y int, g string, unit bigint, k bigint, v bigint"


def rows(seed=4, n=700):
    rng = random.Random(seed)
    out = [(2000, "hot", rng.randrange(90), i, rng.choice([None, *range(-5, 300)])) for i in range(n)]
    return out + [(2001, rng.choice("ab"), rng.randrange(40), i, rng.randrange(4)) for i in range(60)] + [(2002, None, 1, 1, 1), (2003, "one", 5, 5, 5)]


def expected(data, iterations):
    """The shuffle as the SQL words it: the value at the same rank under another md5 order."""
    key = lambda i, r: hashlib.md5(f"0|{i}|{r[2]}|{r[3]}".encode()).hexdigest()
    groups, out = defaultdict(list), Counter()
    for r in data:
        if r[0] is not None and r[1] is not None:
            groups[r[:2]].append(r)
    for g, mine in groups.items():
        slots = sorted(mine, key=lambda r: key("slot", r))
        for i in range(1, iterations + 1):
            out.update((*g, i, s[2], d[4]) for s, d in zip(slots, sorted(mine, key=lambda r: key(i, r))))
    return out


@pytest.mark.parametrize("digits, chunk, held", [(None, 65_536, 400_000), (1, 64, 100), (2, 7, 400_000)])
def test_shuffle_equals_serial(spark, monkeypatch, digits, chunk, held):
    monkeypatch.setattr(permutation, "CHUNK", chunk)
    monkeypatch.setattr(permutation, "HELD_ROWS", held)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    out = novelty.shuffle_within(df, ["y", "g"], "v", "unit", "k", 3, digits=digits)
    assert out.dtypes == [("y", "int"), ("g", "string"), ("iteration", "int"), ("unit", "bigint"), ("v", "bigint")]
    assert Counter(tuple(r) for r in out.collect()) == expected(data, 3)


def test_equal_first_bytes_are_told_apart(spark):
    # hashes that differ in their last bytes only: 8 bytes leave the order open, 16 do not
    data = [(1, u, 100 + u) for u in range(50)]
    df = spark.createDataFrame(data, "g int, unit bigint, v bigint")
    up = F.concat(F.repeat(F.lit("0"), 24), F.lpad(F.hex("unit"), 8, "0"))
    down = F.concat(F.repeat(F.lit("0"), 24), F.lpad(F.hex(100 - F.col("unit")), 8, "0"))
    got = {r.unit: r["values"] for r in permutation.side_by_side(df, ["g"], "unit", "v", [up, down, up], 0).collect()}
    assert got == {u: [149 - u, 100 + u] for u in range(50)}


def test_texts_are_dealt_too(spark):
    data = [(1, f"p{i % 7}", i, None if i % 5 == 0 else f"j{i}") for i in range(40)]
    df = spark.createDataFrame(data, "g int, unit string, k int, v string")
    out = novelty.shuffle_within(df, ["g"], "v", "unit", "k", 2).collect()
    assert Counter((r.iteration, r.v) for r in out) == Counter((i, r[3]) for r in data for i in (1, 2))
    assert Counter((r.iteration, r.unit) for r in out) == Counter((i, r[1]) for r in data for i in (1, 2))


@pytest.mark.parametrize("column", [np.arange(9, dtype=np.uint64) << np.uint64(40), pa.array([3, None, -7], pa.int32()), pa.array(["a", "", None])])
def test_packed_columns_come_back(column):
    again = permutation.unpacked(permutation.packed(column))
    assert again.tolist() == column.tolist() if isinstance(column, np.ndarray) else again.to_pylist() == column.to_pylist()


def test_a_row_takes_few_bytes():
    """A sorted 64-bit hash and one of 25 values in less than 8 bytes (as a row: six fields of 8 and a text of 32)."""
    rng = np.random.default_rng(1)
    hashes, values = np.sort(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64) * np.uint64(2)), rng.integers(1, 26, 100_000)
    assert len(permutation.packed(hashes)) + len(permutation.packed(values)) < 8 * 100_000


def test_null_pairs_move_no_row_per_iteration(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = novelty.pair_counts(novelty.shuffle_within(df, ["y", "g"], "v", "unit", "k", 3), ["y", "iteration"], "unit", "v")
    lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    text = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("posexplode" in line for line in lines)
    top = next(i for i, line in enumerate(text) if "Window" in line and "row_number" in line)
    low = next(i for i, line in enumerate(text) if "posexplode" in line)
    assert not [line for line in text[top:low] if "Exchange" in line]


@pytest.mark.parametrize("block, held, most", [(2, 5, 3), (3, 40, 2_000_000), (256, 500_000, 2_000_000)])
def test_pairs_of_long_and_short_lists(spark, monkeypatch, block, held, most):
    monkeypatch.setattr(pairs, "HELD_ROWS", held)
    monkeypatch.setattr(pairs, "HELD_PAIRS", most)
    rng = random.Random(8)
    data = [(rng.choice([1, 2, None]), p, rng.choice([None, *range(9)])) for p in range(25) for _ in range(40 if p == 3 else rng.randrange(6))]
    want = Counter()
    for year in (1, 2, None):
        for p in range(25):
            mine = sorted(j for y, q, j in data if (y, q) == (year, p) and j is not None)
            want.update((year, a, b) for i, a in enumerate(mine) for b in mine[i + 1 :])
    df = spark.createDataFrame(data, "y int, p bigint, j bigint").repartition(2)
    got = {(r.y, r.j1, r.j2): r.n for r in pairs.counted_pairs(df, ["y"], "p", "j", block).collect()}
    assert got == dict(want)
