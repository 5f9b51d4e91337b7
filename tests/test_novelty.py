import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lettermark.operators import novelty


def refs(seed=3):
    rng = random.Random(seed)
    out = []
    for paper in range(30):
        for k in range(rng.choice([0, 1, 2, 5, 40 if paper == 7 else 6])):
            out.append((paper, rng.randrange(9), rng.choice([1999, 2000, None]), 2001 + paper % 2, k))
    return out


SCHEMA = "citing_paper_id bigint, reference_journal_id bigint, reference_year int, citing_year int, row_key bigint"


@pytest.mark.parametrize("block", [2, 256])
def test_pair_counts_equal_combinations(spark, monkeypatch, block):
    monkeypatch.setattr(novelty, "PAIR_BLOCK", block)
    data = refs()
    want = Counter()
    for paper in {r[0] for r in data}:
        mine = [r for r in data if r[0] == paper]
        for a, b in combinations([r[1] for r in mine], 2):
            want[(mine[0][3], min(a, b), max(a, b))] += 1
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.citing_year, r.j1, r.j2): r.n for r in novelty.pair_counts(df, ["citing_year"]).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("digits", [None, 1])
def test_shuffle_keeps_margins(spark, digits):
    data = refs()
    df = spark.createDataFrame(data, SCHEMA)
    keys = ["citing_year", "reference_year"]
    out = novelty.shuffle_within(df, keys, "reference_journal_id", "citing_paper_id", "row_key", 3, digits=digits).collect()
    kept = [r for r in data if r[2] is not None]
    moved = False
    for it in (1, 2, 3):
        mine = [r for r in out if r.iteration == it]
        assert Counter((r.citing_year, r.reference_year, r.reference_journal_id) for r in mine) == Counter((r[3], r[2], r[1]) for r in kept)
        assert Counter((r.citing_paper_id, r.reference_year) for r in mine) == Counter((r[0], r[2]) for r in kept)
        moved |= Counter((r.citing_paper_id, r.reference_journal_id) for r in mine) != Counter((r[0], r[1]) for r in kept)
    assert moved


def test_zscore_cases(spark):
    obs = spark.createDataFrame([(1, 1, 2, 5), (1, 1, 3, 2), (1, 2, 2, 4), (1, 3, 3, 2)], "citing_year int, j1 bigint, j2 bigint, n bigint")
    nulls = spark.createDataFrame(
        [(1, 1, 1, 2, 3), (1, 2, 1, 2, 1), (1, 1, 2, 2, 4), (1, 2, 2, 2, 4), (1, 1, 3, 3, 3), (1, 2, 3, 3, 3)],
        "citing_year int, iteration int, j1 bigint, j2 bigint, n bigint",
    )
    got = {(r.j1, r.j2): r.z for r in novelty.pair_zscores(obs, nulls, 2).collect()}
    assert got[(1, 2)] == pytest.approx((5 - np.mean([3, 1])) / np.std([3, 1]))
    assert got[(1, 3)] == float("inf")  # in no iteration: spread and mean are zero
    assert np.isnan(got[(2, 2)])
    assert got[(3, 3)] == float("-inf")


def test_paper_scores_match_numpy(spark):
    data = refs(5)
    z = {(y, a, b): float((a * 7 + b * 3 + y) % 11) for y in (2001, 2002) for a in range(9) for b in range(a, 9) if (a + b) % 4}
    zdf = spark.createDataFrame([(y, a, b, v) for (y, a, b), v in z.items()], "year int, j1 bigint, j2 bigint, z double")
    df = spark.createDataFrame(data, SCHEMA).select("citing_paper_id", "reference_journal_id")
    cohort = spark.createDataFrame([(p, 2001 + p % 2) for p in range(30)] + [(99, 1990)], "id bigint, year int")
    got = {r.id: (r.zscore_median, r.zscore_10th, r.pairs) for r in novelty.paper_novelty(zdf, cohort, df, 2000, 2005).collect()}
    for paper in range(30):
        js = [r[1] for r in data if r[0] == paper]
        vals = [z.get((2001 + paper % 2, min(p), max(p)), 0.0) for p in combinations(js, 2)]
        if vals:
            assert got[paper] == pytest.approx((np.median(vals), np.percentile(vals, 10), len(vals)))
        else:
            assert paper not in got
