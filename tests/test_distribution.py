import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lettermark.functions.binning import edge_label, log_bins
from lettermark.functions.distribution import hashed_position, percent_rank_in, value_distribution


def rows(seed=1, n=400):
    rng = random.Random(seed)
    # one group holds most rows; one has a single row; one key is NULL
    out = [("hot", rng.randrange(150)) for _ in range(n)]
    out += [(None, rng.randrange(5)) for _ in range(20)] + [("one", 3), ("gone", None), ("hot", None)]
    return [(i, g, v) for i, (g, v) in enumerate(out)]


@pytest.mark.parametrize("options", [{"few_values": True}, {}])
def test_counts_below(spark, options):
    data = rows()
    df = spark.createDataFrame(data, "id int, g string, v int")
    got = {(r.g, r.v): (r.n, r.n_below, r.n_total) for r in value_distribution(df, ["g"], "v", **options).collect()}
    want = {}
    groups = defaultdict(list)
    for _, g, v in data:
        if v is not None:
            groups[g].append(v)
    for g, vs in groups.items():
        for v in set(vs):
            want[(g, v)] = (vs.count(v), sum(x < v for x in vs), len(vs))
    assert got == want


def test_large_group_is_cut_into_ranges(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 39_989).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = value_distribution(df, ["g"], "v")
        got = [(r.v, r.n, r.n_below, r.n_total) for r in out.orderBy("v").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    below = 0
    for v, n, n_below, n_total in got:
        assert (n_below, n_total) == (below, 40_000)
        below += n
    assert below == 40_000 and [v for v, *_ in got] == list(range(39_989))
    plan = out._jdf.queryExecution().executedPlan().toString()
    specs = re.findall(r"Window \[.*windowspecdefinition\((\w+)#", plan)
    rows_by_group = re.findall(r"windowspecdefinition\(g#\w+, v#", plan)
    # values are windowed inside a range; by the group alone only the totals of its ranges are
    assert "_b" in specs and not rows_by_group


def test_percent_rank_ignores_null_and_single(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, "a", 3.0), (5, "b", 9.0)], "id int, g string, v double")
    got = {r.id: r["rank"] for r in percent_rank_in(df, ["g"], "v").collect()}
    assert got == {1: 0.0, 2: 0.5, 4: 0.5, 3: None, 5: None}


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_hashed_position(spark, digits):
    df = spark.createDataFrame([(i, "hot" if i % 5 else "cold") for i in range(300)], "id int, g string")
    df = df.withColumn("h", F.md5(F.col("id").cast("string")))
    out = hashed_position(df, ["g"], "h", "pos", digits).collect()
    for g in ("hot", "cold"):
        part = sorted((r.h, r.pos) for r in out if r.g == g)
        assert [p for _, p in part] == list(range(1, len(part) + 1))


def test_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.1, 0.5, 1.0, 10.0, 1000.0, 1001.0, None)], "v double")
    breaks, labels = (0, 0.1, 1, 10, 50, 100, 1000), ("0", "1", "1-10", "10-50", "50-100", "100-1000")
    got = [r.b for r in df.select(edge_label(F.col("v"), breaks, labels).alias("b")).collect()]
    assert got == [None, "0", "0", "1", "1", "1-10", "100-1000", None, None]


def test_log_bins_rise():
    bins = log_bins(1.2)
    assert all(lo < hi for lo, hi, _ in bins)
    assert all(a[1] == b[0] for a, b in zip(bins, bins[1:]))
    with pytest.raises(ValueError):
        log_bins(0.9)


def test_log_bins_cover_every_long():
    assert log_bins(1.2)[-1][1] > 2**63 - 1
