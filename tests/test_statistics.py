import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermark.functions.pvalues import ks_one_sided, normal_two_sided, signed_rank_two_sided, smirnov_one_sided, t_two_sided
from lettermark.operators import models
from lettermark.operators.statistics import ks_one_sample, ks_two_sample, paired_arms, paired_t, wilcoxon_signed_rank


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_p_values(spark):
    assert one(spark, t_two_sided(F.lit(2.0), F.lit(10))) == pytest.approx(0.0733880, abs=1e-6)
    assert one(spark, t_two_sided(F.lit(-3.5), F.lit(1))) == pytest.approx(1 - 2 / math.pi * math.atan(3.5), abs=1e-7)
    assert one(spark, t_two_sided(F.lit(1.96), F.lit(1_000_000))) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-5)
    assert one(spark, normal_two_sided(F.lit(2.5))) == pytest.approx(math.erfc(2.5 / math.sqrt(2)), abs=1e-9)


def test_ks_exact_against_simulation(spark):
    rng = np.random.default_rng(0)
    n, d = 8, 0.3
    x = np.sort(rng.random((200_000, n)), axis=1)
    share = np.mean(np.max(x - np.arange(n) / n, axis=1) >= d)
    assert one(spark, ks_one_sided(F.lit(d), F.lit(n))) == pytest.approx(share, abs=0.005)


def test_ks_statistic_with_ties(spark):
    vals = [0.2, 0.2, 0.5, 0.9, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "g string, id int, rank double")
    got = ks_one_sample(df, ["g"]).first()
    clean = sorted(v for v in vals if v is not None)
    assert got.ks_statistic == pytest.approx(max(x - i / 4 for i, x in enumerate(clean)))
    assert got.n == 4 and got.mu == pytest.approx(45.0)


def test_signed_rank_ties_and_zeros(spark):
    d = [0.0, 1.0, -1.0, 2.0, 2.0, -3.0, 4.0]
    df = spark.createDataFrame([("g", i, arm, (v if arm == "x" else 0.0)) for i, v in enumerate(d) for arm in "xy"], "g string, p int, arm string, v double")
    pairs = paired_arms(df, ["g"], "p", "arm", "v", "x", "y")
    got = wilcoxon_signed_rank(pairs, ["g"]).first()
    # |d|: 1 1 2 2 3 4 -> ranks 1.5 1.5 3.5 3.5 5 6
    assert got.n_nonzero == 6 and got.wilcoxon_statistic == pytest.approx(1.5 + 3.5 + 3.5 + 6)
    t = paired_t(pairs, ["g"]).first()
    assert t.t_estimate == pytest.approx(np.mean(d))
    assert t.t_statistic == pytest.approx(np.mean(d) / (np.std(d, ddof=1) / math.sqrt(len(d))))


def test_signed_rank_law(spark):
    # tabulated two-sided values: the 5 % and 1 % points of usual tables
    for v, n, p in ((0, 5, 0.0625), (2, 6, 0.09375), (8, 10, 0.048828125), (3, 10, 0.009765625), (52, 20, 0.0484)):
        assert one(spark, signed_rank_two_sided(F.lit(float(v)), F.lit(float(n)))) == pytest.approx(p, abs=5e-5)
    for n in (1, 4, 9):  # all signs
        sums = [sum(k for k in range(1, n + 1) if bits >> (k - 1) & 1) for bits in range(1 << n)]
        for v in range(n * (n + 1) // 2 + 1):
            want = min(1.0, 2 * min(sum(s <= v for s in sums), sum(s >= v for s in sums)) / 2**n)
            assert one(spark, signed_rank_two_sided(F.lit(float(v)), F.lit(float(n)))) == pytest.approx(want)


def test_signed_rank_is_exact_without_ties_and_zeros(spark):
    rows = [("exact", i, float(v), 0.0) for i, v in enumerate((1, -2, 3, 4, 5, 6))] + [("ties", i, float(v), 0.0) for i, v in enumerate((1, -1, 3, 4, 5, 6))]
    rows += [("zero", i, float(v), 0.0) for i, v in enumerate((0, -1, 3, 4, 5, 6))] + [("one", 0, 2.0, 1.0)]
    pairs = spark.createDataFrame(rows, "g string, p int, a double, b double")
    got = {r.g: r.wilcoxon_p_value for r in wilcoxon_signed_rank(pairs, ["g"]).collect()}
    assert got["exact"] == pytest.approx(2 * 3 / 64) and got["one"] == 1.0
    assert got["ties"] != pytest.approx(got["exact"]) and {r.g for r in wilcoxon_signed_rank(pairs, ["g"], 3).filter("wilcoxon_p_value < 0.09").collect()} <= {"exact", "ties", "zero"}


def smirnov_by_hand(a, b):
    """The statistic and the share of all splits of the pooled values whose gap is no smaller."""
    import itertools

    def gap(x, y):
        return max(sum(v <= z for v in y) / len(y) - sum(v <= z for v in x) / len(x) for z in x + y)

    pooled, d = a + b, gap(a, b)
    splits = list(itertools.combinations(range(len(pooled)), len(a)))
    hits = sum(gap([pooled[i] for i in s], [pooled[i] for i in range(len(pooled)) if i not in s]) >= d - 1e-9 for s in splits)
    return max(d, 0.0), hits / len(splits) if d > 0 else 1.0


def test_two_sample_law_with_and_without_ties(spark):
    rng = random.Random(6)
    cases = {f"c{k}": ([rng.randrange(6 if k % 2 else 1000) / 10 for _ in range(rng.randint(1, 5))], [rng.randrange(6 if k % 2 else 1000) / 10 for _ in range(rng.randint(1, 6))]) for k in range(12)}
    rows = [(g, "letter", v) for g, (a, _) in cases.items() for v in a] + [(g, "article", v) for g, (_, b) in cases.items() for v in b]
    df = spark.createDataFrame(rows + [("alone", "letter", 1.0)], "g string, type string, rank double")
    got = {r.g: (r.ks2_statistic, r.ks2_p_value) for r in ks_two_sample(df, ["g"]).collect()}
    assert got.pop("alone") == (None, None)
    for g, (a, b) in cases.items():
        assert got[g] == pytest.approx(smirnov_by_hand(a, b), abs=1e-9), g
    assert one(spark, smirnov_one_sided(F.lit(1.0), F.lit(3), F.lit(4), F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint")))) == pytest.approx(1 / 35)


def irls(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (mu * (1 - mu))[:, None])
        b = b + np.linalg.solve(h, x.T @ (y - mu))
    return b, np.linalg.inv(h)


def sample():
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        g, a, x = rng.choice("pq"), rng.randrange(2), rng.gauss(5, 2)
        p = 1 / (1 + math.exp(-(-2 + 0.8 * a + 0.2 * x + (0.5 if g == "p" else 0))))
        rows.append((g, a, round(x, 2), int(rng.random() < p)))
    return rows


def test_logit_and_effects(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "venue string, a int, x double, treat int")
    model = models.fit_logit(df, ["venue"], "treat", ["a", "x"])
    effects = {r.venue: r for r in models.marginal_effects(df, {"a": "a"}, ["x"]).collect()}
    fits = model.table.collect()
    assert len(fits) == 2
    for fit in fits:
        mine = np.array([[1, r[1], r[2]] for r in rows if r[0] == fit.venue], dtype=float)
        y = np.array([r[3] for r in rows if r[0] == fit.venue], dtype=float)
        b, cov = irls(mine, y)
        assert fit.beta == pytest.approx(b, abs=1e-5)
        on, off = mine.copy(), mine.copy()
        on[:, 1], off[:, 1] = 1, 0
        s = lambda m: 1 / (1 + np.exp(-m @ b))
        grad = (on * (s(on) * (1 - s(on)))[:, None] - off * (s(off) * (1 - s(off)))[:, None]).mean(axis=0)
        got = effects[fit.venue]
        assert got.ame == pytest.approx((s(on) - s(off)).mean(), abs=1e-5)
        assert got.se == pytest.approx(math.sqrt(grad @ cov @ grad), rel=1e-3)


def test_propensity_without_groups(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "venue string, a int, x double, treat int")
    got = models.propensity(df, [], ["x"]).select(F.avg("distance"), F.avg("treat")).first()
    assert got[0] == pytest.approx(got[1], abs=1e-6)


def test_fits_tell_unsettled_and_single_armed_groups(spark):
    rows = [("mixed", float(i % 7), int((i * 5) % 3 == 0)) for i in range(60)]
    rows += [("apart", float(i), int(i > 9)) for i in range(20)] + [("one", float(i), 1) for i in range(5)]
    df = spark.createDataFrame(rows, "venue string, x double, treat int")
    got = models.propensity(df, ["venue"], ["x"]).groupBy("venue").agg(
        F.count(F.lit(1)).alias("n"), F.count("distance").alias("scored"), F.bool_and("distance_converged").alias("ok")
    )
    assert {tuple(r) for r in got.collect()} == {("mixed", 60, 60, True), ("apart", 20, 20, False), ("one", 5, 0, None)}
    cut = models.fit_logit(df.filter("venue = 'mixed'"), ["venue"], "treat", ["x"], max_iter=0)
    assert [r.converged for r in cut.table.collect()] == [False]


def test_inverse_of_regular_and_singular_matrices(spark):
    r = np.random.default_rng(2)
    for k in (1, 2, 5, 24):
        x = r.normal(size=(60, k))
        h = x.T @ x
        got = spark.range(1).select(models.inverse(F.array(*[F.lit(float(v)) for v in h.ravel()]), k)).first()[0]
        assert np.allclose(np.array(got).reshape(k, k) @ h, np.eye(k), atol=1e-8)
    h = [[2.0, 0.0, 4.0], [0.0, 0.0, 0.0], [4.0, 0.0, 8.0]]  # a constant, and a column twice another
    got = spark.range(1).select(models.inverse(F.array(*[F.lit(v) for row in h for v in row]), 3)).first()[0]
    assert np.array(got).reshape(3, 3) == pytest.approx(np.diag([0.5, 0.0, 0.0]))


def test_repeated_features_do_not_change_the_probabilities(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "venue string, a int, x double, treat int").withColumns({"twice": 2 * F.col("x"), "flat": F.lit(3.0)})
    for groups in ([], ["venue"]):
        one = {tuple(r[c] for c in ("venue", "a", "x")): r.distance for r in models.propensity(df, groups, ["x", "a"]).collect()}
        two = {tuple(r[c] for c in ("venue", "a", "x")): r.distance for r in models.propensity(df, groups, ["flat", "x", "twice", "a"]).collect()}
        assert one == pytest.approx(two, abs=1e-7)


def test_very_many_groups_fit(spark):
    df = spark.range(20_000 * 8).select(
        (F.col("id") % 20_000).alias("g"), F.floor(F.col("id") / 20_000).cast("double").alias("x"),
        ((F.col("id") * 7919 + F.floor(F.col("id") / 20_000) * 31) % 5 < 2).cast("int").alias("treat"),
    )
    fits = models.fit_logit(df, ["g"], "treat", ["x"]).table
    got = fits.agg(F.count(F.lit(1)), F.count("beta"), F.count_if("converged")).first()
    assert got[0] == 20_000 and got[1] > 15_000 and got[2] > 10_000


def test_a_second_row_without_keys_is_an_error(spark):
    from lettermark.functions.keys import null_safe_join

    two = spark.range(2).withColumnRenamed("id", "a")
    assert null_safe_join(spark.range(3), two.agg(F.max("a").alias("a")), []).count() == 3
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS|more than one row"):
        null_safe_join(spark.range(3), two, []).collect()
