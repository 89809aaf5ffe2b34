"""Helpers, the encoder, categorical ranges and looked-up rates against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from gradewise.functions.frames import ordered_concat
from gradewise.operators import metrics as M
from gradewise.operators.bins import INF, BinningModel, BinSpec
from gradewise.operators.encoder import WoEEncoder
from gradewise.operators.matched_ar import matched_ar
from gradewise.operators.psi import out_of_range_share
from gradewise.operators.refit import logistic_from_coefficients, rng_for, spawn_seeds
from gradewise.plans.spec import Gates


def scored(spark, n=4000, seed=1):
    rng = np.random.RandomState(seed)
    x = rng.standard_normal(n)
    p = np.round(1 / (1 + np.exp(3 - 1.2 * x)), 3)
    y = (rng.rand(n) < p).astype(int)
    cell = np.where(rng.rand(n) < 0.3, "a", "b")
    p = np.where(cell == "a", np.minimum(p * 3, 0.99), p)
    return spark.createDataFrame(list(zip(cell.tolist(), x.tolist(), p.tolist(), y.tolist(), strict=True)), "cell string, x double, p double, y int"), cell, p, y


def gini(p, y):
    wins = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    return 2 * wins - 1


def test_metrics_from_counts_equal_plain_ones(spark):
    df, cell, p, y = scored(spark)
    got = {r["cell"]: r for r in M.performance_bundle(df, ["cell"], "y", "p").collect()}
    direct = {r["cell"]: r for r in M.moments(df, ["cell"], "y", "p").collect()}
    for c in "ab":
        a, b = p[cell == c], y[cell == c]
        assert abs(got[c]["gini"] - gini(a, b)) < 1e-9 and got[c]["n"] == len(a) and got[c]["defaults"] == b.sum()
        assert all(abs(got[c][k] - direct[c][k]) < 1e-9 for k in ("obs_rate", "mean_pd", "oe", "brier", "logloss"))


def test_ranges_follow_the_scores(spark):
    values = [-1e9, -3.0, -0.1, 0.0, 1e-9, 1e-6, 0.001, 0.0011, 0.5, 0.999999, 1.0, 1.5, 80.0, 1e9]
    rows = spark.createDataFrame([(v,) for v in values], "p_ double").select("p_", M._range(F.col("p_")).alias("r")).orderBy("p_").collect()
    ranges = [r.r for r in rows]
    assert ranges == sorted(ranges) and ranges[6] < ranges[7]


def test_matched_rates_equal_plain_quantiles(spark):
    df, cell, p, y = scored(spark)
    got = {r["cell"]: r for r in matched_ar(df, df, ["cell"], "y", "p", Gates()).collect()}
    cut = np.quantile(p, Gates().reference_approval_rate)
    for c in "ab":
        a, b, r = p[cell == c], y[cell == c], got[c]
        rate = min((a <= cut).mean(), (p <= cut).mean())
        assert abs(r["ar_segment"] - (a <= cut).mean()) < 1e-12 and r["ar_gap_triggered"] == (abs((a <= cut).mean() - (p <= cut).mean()) >= 0.1)
        if r["ar_gap_triggered"]:
            own, theirs = np.quantile(a, rate), np.quantile(p, rate)
            assert abs(r["cutoff_segment"] - own) < 1e-9 and abs(r["cutoff_reference"] - theirs) < 1e-9
            assert abs(r["gini_segment_at_matched_ar"] - gini(a[a <= own], b[a <= own])) < 1e-9
            assert abs(r["gini_reference_at_matched_ar"] - gini(p[p <= theirs], y[p <= theirs])) < 1e-9
    assert any(r["ar_gap_triggered"] for r in got.values())


def test_encoder(spark):
    df, *_ = scored(spark)
    e = WoEEncoder(5).fit(df, "y", ["x", "cell"])
    assert e.columns_ == ["x", "cell"] and e.edges_["cell"] is None and 2 <= len(e.edges_["x"]) - 1 <= 5 and set(e.woe_) == {"x", "cell"}
    again = WoEEncoder.from_grouping(e.to_grouping())
    assert again.transform(df).agg(F.sum(F.hash("*"))).first() == e.transform(df).agg(F.sum(F.hash("*"))).first()
    try:
        WoEEncoder().transform(df)
    except ValueError:
        return
    raise AssertionError("an encoder that is not fitted transformed a frame")


def test_unseen_levels(spark):
    grouping = BinningModel({"c": BinSpec("c", "categorical", "fixed", groups={"A|B": ["A", "B"]}), "v": BinSpec("v", "numeric", "fixed", edges=[-INF, 0.0, INF])})
    seg = spark.createDataFrame([("s", "A", 1.0), ("s", "Z", 9.0), ("s", None, None), ("s", "B", 2.0)], "k string, c string, v double")
    ref = spark.createDataFrame([("A", 0.0), ("B", 5.0)], "c string, v double")
    got = {r.feature: r.out_of_range_share for r in out_of_range_share(seg, ref, ["c", "v"], ["k"], grouping).collect()}
    assert got["c"] == 0.25 and abs(got["v"] - 1 / 3) < 1e-12


def test_helpers(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 0.5)], "i int, d double")
    assert [tuple(r) for r in ordered_concat([a, None, b]).orderBy("frame_").collect()] == [(1, "x", 0, None), (2, None, 1, 0.5)] and ordered_concat([]) is None
    assert rng_for(4, 2).random() == rng_for(4, 2).random() != rng_for(4, 3).random() and spawn_seeds(1, 3)[:2] == spawn_seeds(1, 2)
    got = spark.createDataFrame([(1.0, 2.0)], "u double, w double").select(logistic_from_coefficients(["u", "w"], [0.5, -1], 0.25).predict_proba()).first()[0]
    assert abs(got - 1 / (1 + np.exp(1.25))) < 1e-12
