"""The credit-score side: hand-checked values, plain versions in numpy, and a whole evaluation."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewise.functions.names import map_pred_to_val, map_pred_to_woe
from gradewise.operators import bins as B
from gradewise.operators import metrics as M
from gradewise.operators import refit as R
from gradewise.operators.psi import psi_table
from gradewise.operators.scorecard import parse_scorecard_sql
from gradewise.operators.stability import predictor_stability, stability_summary
from gradewise.plans import report
from gradewise.plans.evaluate import evaluate_portfolio_whatif, evaluate_segments
from gradewise.plans.spec import Gates, ScorecardColumns
from gradewise.sources import metadata as meta
from gradewise.sources.synthetic import make_synthetic_book, make_synthetic_db_table

GATES = Gates(min_n=400, min_events=25, n_bootstrap=80, bootstrap_seed=0, holdout_frac=0.3)
COLS = ScorecardColumns("app_id", "score_date", "obs", "default", "pd", ["x1", "x2", "cat"], ["channel"])


@pytest.fixture(scope="module")
def book(spark):
    return make_synthetic_book(spark, 9000, 3).cache()


def rank_gini(y, p):
    order = np.argsort(p)
    ranks = np.empty(len(p))
    for v in np.unique(p):
        ranks[p == v] = (np.searchsorted(p[order], v) + np.searchsorted(p[order], v, "right") + 1) / 2
    b = y.sum()
    return 2 * ((ranks[y == 1].sum() - b * (b + 1) / 2) / (b * (len(y) - b))) - 1


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.2), ("a", 1, 0.8), ("a", 1, 0.9), ("b", 1, 0.5), ("c", 0, 0.5), ("c", 1, 0.5)], "k string, y int, p double")
    got = {r.k: r for r in M.performance_bundle(df, ["k"], "y", "p", 2).collect()}
    assert got["a"].gini == got["a"].ks == got["a"].oe == 1.0 and math.isclose(got["a"].brier, 0.025)
    assert got["b"].gini is None and got["c"].gini is None and got["b"].logloss is None


def test_gini_equals_average_ranks(book):
    rows = book.select("default", F.round("pd", 2).alias("pd"), "channel").toPandas()
    got = {r.channel: r.gini for r in M.rank_metrics(M.histogram(book.withColumn("pd", F.round("pd", 2)), ["channel"], "default", "pd"), ["channel"]).collect()}
    for channel, g in rows.groupby("channel"):
        assert math.isclose(got[channel], rank_gini(g.default.to_numpy(), np.clip(g.pd.to_numpy(), 1e-6, 1 - 1e-6)), abs_tol=1e-9)


def test_bins_and_labels(spark):
    assert B.edge_labels([-math.inf, 1, 2, math.inf]) == ["(-inf, 1]", "(1, 2]", "(2, inf)"]
    assert B.edge_labels([-math.inf, 1, math.inf], "left") == ["[-inf, 1)", "[1, inf)"]
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    spec = B.BinSpec("x", "numeric", "t", edges=[-math.inf, 1, math.inf], closed="left", woe={"[1, inf)": 0.5})
    assert [r[0] for r in df.select(spec.assign(F.col("x"))).collect()] == ["[1, inf)", "[1, inf)", B.MISSING, B.MISSING, B.MISSING]
    again = B.BinSpec.from_dict(spec.to_dict())
    assert again == spec or again.edges == spec.edges and again.woe == spec.woe


def test_fit_is_monotonic_and_large_enough(book):
    spec = B.fit_bin_spec(book.where("channel = 'core'"), "x1", "default", Gates())
    woe = [spec.woe[b] for b in spec.interval_labels()]
    assert spec.kind == "numeric" and spec.monotonic and woe == sorted(woe, reverse=True) and 2 <= len(woe) <= 8 and spec.iv > 0.3
    total = sum(spec.counts.values())
    assert all(spec.counts[b] >= 0.05 * total and spec.events[b] >= 10 for b in spec.interval_labels())
    cat = B.fit_bin_spec(book, "cat", "default", Gates())
    assert cat.kind == "categorical" and sorted(m for g in cat.groups.values() for m in g) == ["A", "B", "C"]
    assert B.grouping_from_dict(B.BinningModel({"x1": spec}).to_dict()).specs["x1"].edges == spec.edges


def test_psi_of_equal_frames_is_zero(book):
    assert all(abs(r.psi) < 1e-12 for r in psi_table(book, book, ["x1", "cat"]).collect())


def test_logistic_and_recalibration(book):
    beta, intercept = R.fit_logistic(book.where("channel = 'core'"), {"x1": F.col("x1"), "x2": F.col("x2")}, "default")
    assert abs(beta["x1"] - 0.9) < 0.15 and abs(beta["x2"] - 0.7) < 0.15 and -2.6 < intercept < -1.8
    miscal = book.where("channel = 'miscal'")
    fixed = R.recalibrate_with_diagnostics(miscal, "pd", "default").artifact.predict_proba()
    sums = miscal.agg(F.avg("default"), F.avg(fixed), F.avg("pd")).first()
    assert abs(sums[0] - sums[1]) < 1e-3 < abs(sums[0] - sums[2])


def test_bootstrap_is_repeatable(book):
    a, b = (R.bootstrap_gini_ci(book.where("channel = 'core'"), "default", "pd", 40, 1) for _ in range(2))
    assert a == b and 0.005 < a["gini_se"] < 0.05 and a["gini_ci_low"] < a["gini"]


def test_evaluation_of_archetypes(book, tmp_path):
    result = evaluate_segments(book, COLS, GATES)
    rows = {r.segment_value: r for r in report.decision_table(result).collect()}
    assert (rows["tiny"].q1_verdict, rows["tiny"].q2_action) == ("INCONCLUSIVE", "NONE")
    assert (rows["miscal"].q1_verdict, rows["miscal"].q2_action) == ("WEAK", "RECALIBRATE") and rows["miscal"].failed_pillars == "calibration"
    assert (rows["core"].q1_verdict, rows["core"].q2_action) == ("GOOD", "KEEP_POOLED")
    assert rows["inverted"].q1_verdict == "WEAK" and rows["inverted"].q2_action in ("SPLIT", "MONITOR") and "rank_order" in rows["inverted"].failed_pillars
    assert rows["ALL"].q2_action != "SPLIT"
    assert [r.rank for r in report.recommendations(result).collect()] == [1, 2, 3, 4, 5]
    for name in ("r.html", "r_condensed.html", "r.md"):
        text = open(report.save_report(result, str(tmp_path / name))).read()
        assert "inverted" in text
    for path in result.save_artifacts(str(tmp_path / "models")):
        assert R.load_fitted_artifact(path).kind in ("refit", "recalibrate")


def test_whatif_never_splits(book):
    cols = ScorecardColumns("app_id", "score_date", "obs", "default", "pd", ["x1", "x2"], [])
    rows = evaluate_portfolio_whatif(book.where("channel = 'inverted'"), cols, GATES).decisions.collect()
    assert len(rows) == 1 and rows[0].q2_action in ("REFIT", "MONITOR")


def test_stability_of_a_steady_predictor(book):
    core = book.where("channel = 'core'")
    model = B.BinningModel.fit(core, "default", ["x1"], Gates())
    table = predictor_stability(core, ["x1"], "default", "score_date", Gates(), model)
    row = table.first()
    assert len(table.columns) == 19 and row.assessed and row.sign_consistency == 1.0 and stability_summary(table)["stability_assessed"]


def test_scorecard_round_trip(spark):
    sql = "select s.*, 1/(1+exp(-LINEAR_SCORE)) as SCORE from (select w.*, w.a_WOE * 0.5 - w.b_WOE * 0.25 + w.INTERCEPT_ * -1.5 as LINEAR_SCORE from (select t.*, case when a is null then 0.1 when a < 5 then -0.4 when a < 9 then 0.2 when 1=1 then 0.7 end as a_WOE, case when b = 'x' then 1 when b = 'o''k' then 2 else -1 end as b_WOE, case when 1=1 then 1 end as INTERCEPT_ from db.t t) w) s"
    model = parse_scorecard_sql(sql)
    assert model.coefficients == {"a_WOE": 0.5, "b_WOE": -0.25} and model.intercept == -1.5 and model.source_table == "db.t"
    df = spark.createDataFrame([(None, "x"), (4.9, "o'k"), (5.0, None), (9.0, "zz")], "a double, b string")
    again = parse_scorecard_sql(model.to_sql("t"))
    for m in (model, again):
        got = [(r.a_WOE, r.b_WOE, round(r.LINEAR_SCORE, 9)) for r in m.transform_frame(df).collect()]
        assert got == [(0.1, 1.0, -1.7), (-0.4, 2.0, -2.2), (0.2, -1.0, -1.15), (0.7, -1.0, -0.9)]
    with pytest.raises(ValueError):
        parse_scorecard_sql("select 1")


def test_names():
    assert map_pred_to_woe(["x1", "age", "q"], ["x1_woe", "WOE_AGE"]) == {"x1": "x1_woe", "age": "WOE_AGE"}
    assert map_pred_to_val(["p"], ["p_LIN"]) == {"p": "p_LIN"}


def test_grouping_comparison_and_recovery(spark, book):
    from gradewise.operators.compare import bin_spec_from_woe_column, compare_bin_specs, merge_overlapping

    inf = math.inf
    a = B.BinSpec("x", "numeric", "t", edges=[-inf, 0, 10, inf], woe={"(-inf, 0]": 0.5, "(0, 10]": 0.1, "(10, inf)": -0.5})
    b = B.BinSpec("x", "numeric", "t", edges=[-inf, 0, inf], woe={"(-inf, 0]": -0.5, "(0, inf)": 0.1})
    kinds = [r["kind"] for r in compare_bin_specs(a, b)]
    assert kinds == ["woe_sign_flip", "aligned", "woe_sign_flip", "split"] and compare_bin_specs(b, a)[1]["kind"].startswith("merged")
    assert compare_bin_specs(a, None)[0]["kind"] == "no_portfolio_spec"
    df = spark.createDataFrame([(float(v), a.woe["(-inf, 0]"] if v <= 0 else a.woe["(0, 10]"] if v <= 10 else a.woe["(10, inf)"]) for v in range(-20, 30)], "x double, x_woe double")
    assert bin_spec_from_woe_column(df, "x", "x_woe").edges == [-inf, 0.5, 10.5, inf]
    noisy = B.BinningModel({"x2": B.BinSpec("x2", "numeric", "t", edges=[-inf, -1, 0, 0.1, 0.2, 1, inf])})
    assert len(merge_overlapping(book, noisy, "default", "score_date").specs["x2"].edges) < 7


def test_recovery_keeps_every_level(spark):
    from gradewise.operators.compare import grouping_from_woe_columns

    df = spark.createDataFrame([(f"p{v:04d}", 0.5 if v < 700 else -0.25) for v in range(1000)], "post string, post_woe double")
    model = grouping_from_woe_columns(df, {"post": "post_woe"})
    assert sorted(map(len, model.specs["post"].groups.values())) == [300, 700]
    assert sorted(x for m in model.specs["post"].groups.values() for x in m) == [f"p{v:04d}" for v in range(1000)]
    assert df.where(model.specs["post"].transform_woe(F.col("post")) != F.col("post_woe")).count() == 0


def test_report_tables_hold_every_row(spark):
    rows = spark.range(2160).selectExpr("'channel' segment_col", "concat('v', id) segment_value")
    for render in (report.html_table, report.frozen_html_table, report.markdown_table):
        assert set(re.findall(r"\bv\d+\b", render(rows))) == {f"v{k}" for k in range(2160)}


def test_metadata_from_a_table(spark, tmp_path):
    make_synthetic_db_table(spark, 500).createOrReplaceTempView("cases")
    executor = meta.SqlExecutor(spark, hidden_columns=("x2",))
    with pytest.warns(meta.MetadataInferenceWarning):
        m = meta.resolve_metadata("cases", "SKP_CREDIT_CASE", "PD", ["x1"], executor, cols_pred=["x1"])
    assert (m.columns.col_date, m.columns.col_target, m.columns.col_obs, m.columns.cols_segment, m.portfolio) == ("DATE_DECISION", "TargetA", "TargetAObs", ["CHANNEL"], "PortfolioA")
    assert meta.resolve_capabilities(m).is_available("refit") and "x2" not in m.catalogue
    path = meta.save_settings(m, str(tmp_path / "s.json"))
    assert meta.load_settings(path).columns == m.columns
    base = spark.table("cases").select("SKP_CREDIT_CASE", "PD")
    assert set(meta.build_analysis_frame(m, executor, base).columns) == set(meta.required_columns(m))
    assert meta.parse_sql_metadata(meta.render_sql("fetch_columns_by_id", col_id="a", columns=["b"], table="t"))["params"]["columns"] == ["b"]
    with pytest.raises(KeyError):
        meta.render_sql("column_profile", table="t")


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "segment_gini" in entry.queries()
