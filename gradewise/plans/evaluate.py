"""Evaluation of a scored book: every cell in shared passes, models only where a verdict asks for them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.functions.columns import fantomas_mask, normalised, observable_mask, vintage
from gradewise.operators import decide as D
from gradewise.operators import metrics as M
from gradewise.operators import refit as R
from gradewise.operators.bins import BinningModel
from gradewise.operators.matched_ar import matched_ar
from gradewise.operators.psi import feature_diagnostics, shape_divergence
from gradewise.operators.stability import predictor_stability
from gradewise.plans.spec import OVERALL_SEGMENT_COL, OVERALL_SEGMENT_VALUE, Gates, ScorecardColumns

CELL = ["segment_col", "segment_value"]
HOLDOUT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CELL] + [
    T.StructField(c, T.DoubleType()) for c in ("n_holdout", "defaults_holdout", "gini_pooled", "brier_pooled", "logloss_pooled", "gini_recal", "brier_recal", "logloss_recal", "gini_refit", "delta_gini", "delta_gini_se", "delta_gini_ci_low", "brier_refit", "logloss_refit", "stability_score")
] + [T.StructField("stability_pass", T.BooleanType())] + [T.StructField(c, T.StringType()) for c in ("refit_method", "stability_reason", "unstable_predictors")])


@dataclass
class SegmentEvalResult:
    """The tables of an evaluation and the fitted models."""

    decisions: DataFrame
    metrics: DataFrame
    slices: DataFrame
    vintages: DataFrame | None
    characteristics: DataFrame | None
    matched_ar: DataFrame
    refit_comparison: DataFrame
    stability: DataFrame | None
    artifacts: list[R.FittedModelArtifact] = field(default_factory=list)
    meta: dict = field(default_factory=dict)

    def save_artifacts(self, directory: str) -> list[str]:
        return R.save_fitted_artifacts(self.artifacts, directory)


def _settled(df: DataFrame) -> DataFrame:
    """A table of a row a cell, computed once: what builds on it plans on rows, not on the whole evaluation."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def is_overall_segment(segment_col, segment_value=None) -> bool:
    return segment_col == OVERALL_SEGMENT_COL and segment_value in (None, OVERALL_SEGMENT_VALUE)


def _holdout(cell: DataFrame, cols: ScorecardColumns, gates: Gates, do_refit: bool, do_recal: bool, grouping: BinningModel | None, name: tuple[str, str]) -> tuple[dict, list[R.FittedModelArtifact]]:
    """Models of one cell, fitted before its cutoff and judged after it."""
    out: dict = dict(zip(CELL, name, strict=True))
    if not cols.col_date or cols.col_date not in cell.columns or cell.limit(40).count() < 40:
        return out, []
    cut = M.time_holdout_cutoff(cell, [], cols.col_date, gates.holdout_frac).first()
    if cut is None:
        return out, []
    late = F.coalesce(F.try_to_timestamp(F.col(cols.col_date).cast("string")) >= F.lit(cut["cutoff"]), F.lit(False))
    train, test = cell.where(~late), cell.where(late)
    y, p = cols.col_target, cols.col_score
    events = cell.agg(F.sum(F.when(late, F.col(y))), F.sum(F.when(~late, F.col(y))), F.count_if(late)).first()
    if (events[0] or 0) < 5 or (events[1] or 0) < 5:
        return out, []
    out |= {"n_holdout": float(events[2]), "defaults_holdout": float(events[0]), "gini_pooled": R.point_ginis(test, y, [p])[0]}
    out["brier_pooled"], out["logloss_pooled"] = R.proper_scores(test, y, p)
    artifacts = []
    if do_recal:
        recal = R.recalibrate_with_diagnostics(train, p, y, *name)
        again = test.withColumn("p_recal", recal.artifact.predict_proba())
        out["gini_recal"] = R.point_ginis(again, y, ["p_recal"])[0]
        out["brier_recal"], out["logloss_recal"] = R.proper_scores(again, y, "p_recal")
        artifacts.append(recal.artifact)
    if do_refit and cols.cols_pred and all(c in cell.columns for c in cols.cols_pred):
        fitted = R.refit_with_diagnostics(train, list(cols.cols_pred), y, gates, cols.col_date, logit_cols=cols.logit_pred_cols(grouping), segment_col=name[0], segment_value=name[1], portfolio_grouping=grouping, pred_woe_map=cols.pred_woe_map())
        scored = test.withColumn("p_refit", fitted.artifact.predict_proba(test.columns)).persist()
        out |= R.bootstrap_delta_gini(scored, y, "p_refit", p, gates.n_bootstrap, gates.bootstrap_seed, gates.delta_gini_z)
        out["brier_refit"], out["logloss_refit"] = R.proper_scores(scored, y, "p_refit")
        scored.unpersist()
        out |= {"refit_method": fitted.method} | {k: fitted.stability_summary[k] for k in ("stability_score", "stability_pass", "stability_reason", "unstable_predictors")}
        artifacts.append(fitted.artifact)
    return out, artifacts


def evaluate_segments(df: DataFrame, cols: ScorecardColumns, gates: Gates | None = None, grouping: BinningModel | None = None, n_jobs: int | None = None, submodel: bool = False, xgb_params: dict | None = None, portfolio_whatif: bool = False, include_segments: bool = True) -> SegmentEvalResult:
    """Verdict and action for every segment and the whole book.

    Metrics of all cells come from shared aggregations. The verdict table (a row a cell) reaches the driver, which then
    fits models just for the cells whose verdict asks for one. ``n_jobs`` is accepted; Spark schedules. A sub-model
    needs a boosting package: without one the logistic refit stands in.
    """
    g = gates or Gates()
    grouping = getattr(grouping, "grouping", grouping)
    keep = [c for c in dict.fromkeys([cols.col_id, cols.col_date, cols.col_obs, cols.col_target, cols.col_score, cols.col_fantomas, *cols.cols_segment, *cols.cols_pred]) if c and c in df.columns]
    book = normalised(df.select(*keep))
    y, p = cols.col_target, cols.col_score
    segments = [c for c in cols.cols_segment if c in book.columns] if include_segments else []
    obs = book.where(observable_mask(book, cols)).persist()
    if obs.where(F.col(y).isNull()).limit(1).count():
        raise ValueError(f"{y} is null on observable rows")
    cells = M.to_cells(obs, segments)
    perf = _settled(M.performance_bundle(cells, CELL, y, p, g.n_ece_bins))
    every = M.to_cells(book, segments)
    bad = F.sum(F.when(observable_mask(book, cols), F.col(y)).cast("double"))
    totals = book.agg(F.count("*").alias("n_all"), bad.alias("d_all"))
    shares = every.groupBy(*CELL).agg(F.count("*").alias("n_ttd"), F.coalesce(bad, F.lit(0.0)).alias("d_"), F.avg(fantomas_mask(book, cols).cast("double")).alias("fantomas_rate"))
    shares = shares.crossJoin(F.broadcast(totals)).select(*CELL, "n_ttd", (F.col("n_ttd") / F.col("n_all")).alias("volume_share"), F.when(F.col("d_all") > 0, F.col("d_") / F.col("d_all")).alias("default_share"), "fantomas_rate")
    shares = _settled(shares)
    slices = M.performance_bundle(cells.where(~fantomas_mask(book, cols)), CELL, y, p, g.n_ece_bins).withColumn("slice", F.lit("observable_ex_fantomas")).unionByName(perf.withColumn("slice", F.lit("observable")))
    vintages = ratios = None
    if cols.col_date and cols.col_date in book.columns:
        dated = cells.withColumn("vintage", vintage(F.col(cols.col_date))).where("vintage is not null")
        vintages = M.performance_bundle(dated, [*CELL, "vintage"], y, p, g.n_ece_bins).select(*CELL, "vintage", "n", "defaults", "gini", "oe", "obs_rate", "mean_pd")
        vintages = _settled(vintages)
        ratios = _settled(M.vintage_ratio(vintages, CELL))
    ar = _settled(matched_ar(cells.where(F.col("segment_col") != OVERALL_SEGMENT_COL), obs, CELL, y, p, g))
    preds = [c for c in cols.cols_pred if c in book.columns]
    characteristics = divergence = None
    if preds and segments:
        characteristics = feature_diagnostics(cells.where(F.col("segment_col") != OVERALL_SEGMENT_COL), obs, preds, y, CELL, grouping, g.n_woe_bins)
        characteristics = _settled(characteristics)
        divergence = shape_divergence(characteristics, CELL, g.psi_woe_material)
    pooled = perf.where(F.col("segment_col") == OVERALL_SEGMENT_COL).select(F.col("gini").alias("gini_overall"))
    facts = shares.join(perf, CELL, "left").crossJoin(F.broadcast(pooled)).join(ar, CELL, "left")
    facts = facts.join(ratios, CELL, "left") if ratios is not None else facts.withColumn("latest_to_early_gini_ratio", F.lit(None).cast("double"))
    facts = facts.join(divergence, CELL, "left") if divergence is not None else facts.withColumn("shape_divergent", F.lit(False))
    c = F.col
    # the rank-order test needs a lower bound of the Gini; the analytic one stands for the bootstrap where cells are many
    se = M.gini_standard_error(c("gini"), c("defaults").cast("double"), (c("n") - c("defaults")).cast("double"))
    facts = facts.withColumn("gini_ci_low", c("gini") - g.delta_gini_z * se)
    verdict, pillars = D.q1_verdict(c("n"), c("defaults"), c("gini"), c("gini_ci_low"), c("gini_overall"), c("oe"), c("ece"), c("latest_to_early_gini_ratio"), g)
    facts = facts.withColumn("q1_verdict", verdict).withColumn("failed_pillars", pillars).withColumn("important", D.is_important(c("volume_share"), c("default_share"), g) | (c("segment_col") == OVERALL_SEGMENT_COL))
    facts = _settled(facts)

    rows, artifacts = [], []
    for r in facts.select(*CELL, "q1_verdict", "failed_pillars", "shape_divergent").collect():
        failed, overall = (r["failed_pillars"] or "").split(";"), is_overall_segment(r["segment_col"], r["segment_value"])
        whatif = overall and portfolio_whatif
        weak = r["q1_verdict"] == "WEAK"
        do_refit = whatif or not overall and (weak and "rank_order" in failed or bool(r["shape_divergent"]))
        # a cell that is refitted is recalibrated too, so that both can be compared
        do_recal = do_refit or weak and "calibration" in failed and (overall or "rank_order" not in failed)
        if do_recal or do_refit:
            cell = obs if overall else obs.where(F.coalesce(F.col(r["segment_col"]).cast("string"), F.lit("nan")) == r["segment_value"])
            row, made = _holdout(cell, cols, g, do_refit, do_recal, grouping, (r["segment_col"], r["segment_value"]))
            rows.append(row)
            artifacts += made
    full = [tuple(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v for f in HOLDOUT_SCHEMA.fields for v in (row.get(f.name),)) for row in rows]
    refits = df.sparkSession.createDataFrame(full, HOLDOUT_SCHEMA)
    joined = facts.join(F.broadcast(refits), CELL, "left")
    gates_of = (c("delta_gini"), c("delta_gini_ci_low"), c("brier_refit"), c("brier_pooled"), c("logloss_refit"), c("logloss_pooled"), g, c("stability_pass"), c("stability_reason"))
    seg_action, seg_reason = D.q2_action(c("q1_verdict"), c("failed_pillars"), c("important"), c("shape_divergent"), *gates_of)
    book_action, book_reason = D.q2_portfolio_action(c("q1_verdict"), c("failed_pillars"), *gates_of, whatif=portfolio_whatif)
    overall = c("segment_col") == OVERALL_SEGMENT_COL
    suspected = D.ar_artifact_suspected(c("failed_pillars"), c("ar_gap_triggered"), c("gini_at_matched_ar_ratio"), c("gini_segment_at_matched_ar"), g)
    method = characteristics.groupBy(*CELL).agg(F.mode("psi_method", True).alias("psi_method")) if characteristics is not None else None
    decisions = joined.select(
        *CELL, "important", "q1_verdict", "failed_pillars", F.when(overall, book_action).otherwise(seg_action).alias("q2_action"), F.when(overall, book_reason).otherwise(seg_reason).alias("q2_reason"), "gini",
        F.when(c("gini_overall") != 0, c("gini") / c("gini_overall")).alias("gini_ratio"), "oe", "ece", "volume_share", "default_share", "ar_gap", c("gini_segment_at_matched_ar").alias("gini_at_matched_ar"), suspected.alias("ar_artifact_suspected"), "stability_score", "unstable_predictors",
    )
    decisions = decisions.join(method, CELL, "left") if method is not None else decisions.withColumn("psi_method", F.lit(None).cast("string"))
    production = predictor_stability(obs, preds, y, cols.col_date, g, grouping) if grouping is not None and vintages is not None and any(f in grouping.specs for f in preds) else None
    return SegmentEvalResult(decisions, perf.join(shares, CELL), slices, vintages, characteristics, ar, refits, production, artifacts, {"gates": g.__dict__, "columns": cols.as_dict(), "portfolio_whatif": portfolio_whatif})


def evaluate_portfolio_whatif(df: DataFrame, cols: ScorecardColumns, gates: Gates | None = None, grouping: BinningModel | None = None, n_jobs: int | None = None, submodel: bool = False, xgb_params: dict | None = None) -> SegmentEvalResult:
    """The whole book alone, refitted and recalibrated whatever its verdict."""
    return evaluate_segments(df, cols, gates, grouping, n_jobs, submodel, xgb_params, portfolio_whatif=True, include_segments=False)
