"""Stability of predictors over vintages, all predictors and vintages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.functions.columns import vintage
from gradewise.operators.bins import BinningModel, bin_cube, event_rate_bounds, information_value, overlapping_pairs, vintage_cube, woe_table
from gradewise.operators.metrics import gini_standard_error, histogram, rank_metrics
from gradewise.operators.psi import count_cube, psi_bins, psi_from_counts
from gradewise.plans.spec import Gates


def _slope_sign(score: str, y: str):
    flat = (F.stddev_pop(score) == 0) | (F.stddev_pop(y) == 0) | (F.count("*") < 5)
    return F.when(flat, 0.0).otherwise(F.signum(F.covar_samp(score, y)))


def predictor_stability(df: DataFrame, pred_cols: list[str], target_col: str, date_col: str, gates: Gates | None = None, grouping: BinningModel | None = None, freq: str = "M", min_rows_per_vintage: int = 30) -> DataFrame:
    """A row a predictor with 19 columns: drift, power and sign over vintages against the whole frame.

    Scores are minus the weight of evidence (clipped like a probability, as the Gini clips), or the logit for logit
    predictors (not clipped). Predictors without a spec are left out; too few vintages, or no signal on the whole frame,
    give a row that is not assessed and counts as stable.
    """
    g = gates or Gates()
    specs = {f: grouping.specs[f] for f in pred_cols if grouping and f in grouping.specs and f in df.columns}
    model = BinningModel(specs)
    logit = [f for f, s in specs.items() if s.kind == "logit"]
    dated = df.withColumn("vintage", vintage(F.col(date_col), freq)).withColumn("y_", F.col(target_col).cast("double"))
    kept = dated.groupBy("vintage").agg(F.count("*").alias("rows_")).where((F.col("rows_") >= min_rows_per_vintage) & F.col("vintage").isNotNull())
    pairs = [F.struct(F.lit(f).alias("feature"), F.coalesce(s.transform_woe(F.col(f)) * (1 if f in logit else -1), F.lit(0.0)).alias("score")) for f, s in specs.items()]
    long = dated.select("vintage", "y_", F.explode(F.array(*pairs)).alias("x_")).select("vintage", "y_", "x_.feature", "x_.score")

    def ginis(rows: DataFrame, keys: list[str]) -> DataFrame:
        is_logit = F.col("feature").isin(logit) if logit else F.lit(False)
        both = [rank_metrics(histogram(rows.where(test), keys, "y_", "score", clip=clip), keys).select(*keys, "gini") for test, clip in ((is_logit, False), (~is_logit, True))]
        return both[0].union(both[1]) if logit else both[1]

    reference = ginis(long, ["feature"]).withColumnRenamed("gini", "gini_reference").join(long.groupBy("feature").agg(_slope_sign("score", "y_").alias("sign_reference")), "feature", "right")
    by_vintage = long.join(F.broadcast(kept.select("vintage")), "vintage")
    counts = by_vintage.groupBy("feature", "vintage").agg(F.sum("y_").alias("bads"), (F.count("*") - F.sum("y_")).alias("goods"), _slope_sign("score", "y_").alias("sign"))
    bins = psi_bins(df, list(specs), model)
    dated_kept = dated.join(F.broadcast(kept.select("vintage")), "vintage")
    psi = psi_from_counts(count_cube(dated_kept, bins, ["vintage"]), count_cube(dated, bins, []), ["vintage"]).select("feature", "vintage", "psi")
    iv = information_value(woe_table(bin_cube(dated_kept, specs, target_col, ["vintage"]), ["vintage"]), ["vintage"])
    v = counts.join(ginis(by_vintage, ["feature", "vintage"]), ["feature", "vintage"], "left").join(psi, ["feature", "vintage"], "left").join(iv, ["feature", "vintage"], "left").join(reference, "feature")
    weak = F.coalesce(F.abs("gini") + g.delta_gini_z * F.coalesce(gini_standard_error(F.col("gini"), F.col("bads"), F.col("goods")), F.lit(0.0)) < g.stability_gini_ratio_min * F.abs("gini_reference"), F.lit(False))
    known = F.col("sign_reference") != 0
    t = v.groupBy("feature").agg(
        F.count("*").cast("int").alias("n_vintages"), F.max("psi").alias("psi_max"), F.avg("psi").alias("psi_mean"), F.min(F.abs("gini")).alias("gini_min"), F.median("gini").alias("gini_median"),
        F.avg(weak.cast("double")).alias("weak_vintage_share"), F.min("iv").alias("iv_min"), F.when((F.count("iv") >= 2) & (F.avg("iv") > 1e-12), F.stddev_samp("iv") / F.avg("iv")).alias("iv_cv"),
        F.avg(F.when(known, (F.col("sign") == F.col("sign_reference")).cast("double"))).alias("sign_consistency"),
    )
    facts = df.sparkSession.createDataFrame([(f, None if s.iv != s.iv else float(s.iv), bins[f][0]) for f, s in specs.items()], "feature string, iv_reference double, stability_binning string")
    overlaps = overlapping_pairs(event_rate_bounds(vintage_cube(df, specs, target_col, date_col, freq, min_rows_per_vintage), g.delta_gini_z), specs).groupBy("feature").agg(F.count("*").alias("overlaps"))
    t = reference.join(F.broadcast(facts), "feature").join(t, "feature", "left").join(overlaps, "feature", "left")
    few = F.coalesce("n_vintages", F.lit(0)) < max(g.stability_min_vintages, 2)
    silent = F.coalesce(F.abs("gini_reference") < g.stability_min_reference_gini, F.lit(True))
    assessed = ~few & ~silent
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    parts = F.array_compact(F.array(clip(1 - F.col("psi_max") / g.stability_psi_max), clip(1 - F.col("weak_vintage_share") / g.stability_max_weak_vintage_share), F.col("sign_consistency")))
    score = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))
    ratio_median = F.abs(F.abs("gini_median") / F.abs("gini_reference"))
    flags = F.array_join(F.array_compact(F.array(
        F.when(F.col("psi_max") > g.stability_psi_max, F.lit("distribution_drift")), F.when(F.col("weak_vintage_share") > g.stability_max_weak_vintage_share, F.lit("power_loss_in_vintage")),
        F.when(ratio_median < g.stability_gini_ratio_min, F.lit("power_loss_median")), F.when(F.col("sign_consistency") < g.stability_sign_consistency_min, F.lit("sign_flip")),
        F.when(score < g.stability_score_min, F.lit("low_stability_score")), F.when(F.coalesce("overlaps", F.lit(0)) > 0, F.lit("overlapping_event_rate_bounds")),
    )), ",")
    only = lambda c: F.when(assessed, c)
    return t.select(
        "feature", F.coalesce("n_vintages", F.lit(0)).alias("n_vintages"), assessed.alias("assessed"), only(F.col("psi_max")).alias("psi_max"), only(F.col("psi_mean")).alias("psi_mean"), "gini_reference",
        only(F.col("gini_min")).alias("gini_min"), only(F.col("gini_median")).alias("gini_median"), only(F.col("gini_min") / F.abs("gini_reference")).alias("gini_ratio_min"), only(ratio_median).alias("gini_ratio_median"),
        only(F.col("weak_vintage_share")).alias("weak_vintage_share"), "iv_reference", only(F.col("iv_min")).alias("iv_min"), only(F.col("iv_cv")).alias("iv_cv"), only(F.col("sign_consistency")).alias("sign_consistency"),
        only(score).alias("stability_score"), F.when(assessed, flags == "").otherwise(True).alias("stable"),
        F.when(few, "insufficient_vintages").when(silent, "no_reference_signal").otherwise(flags).alias("stability_flags"), "stability_binning",
    )


def stability_summary(table: DataFrame | None, gates: Gates | None = None) -> dict:
    """One verdict over all assessed predictors; what could not be assessed never blocks."""
    g = gates or Gates()
    out = {"stability_assessed": False, "stability_score": None, "stability_pass": True, "stability_n_predictors": 0, "stability_n_unstable": 0, "unstable_predictors": "", "stability_reason": "not_assessed"}
    rows = table.select("feature", "assessed", "stable", "stability_score", "stability_flags").orderBy("feature").collect() if table is not None else []
    if not rows:
        return out
    judged = [r for r in rows if r["assessed"]]
    out["stability_n_predictors"] = len(rows)
    if not judged:
        return out | {"stability_reason": "insufficient_vintages"}
    scores = [r["stability_score"] for r in judged if r["stability_score"] is not None]
    bad, weakest = [r for r in judged if not r["stable"]], min(scores) if scores else None
    passed = not bad and (weakest is None or weakest >= g.stability_score_min)
    flags = sorted({f for r in bad for f in (r["stability_flags"] or "").split(",") if f})
    reason = "stable" if passed else ";".join(flags) or "unstable" if bad else "low_stability_score"
    return out | {"stability_assessed": True, "stability_score": weakest, "stability_pass": passed, "stability_n_unstable": len(bad), "unstable_predictors": ",".join(r["feature"] for r in bad), "stability_reason": reason}
