"""Refits, recalibration and bootstrap intervals.

The logistic model is fitted by Newton steps whose gradient and Hessian are aggregates, so rows never leave the
executors; the driver solves a system of as many unknowns as predictors. The bootstrap draws rows by position from the
score histogram of the holdout, replicate by replicate on executors, each from a seed of its own.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.functions.columns import clipped, sigmoid
from gradewise.operators.bins import BinningModel
from gradewise.operators.compare import compare_groupings, merge_overlapping
from gradewise.operators.metrics import histogram, moments, rank_metrics
from gradewise.operators.scorecard import render_scorecard_sql
from gradewise.operators.stability import predictor_stability, stability_summary
from gradewise.plans.spec import Gates

PENALTY = 1e-6  # of squared coefficients, against the summed loss: an inverse strength of a million
#: Rows of a holdout's distinct (score, score, outcome) that a bootstrap takes; beyond them scores are rounded to a grid.
MOST_SCORES = 200_000


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gauss elimination with pivots; threaded LAPACK may stall beside a JVM, and the system is small."""
    m = np.hstack((a, b[:, None]))
    for k in range(len(b)):
        p = k + int(np.abs(m[k:, k]).argmax())
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        for i in range(len(b)):
            if i != k:
                m[i] -= m[i, k] * m[k]
    return m[:, -1]


def fit_logistic(df: DataFrame, features: dict[str, Column], y: str, rounds: int = 30) -> tuple[dict[str, float], float]:
    """Coefficients and intercept of the penalised logistic model; the intercept is not penalised."""
    names = list(features)
    k = len(names) + 1
    x = df.select(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"x{i + 1}") for i, c in enumerate(features.values())], F.lit(1.0).alias("x0"), F.col(y).cast("double").alias("y_")).persist()
    beta = np.zeros(k)
    try:
        for _ in range(rounds):
            z = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
            p = sigmoid(z)
            w = p * (1 - p)
            sums = [F.sum((F.col("y_") - p) * F.col(f"x{i}")) for i in range(k)] + [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)]
            got = [v or 0.0 for v in x.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
            gradient, hessian, at = np.array(got[:k]), np.zeros((k, k)), k
            for i in range(k):
                for j in range(i, k):
                    hessian[i, j] = hessian[j, i] = got[at]
                    at += 1
            ridge = np.full(k, PENALTY)
            ridge[0] = 1e-12
            step = _solve(hessian + np.diag(ridge + 1e-12), gradient - ridge * beta)
            step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
    finally:
        x.unpersist()
    return dict(zip(names, beta[1:].tolist(), strict=True)), float(beta[0])


@dataclass
class FittedModelArtifact:
    """A fitted model that scores as a column and saves as a folder of text files."""

    kind: str  # refit or recalibrate
    method: str
    coefficients: dict[str, float]
    intercept: float
    grouping: BinningModel | None = None
    score_col: str | None = None
    segment_col: str | None = None
    segment_value: str | None = None
    grouping_comparison: list[dict] = field(default_factory=list)

    def predict_proba(self, columns: list[str] | None = None, score: Column | None = None) -> Column:
        if self.kind == "recalibrate":
            p = clipped(score if score is not None else F.col(self.score_col))
            return p if not self.coefficients else sigmoid(F.lit(self.intercept) + F.lit(self.coefficients["logit"]) * F.ln(p / (1 - p)))
        z = F.lit(self.intercept)
        for f, b in self.coefficients.items():
            value = F.col(f) if columns is None or f in columns else F.lit(None).cast("string")
            z = z + F.coalesce(self.grouping.specs[f].transform_woe(value), F.lit(0.0)) * F.lit(b)
        return sigmoid(z)

    def to_meta(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("grouping", "grouping_comparison")}

    def to_scorecard_sql(self, table: str = "_SOURCETABLENAME_", score_alias: str = "SCORE") -> str:
        return render_scorecard_sql(self.grouping, self.coefficients, table, score_alias, intercept=self.intercept)

    def save(self, directory: str) -> str:
        os.makedirs(directory, exist_ok=True)
        files = {"meta.json": json.dumps(self.to_meta(), indent=2), "grouping_comparison.json": json.dumps(self.grouping_comparison)}
        if self.grouping is not None:
            files["grouping.json"] = json.dumps(self.grouping.to_dict(), indent=2)
            if self.kind == "refit":
                files["scorecard.sql"] = self.to_scorecard_sql()
        for name, text in files.items():
            with open(os.path.join(directory, name), "w", encoding="utf-8") as f:
                f.write(text)
        return directory

    @classmethod
    def load(cls, directory: str) -> FittedModelArtifact:
        read = lambda name: json.load(open(os.path.join(directory, name), encoding="utf-8"))
        grouping = BinningModel.from_dict(read("grouping.json")) if os.path.exists(os.path.join(directory, "grouping.json")) else None
        return cls(**read("meta.json"), grouping=grouping, grouping_comparison=read("grouping_comparison.json"))


def save_fitted_artifact(artifact: FittedModelArtifact, directory: str) -> str:
    return artifact.save(directory)


def load_fitted_artifact(directory: str) -> FittedModelArtifact:
    return FittedModelArtifact.load(directory)


def save_fitted_artifacts(artifacts: list[FittedModelArtifact], directory: str) -> list[str]:
    safe = lambda x: re.sub(r"[^A-Za-z0-9._-]+", "_", str(x))[:80] or "_"
    return [a.save(os.path.join(directory, safe(a.segment_col), safe(a.segment_value), safe(a.kind))) for a in artifacts]


@dataclass
class RecalibrateResult:
    intercept: float
    slope: float
    artifact: FittedModelArtifact


def recalibrate_with_diagnostics(train: DataFrame, score_col: str, target_col: str, segment_col=None, segment_value=None) -> RecalibrateResult:
    """logit(p*) = a + b logit(p); with one class in training scores pass through, clipped."""
    p = clipped(F.col(score_col))
    classes = train.agg(F.min(F.col(target_col).cast("double")), F.max(F.col(target_col).cast("double"))).first()
    if classes[0] is None or classes[0] == classes[1]:
        beta, intercept = {}, 0.0
    else:
        beta, intercept = fit_logistic(train, {"logit": F.ln(p / (1 - p))}, target_col)
    artifact = FittedModelArtifact("recalibrate", "logit_recalibration", beta, intercept, None, score_col, segment_col, segment_value)
    return RecalibrateResult(intercept, beta.get("logit", 1.0), artifact)


@dataclass
class RefitResult:
    method: str
    artifact: FittedModelArtifact
    grouping: BinningModel
    stability: DataFrame | None
    stability_summary: dict

    def stability_pass(self) -> bool:
        return bool(self.stability_summary.get("stability_pass", True))

    def stability_score(self):
        return self.stability_summary.get("stability_score")


def refit_with_diagnostics(train: DataFrame, pred_cols: list[str], target_col: str, gates: Gates | None = None, date_col: str | None = None, grouping: BinningModel | None = None, logit_cols: list[str] | None = None, segment_col=None, segment_value=None, portfolio_grouping: BinningModel | None = None, pred_woe_map: dict[str, str] | None = None) -> RefitResult:
    """New bins on ``train`` (logit predictors keep their form), a logistic model on their weights, and stability."""
    g = gates or Gates()
    logit_cols = [c for c in (logit_cols or []) if c in pred_cols]
    if grouping is None:
        from gradewise.operators.bins import BinSpec

        fitted = BinningModel.fit(train, target_col, [c for c in pred_cols if c not in logit_cols], g)
        fitted.specs |= {c: BinSpec(c, "logit", "logit", transform="logit", impute=0.0) for c in logit_cols}
        grouping = BinningModel({c: fitted.specs[c] for c in pred_cols}, g)
        if date_col and g.stability_merge_overlapping_rates:
            grouping = merge_overlapping(train, grouping, target_col, date_col, z=g.delta_gini_z)
    beta, intercept = fit_logistic(train, {c: s.transform_woe(F.col(c)) for c, s in grouping.specs.items()}, target_col)
    kinds = {s.kind == "logit" for s in grouping.specs.values()}
    method = "logistic_mixed" if len(kinds) == 2 else "logistic_logit" if True in kinds else "logistic_woe"
    table = predictor_stability(train, pred_cols, target_col, date_col, g, grouping) if date_col else None
    artifact = FittedModelArtifact("refit", method, beta, intercept, grouping, None, segment_col, segment_value, compare_groupings(grouping, portfolio_grouping, pred_woe_map, g))
    return RefitResult(method, artifact, grouping, table, stability_summary(table, g))


def spawn_seeds(base_seed: int, n: int) -> list[int]:
    """Seeds of replicates; each depends on its place alone."""
    return [int(s.generate_state(1)[0]) for s in np.random.SeedSequence(base_seed).spawn(n)]


def seed_sequence_for(base_seed: int, index: int) -> np.random.SeedSequence:
    """The seeds of one numbered piece of work."""
    return np.random.SeedSequence([int(base_seed), int(index)])


def rng_for(base_seed: int, index: int) -> np.random.Generator:
    return np.random.default_rng(seed_sequence_for(base_seed, index))


@dataclass(frozen=True)
class LogisticModel:
    """A logistic model that is given by its numbers; scores as a column."""

    coefficients: dict[str, float]
    intercept: float

    def predict_proba(self) -> Column:
        return sigmoid(sum((F.col(f).cast("double") * F.lit(b) for f, b in self.coefficients.items()), F.lit(self.intercept)))


def logistic_from_coefficients(feature_names: list[str], coefficients: list[float], intercept: float) -> LogisticModel:
    return LogisticModel(dict(zip(feature_names, map(float, coefficients), strict=True)), float(intercept))


def refit_same_predictors(train: DataFrame, holdout: DataFrame, pred_cols: list[str], target_col: str, gates: Gates | None = None, output: str = "p_refit", **options) -> DataFrame:
    """``holdout`` with the probabilities, in ``output``, of a model refitted on ``train`` with the same predictors."""
    return holdout.withColumn(output, refit_with_diagnostics(train, pred_cols, target_col, gates, **options).artifact.predict_proba(holdout.columns))


def _gini(score: np.ndarray, bad: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    s, b, g = score[order], bad[order], (n - bad)[order]
    first = np.flatnonzero(np.diff(s, prepend=-np.inf))
    b, g = np.add.reduceat(b, first), np.add.reduceat(g, first)
    if not b.sum() or not g.sum() or len(first) < 2:
        return float("nan")
    return float(2 * (b * (np.cumsum(g) - g / 2)).sum() / (b.sum() * g.sum()) - 1)


def bootstrap_ginis(df: DataFrame, y: str, scores: list[str], n_bootstrap: int = 200, seed: int = 42) -> DataFrame:
    """``replicate, g0, g1...``: Ginis of each score on resampled rows; draws are paired across scores.

    Rows collapse to distinct (scores, outcome) with their counts, a table bounded by ``MOST_SCORES`` (scores are
    rounded to as many digits as that takes); a multinomial draw of counts is the same as a draw of rows.
    """
    spark = df.sparkSession
    rows = df.select(*[clipped(F.col(s)).alias(f"s{i}") for i, s in enumerate(scores)], F.col(y).cast("double").alias("y_")).where("y_ is not null")
    keys = [f"s{i}" for i in range(len(scores))] + ["y_"]
    for digits in (17, 6, 4, 3, 2):
        table = rows.select(*[F.round(k, digits).alias(k) if digits < 17 else F.col(k) for k in keys]).groupBy(*keys).agg(F.count("*").alias("n"))
        if digits == 2 or table.limit(MOST_SCORES + 1).count() <= MOST_SCORES:
            break
    got = np.array(sorted(tuple(r) for r in table.collect()), dtype=float).reshape(-1, len(keys) + 1)
    shared = spark.sparkContext.broadcast(got)
    seeds = spark.createDataFrame(list(enumerate(spawn_seeds(seed, n_bootstrap))), "replicate long, seed long")
    k = len(scores)

    def draw(batches: Iterator) -> Iterator:
        import pandas as pd

        data = shared.value
        n = data[:, -1]
        for batch in batches:
            out = []
            for replicate, s in zip(batch["replicate"], batch["seed"], strict=True):
                drawn = np.random.default_rng(int(s)).multinomial(int(n.sum()), n / n.sum()).astype(float) if len(data) else n
                out.append((replicate, *[_gini(data[:, i], drawn * data[:, k], drawn) for i in range(k)]))
            yield pd.DataFrame(out, columns=["replicate", *[f"g{i}" for i in range(k)]])

    return seeds.repartition(spark.sparkContext.defaultParallelism).mapInPandas(draw, "replicate long, " + ", ".join(f"g{i} double" for i in range(k)))


def _interval(df: DataFrame, draws: Column, point: float | None, z: float, names: tuple[str, str]) -> dict:
    r = df.select(draws.alias("d")).where("d is not null and not isnan(d)").agg(F.count("*").alias("n"), F.stddev_samp("d").alias("se")).first()
    se = r["se"] if r["n"] >= 10 and point is not None else None
    return {names[0]: se, names[1]: None if se is None else point - z * se}


def point_ginis(df: DataFrame, y: str, scores: list[str]) -> list[float | None]:
    return [rank_metrics(histogram(df.withColumn("all_", F.lit(1)), ["all_"], y, s), ["all_"]).first()["gini"] if df.limit(1).count() else None for s in scores]


def bootstrap_gini_ci(df: DataFrame, y: str, p: str, n_bootstrap: int = 200, seed: int = 42, z: float = 1.64) -> dict:
    g = point_ginis(df, y, [p])[0]
    return {"gini": g} | _interval(bootstrap_ginis(df, y, [p], n_bootstrap, seed), F.col("g0"), g, z, ("gini_se", "gini_ci_low"))


def bootstrap_delta_gini(df: DataFrame, y: str, p_refit: str, p_pooled: str, n_bootstrap: int = 200, seed: int = 42, z: float = 1.64) -> dict:
    a, b = point_ginis(df, y, [p_refit, p_pooled])
    delta = None if a is None or b is None else a - b
    return {"gini_refit": a, "gini_pooled": b, "delta_gini": delta} | _interval(bootstrap_ginis(df, y, [p_refit, p_pooled], n_bootstrap, seed), F.col("g0") - F.col("g1"), delta, z, ("delta_gini_se", "delta_gini_ci_low"))


def proper_scores(df: DataFrame, y: str, p: str) -> tuple[float | None, float | None]:
    r = moments(df.withColumn("all_", F.lit(1)), ["all_"], y, p).first()
    return (r["brier"], r["logloss"]) if r else (None, None)
