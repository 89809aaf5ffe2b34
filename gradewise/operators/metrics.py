"""Discrimination and calibration of scores for any grouping, in a fixed number of passes over the rows.

Rows first collapse into counts of (keys, score), which are written once; nothing reads the rows again. Running totals
over them come from two levels: totals of score ranges inside each group, then windows inside one range, so no group's
rows meet in one task. Everything else (moments, AUC, KS, quantile bins) reads the counts or their running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradewise.functions.columns import clipped, finite
from gradewise.plans.spec import OVERALL_SEGMENT_COL, OVERALL_SEGMENT_VALUE
from gradewise.sources.shared import materialize

#: Score ranges of a group that have windows of their own: evenly spaced log-odds between 0 and 1, where scores of low
#: default books crowd, and fewer on either side.
RANGES, OUTER = 4096, 1024


def to_cells(df: DataFrame, segment_cols: list[str], overall: bool = True) -> DataFrame:
    """Each row once for every segment it is in: ``segment_col``, ``segment_value``. Null segments are ``nan``."""
    cells = [F.struct(F.lit(c).alias("segment_col"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("segment_value")) for c in segment_cols if c in df.columns]
    if overall:
        cells.append(F.struct(F.lit(OVERALL_SEGMENT_COL).alias("segment_col"), F.lit(OVERALL_SEGMENT_VALUE).alias("segment_value")))
    return df.select("*", F.explode(F.array(*cells)).alias("cell_")).select("cell_.*", *[c for c in df.columns if c not in ("segment_col", "segment_value")])


def score_counts(df: DataFrame, keys: list[str], y: str, p: str, clip: bool = True) -> DataFrame:
    """``keys, p_, n, b``: rows and events at each score (null where it is unknown), from one pass over ``df``."""
    score = clipped(F.col(p)) if clip else finite(F.col(p))
    rows = df.select(*keys, F.when(F.col(p).isNotNull(), score).alias("p_"), F.col(y).cast("double").alias("y_"))
    return materialize(rows.groupBy(*keys, "p_").agg(F.count("*").alias("n"), F.coalesce(F.sum("y_"), F.lit(0.0)).alias("b")), "scores")


def rolled_up(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts for fewer keys."""
    return counts.groupBy(*keys, "p_").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))


def _range(p: Column) -> Column:
    odds = F.ln(p / (1 - p))
    inner = OUTER + 1 + F.floor((F.least(F.greatest(odds, F.lit(-20.0)), F.lit(20.0)) + 20) * (RANGES / 40))
    outer = F.floor(p / (1 + F.abs(p)) * OUTER)
    return F.when(p <= 0, outer + OUTER).when(p < 1, inner).otherwise(outer + OUTER + RANGES + 2)


def running_totals(hist: DataFrame, keys: list[str], names: dict[str, tuple[str, str]]) -> DataFrame:
    """``hist`` (a row a key and ``p_``) with, for each column, its total below ``p_`` and of the whole group."""
    hist = hist.withColumn("range_", _range(F.col("p_")))
    before = W.partitionBy(*keys).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, "range_").orderBy("p_").rowsBetween(W.unboundedPreceding, -1)
    ranges = hist.groupBy(*keys, "range_").agg(*[F.sum(c).alias(c) for c in names])
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranges = ranges.select(*keys, "range_", *[x for c, (below, whole) in names.items() for x in (zero(F.sum(c).over(before)).alias(f"{below}0_"), F.sum(c).over(W.partitionBy(*keys)).alias(whole))])
    own = hist.select("*", *[zero(F.sum(c).over(inside)).alias(f"{below}1_") for c, (below, _) in names.items()])
    joined = own.join(ranges, [*keys, "range_"])
    return joined.select(*[c for c in hist.columns if c != "range_"], *[x for below, whole in names.values() for x in ((F.col(f"{below}0_") + F.col(f"{below}1_")).alias(below), F.col(whole))])


def histogram_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, p_, n, b, n_below, b_below, nn, bb``: rows and events at each score, below it, and of the whole group."""
    known = counts.where("p_ is not null").select(*keys, "p_", "n", "b")
    return running_totals(known, keys, {"n": ("n_below", "nn"), "b": ("b_below", "bb")}).select(*keys, "p_", "n", "b", "n_below", "b_below", "nn", "bb")


def histogram(df: DataFrame, keys: list[str], y: str, p: str, clip: bool = True) -> DataFrame:
    return histogram_of(score_counts(df, keys, y, p, clip), keys)


def rank_metrics(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``auc, gini, ks`` of each group; null where one class or one score is all there is.

    The first two also hold for the lower part of a histogram: its totals are the largest running totals.
    """
    good_below = F.col("n_below") - F.col("b_below")
    good = F.col("n") - F.col("b")
    wins = F.sum(F.col("b") * (good_below + good / 2))
    bads = F.max(F.col("b_below") + F.col("b"))
    goods = F.max(good_below + good)
    known = (bads > 0) & (goods > 0) & (F.count("*") > 1)
    auc = F.when(known, wins / (bads * goods))
    gap = F.abs((F.col("b_below") + F.col("b")) / F.col("bb") - (good_below + good) / (F.col("nn") - F.col("bb")))
    safe_gap = F.when((F.col("bb") > 0) & (F.col("nn") > F.col("bb")), gap)
    return hist.groupBy(*keys).agg(auc.alias("auc"), (2 * auc - 1).alias("gini"), F.max(safe_gap).alias("ks"))


def quantiles(hist: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """``keys, edges, nn``: distinct edges of equal-frequency bins, linearly interpolated; n bins if rows are fewer."""
    bins = F.least(F.lit(n_bins), F.col("nn")).cast("int")
    parts = []
    for i in range(n_bins + 1):
        q = F.when(F.lit(i) >= bins, F.lit(1.0)).otherwise(F.lit(float(i)) * (F.lit(1.0) / bins))
        at = (F.col("nn") - 1) * q
        upto = F.col("n_below") + F.col("n")
        lo, hi = F.min(F.when(upto > F.floor(at), F.col("p_"))), F.min(F.when(upto > F.ceil(at), F.col("p_")))
        share = F.max(at - F.floor(at))
        parts.append((lo + share * (hi - lo)).alias(f"e{i}"))
    out = hist.groupBy(*keys).agg(F.max("nn").alias("nn"), *parts)
    return out.select(*keys, "nn", F.array_distinct(F.array(*[f"e{i}" for i in range(n_bins + 1)])).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """The right-closed bin of ``value``, from 1; the least value belongs to the first bin."""
    return F.greatest(F.size(F.filter(edges, lambda e: e < value)), F.lit(1))


def calibration_bins(hist: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """``keys, bin, rows, events, score_sum`` over equal-frequency bins of the score."""
    edges = quantiles(hist, keys, n_bins)
    joined = hist.join(edges.select(*keys, "edges"), keys) if keys else hist.crossJoin(edges.select("edges"))
    return joined.groupBy(*keys, bin_of(F.col("p_"), F.col("edges")).alias("bin")).agg(
        F.sum("n").alias("rows"), F.sum("b").alias("events"), F.sum(F.col("n") * F.col("p_")).alias("score_sum")
    )


def calibration(hist: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """``ece, hosmer_lemeshow, hl_df`` of each group."""
    bins = calibration_bins(hist, keys, n_bins)
    ece = F.sum(F.abs(F.col("score_sum") - F.col("events"))) / F.sum("rows")
    expected = F.col("score_sum")
    spread = F.greatest(expected * (1 - expected / F.col("rows")), F.lit(1e-12))
    enough = F.sum("rows") >= n_bins
    hl = F.sum((F.col("events") - expected) ** 2 / spread)
    return bins.groupBy(*keys).agg(ece.alias("ece"), F.when(enough, hl).alias("hosmer_lemeshow"), F.when(enough, F.greatest(F.count("*") - 2, F.lit(1))).cast("int").alias("hl_df"))


def moments(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """``n, defaults, obs_rate, mean_pd, oe, brier, logloss`` on clipped scores."""
    c, t = clipped(F.col(p)), F.col(y).cast("double")
    loss = -F.avg(t * F.ln(c) + (1 - t) * F.ln(1 - c))
    both = (F.sum(t) > 0) & (F.sum(t) < F.count("*"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(t).cast("long").alias("defaults"), F.avg(t).alias("obs_rate"), F.avg(c).alias("mean_pd"),
        (F.avg(t) / F.avg(c)).alias("oe"), F.avg((c - t) ** 2).alias("brier"), F.when(both, loss).alias("logloss"),
    )


def moments_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """What ``moments`` gives, from counts of clipped scores (outcomes are known)."""
    n, b, p = F.col("n"), F.col("b"), F.col("p_")
    scored = F.sum(F.when(p.isNotNull(), n))
    rate, mean = F.sum(b) / F.sum(n), F.sum(n * p) / scored
    both = (F.sum(b) > 0) & (F.sum(b) < F.sum(n))
    loss = -F.sum(b * F.ln(p) + (n - b) * F.ln(1 - p)) / scored
    return counts.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(b).cast("long").alias("defaults"), rate.alias("obs_rate"), mean.alias("mean_pd"), (rate / mean).alias("oe"),
        (F.sum(b * (1 - p) ** 2 + (n - b) * p**2) / scored).alias("brier"), F.when(both, loss).alias("logloss"),
    )


def performance_of(counts: DataFrame, keys: list[str], n_ece_bins: int = 10) -> DataFrame:
    """All metrics of each group, from its counts."""
    hist = histogram_of(counts, keys)
    out = moments_of(counts, keys)
    for x in (rank_metrics(hist, keys), calibration(hist, keys, n_ece_bins)):
        out = out.join(x, keys) if keys else out.crossJoin(x)
    return out


def performance_bundle(df: DataFrame, keys: list[str], y: str, p: str, n_ece_bins: int = 10) -> DataFrame:
    """All of it, a row a group, from one pass over ``df``."""
    return performance_of(score_counts(df, keys, y, p), keys, n_ece_bins)


def gini_standard_error(gini: Column, bads: Column, goods: Column) -> Column:
    """Twice the Hanley-McNeil standard error of the AUC, folded to at least a half."""
    auc = F.greatest((gini + 1) / 2, 1 - (gini + 1) / 2)
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    variance = (auc * (1 - auc) + (bads - 1) * (q1 - auc * auc) + (goods - 1) * (q2 - auc * auc)) / (bads * goods)
    return F.when((bads > 0) & (goods > 0), 2 * F.sqrt(F.greatest(variance, F.lit(0.0))))


def vintage_ratio(vintages: DataFrame, keys: list[str]) -> DataFrame:
    """``latest_to_early_gini_ratio``: the last vintage's Gini over the mean of the first half's (of one at least).

    ``vintages`` has ``vintage, gini``; null Ginis are left out, and fewer than two give null.
    """
    known = vintages.where(F.col("gini").isNotNull())
    place = F.row_number().over(W.partitionBy(*keys).orderBy("vintage"))
    counted = known.select(*keys, "vintage", "gini", place.alias("place"), F.count("*").over(W.partitionBy(*keys)).alias("k"))
    early = F.avg(F.when(F.col("place") <= F.greatest(F.floor(F.col("k") / 2), F.lit(1)), F.col("gini")))
    latest = F.max_by("gini", "vintage")
    ratio = F.when((F.max("k") >= 2) & (early != 0), latest / early)
    return counted.groupBy(*keys).agg(ratio.alias("latest_to_early_gini_ratio"), F.count("*").cast("int").alias("n_vintages"))


def time_holdout_cutoff(df: DataFrame, keys: list[str], date: str, frac: float = 0.25) -> DataFrame:
    """``cutoff`` of each group: rows at or after it are held out. Counts distinct times; fewer than two give null."""
    times = df.select(*keys, F.try_to_timestamp(F.col(date).cast("string")).alias("t_")).where("t_ is not null").distinct()
    order = W.partitionBy(*keys).orderBy("t_")
    numbered = times.select(*keys, "t_", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(W.partitionBy(*keys)).alias("k"))
    at = F.least(F.greatest(F.floor(F.col("k") * (1 - frac)), F.lit(1)), F.col("k") - 1)
    return numbered.where((F.col("k") >= 2) & (F.col("i") == at)).select(*keys, F.col("t_").alias("cutoff"))
