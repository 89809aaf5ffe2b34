"""Discrimination at a matched approval rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.operators.metrics import histogram, histogram_of, rank_metrics, running_totals, score_counts
from gradewise.plans.spec import Gates
from gradewise.sources.shared import materialize


def _cutoff(hist: DataFrame, keys: list[str], rate: str) -> DataFrame:
    """The interpolated score quantile of each group at the rate in its column ``rate``."""
    at, upto = (F.col("nn") - 1) * F.col(rate), F.col("n_below") + F.col("n")
    lo, hi = F.min(F.when(upto > F.floor(at), F.col("p_"))), F.min(F.when(upto > F.ceil(at), F.col("p_")))
    return hist.groupBy(*keys).agg((lo + F.max(at - F.floor(at)) * (hi - lo)).alias("cutoff"))


#: Stretches of the reference's ranks that a rank is looked up by.
STRETCHES = 4096


def _at_rates(ref: DataFrame, asked: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``keys, cutoff, gini``: the reference's score quantile at each cell's ``matched_ar``, and its Gini up to there.

    Running totals of the reference answer both at once: a rate is two ranks, a rank a row of the histogram, found by an
    equal join on stretches of ranks.
    """
    good_below, good = F.col("n_below") - F.col("b_below"), F.col("n") - F.col("b")
    ref = running_totals(ref.withColumn("wins", F.col("b") * (good_below + good / 2)).withColumn("one", F.lit(1)), ["all_"], {"wins": ("wins_below", "all_wins"), "one": ("scores_below", "scores")})
    bads, goods = F.col("b_below") + F.col("b"), good_below + good
    auc = F.when((bads > 0) & (goods > 0) & (F.col("scores_below") > 0), (F.col("wins_below") + F.col("wins")) / (bads * goods))
    width = max(1, -(-rows // STRETCHES))
    stretch = lambda c: F.floor(c / width)
    spread = ref.select("p_", "n_below", (F.col("n_below") + F.col("n")).alias("upto"), (2 * auc - 1).alias("gini"), F.explode(F.sequence(stretch(F.col("n_below")), stretch(F.col("n_below") + F.col("n") - 1))).alias("stretch"))
    at = F.col("matched_ar") * F.lit(rows - 1)
    ends = asked.select(*keys, (at - F.floor(at)).alias("share"), F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil(at).alias("rank")))).alias("x")).select(*keys, "share", "x.*").withColumn("stretch", stretch(F.col("rank")))
    found = ends.join(spread, "stretch").where((F.col("rank") >= F.col("n_below")) & (F.col("rank") < F.col("upto")))
    low, high = F.max(F.when(F.col("end") == 0, F.col("p_"))), F.max(F.when(F.col("end") == 1, F.col("p_")))
    return found.groupBy(*keys).agg((low + F.max("share") * (high - low)).alias("cutoff"), F.max(F.when(F.col("end") == 0, F.col("gini"))).alias("gini"))


def matched_ar(cells: DataFrame, book: DataFrame, keys: list[str], y: str, p: str, gates: Gates | None = None) -> DataFrame:
    """A row a cell: approval rates at the book's cutoff, the gap, and both Ginis among the approved at the lower rate.

    Low scores are approved. ``cells`` holds the rows of each cell, ``book`` the reference; scores are not clipped here.
    The rows of both are counted once; each cell reads the book's Gini at its own rate from the book's running totals.
    """
    g = gates or Gates()
    ref_hist = histogram(book.withColumn("all_", F.lit(1)), ["all_"], y, p, clip=False)
    cut = _cutoff(ref_hist.withColumn("rate", F.lit(g.reference_approval_rate)), ["all_"], "rate").first()
    base = cut["cutoff"] if cut else None
    low = F.col("p_") <= F.lit(base).cast("double")
    sums = ref_hist.agg((F.sum(F.when(low, F.col("n")).otherwise(0)) / F.sum("n")).alias("ar"), F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    counts = score_counts(cells, keys, y, p, clip=False)
    known = F.col("p_").isNotNull()
    seg = counts.where(known).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("b"), (F.sum(F.when(low, F.col("n")).otherwise(0)) / F.sum("n")).alias("ar_segment")).withColumn("ar_reference", F.lit(sums["ar"]).cast("double"))
    enough = (F.col("n") >= g.matched_ar_min_n) & (F.col("b") >= g.matched_ar_min_events) & F.lit((sums["n"] or 0) >= g.matched_ar_min_n and (sums["b"] or 0) >= g.matched_ar_min_events)
    gap = F.col("ar_segment") - F.col("ar_reference")
    seg = seg.where(enough).select(*keys, "ar_segment", "ar_reference", gap.alias("ar_gap"), (F.abs(gap) >= g.ar_gap_trigger).alias("ar_gap_triggered"), F.least("ar_segment", "ar_reference").alias("matched_ar"), F.when(gap <= 0, "segment").otherwise("reference").alias("ar_anchor"))
    seg = materialize(seg, "rates")
    asked = seg.where("ar_gap_triggered").select(*keys, "matched_ar")
    mine = histogram_of(counts.join(asked.select(*keys), keys, "left_semi"), keys).join(asked, keys)
    own_cut = _cutoff(mine, keys, "matched_ar")
    gini_s = rank_metrics(mine.join(own_cut, keys).where("p_ <= cutoff"), keys).select(*keys, F.col("gini").alias("gini_segment_at_matched_ar"))
    theirs = _at_rates(ref_hist, asked, keys, sums["n"] or 1).select(*keys, F.col("cutoff").alias("cutoff_reference"), F.col("gini").alias("gini_reference_at_matched_ar"))
    out = seg.join(own_cut.withColumnRenamed("cutoff", "cutoff_segment"), keys, "left").join(theirs, keys, "left").join(gini_s, keys, "left")
    ratio = F.when(F.abs("gini_reference_at_matched_ar") >= 0.05, F.col("gini_segment_at_matched_ar") / F.col("gini_reference_at_matched_ar"))
    return out.withColumn("gini_at_matched_ar_ratio", ratio)
