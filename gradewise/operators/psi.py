"""Population stability and characteristic diagnostics from one count cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.functions.columns import MISSING, finite, levels, logit_transform
from gradewise.operators.bins import BinningModel, BinSpec, edge_labels, information_value, numeric_bin, woe_table
from gradewise.operators.metrics import histogram, rank_metrics

EPSILON = 1e-6
INF = float("inf")


def decile_edges(df: DataFrame, features: dict[str, Column], n_bins: int = 10) -> dict[str, list[float] | None]:
    """Quantile edges of each feature over ``df`` in one job; None where fewer than three values are distinct."""
    if not features:
        return {}
    qs = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    got = df.agg(*[F.percentile(c, qs).alias(f"q{i}") for i, c in enumerate(features.values())]).first()
    out = {}
    for i, f in enumerate(features):
        distinct = sorted(set(got[f"q{i}"] or []))
        out[f] = [-INF, *distinct[1:-1], INF] if len(distinct) >= 3 else None
    return out


portfolio_decile_edges = decile_edges


def psi_bins(reference: DataFrame, features: list[str], grouping: BinningModel | None = None, n_bins: int = 10, categorical: tuple[str, ...] = ()) -> dict[str, tuple[str, Column]]:
    """For each feature the method and the bin column: the grouping's bins, quantiles of the reference, or levels."""
    types = {f.name: f.dataType for f in reference.schema.fields}
    specs = grouping.specs if grouping else {}
    numeric = [f for f in features if f not in specs and f not in categorical and isinstance(types[f], T.NumericType)]
    counts = reference.agg(*[F.approx_count_distinct(finite(F.col(f))).alias(f"d{i}") for i, f in enumerate(numeric)]).first() if numeric else None
    numeric = [f for i, f in enumerate(numeric) if counts[f"d{i}"] > 2]
    wanted = {f: finite(F.col(f)) for f in numeric} | {f: logit_transform(F.col(f), specs[f].impute) for f in features if f in specs and specs[f].kind == "logit"}
    edges = decile_edges(reference, wanted, n_bins)
    out = {}
    for f in features:
        if f in wanted and edges[f]:
            method = "logit_quantile_bins" if f in specs else "numeric_portfolio_deciles"
            out[f] = (method, numeric_bin(wanted[f], edges[f], edge_labels(edges[f])))
        elif f in specs and specs[f].kind != "logit":
            out[f] = ("grouping_bins", specs[f].assign(F.col(f)))
        else:
            out[f] = ("categorical_levels", levels(F.col(f)))
    return out


def count_cube(df: DataFrame, bins: dict[str, tuple[str, Column]], keys: list[str]) -> DataFrame:
    """``keys, feature, bin, n`` in one pass."""
    pairs = [F.struct(F.lit(f).alias("feature"), c.alias("bin")) for f, (_, c) in bins.items()]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("x_")).groupBy(*keys, "x_.feature", "x_.bin").agg(F.count("*").alias("n"))


def psi_from_counts(segment: DataFrame, reference: DataFrame, keys: list[str], epsilon: float = EPSILON) -> DataFrame:
    """``keys, feature, psi, worst_bin, empty_bins, missing_segment, missing_reference, psi_bin_table``.

    ``segment`` counts (keys, feature, bin), ``reference`` (feature, bin); a bin that one side lacks counts as empty.
    """
    groups = segment.select(*keys, "feature").distinct()
    every = groups.join(reference.select("feature", "bin"), "feature").select(*keys, "feature", "bin").union(segment.select(*keys, "feature", "bin")).distinct()
    s = every.join(segment, [*keys, "feature", "bin"], "left").join(reference.withColumnRenamed("n", "rn"), ["feature", "bin"], "left")
    s = s.select(*keys, "feature", "bin", F.coalesce("n", F.lit(0)).alias("sn"), F.coalesce("rn", F.lit(0)).alias("rn"))
    totals = s.groupBy(*keys, "feature").agg(F.sum("sn").alias("st"), F.sum("rn").alias("rt"))
    s = s.join(totals, [*keys, "feature"])
    share_s, share_r = F.greatest(F.col("sn") / F.col("st"), F.lit(epsilon)), F.greatest(F.col("rn") / F.col("rt"), F.lit(epsilon))
    s = s.withColumn("share_segment", F.col("sn") / F.col("st")).withColumn("share_reference", F.col("rn") / F.col("rt")).withColumn("contrib", (share_s - share_r) * F.ln(share_s / share_r))
    missing = F.col("bin") == MISSING
    return s.groupBy(*keys, "feature").agg(
        F.sum("contrib").alias("psi"),
        F.min_by("bin", F.struct(-F.col("contrib"), F.col("bin"))).alias("worst_bin"),
        F.sum(((F.col("sn") == 0) | (F.col("rn") == 0)).cast("int")).cast("int").alias("empty_bins"),
        F.sum(F.when(missing, F.col("share_segment")).otherwise(0.0)).alias("missing_segment"),
        F.sum(F.when(missing, F.col("share_reference")).otherwise(0.0)).alias("missing_reference"),
        F.array_sort(F.collect_list(F.struct("bin", "share_segment", "share_reference", "contrib"))).alias("psi_bin_table"),
    )


def psi_table(segment: DataFrame, reference: DataFrame, features: list[str], grouping: BinningModel | None = None, keys: list[str] | None = None, n_bins: int = 10, categorical_features: tuple[str, ...] = ()) -> DataFrame:
    """One row for each feature (and ``keys`` of ``segment``), with the method."""
    keys = keys or []
    bins = psi_bins(reference, features, grouping, n_bins, categorical_features)
    methods = F.create_map(*[F.lit(x) for f, (m, _) in bins.items() for x in (f, m)])
    out = psi_from_counts(count_cube(segment, bins, keys), count_cube(reference, bins, []), keys)
    return out.withColumn("psi_method", methods[F.col("feature")])


def psi_for_feature(segment: DataFrame, reference: DataFrame, feature: str, spec: BinSpec | None = None, n_bins: int = 10, treat_as: str | None = None) -> DataFrame:
    grouping = BinningModel({feature: spec}) if spec else None
    return psi_table(segment, reference, [feature], grouping, n_bins=n_bins, categorical_features=(feature,) if treat_as == "categorical" else ())


def out_of_range_share(segment: DataFrame, reference: DataFrame, features: list[str], keys: list[str], grouping: BinningModel | None = None) -> DataFrame:
    """Share of known values outside the reference's range; for grouped levels, share of rows whose level no group has."""
    specs = grouping.specs if grouping else {}
    by_level = [f for f in features if f in specs and specs[f].kind != "numeric"]
    bounds = reference.agg(F.lit(1).alias("one_"), *[x for i, f in enumerate(features) if f not in by_level for x in (F.min(finite(F.col(f))).alias(f"lo{i}"), F.max(finite(F.col(f))).alias(f"hi{i}"))])

    def out(i: int, f: str) -> Column:
        if f in by_level:
            known = [x for members in (specs[f].groups or {}).values() for x in members]
            return ~levels(F.col(f)).isin(MISSING, *known)
        return (finite(F.col(f)) < F.col(f"lo{i}")) | (finite(F.col(f)) > F.col(f"hi{i}"))

    wide = segment.select(*keys, *features).crossJoin(F.broadcast(bounds))
    pairs = [F.struct(F.lit(f).alias("feature"), out(i, f).alias("out")) for i, f in enumerate(features)]
    return wide.select(*keys, F.explode(F.array(*pairs)).alias("x_")).groupBy(*keys, "x_.feature").agg(F.avg(F.col("x_.out").cast("double")).alias("out_of_range_share"))


def woe_spearman(segment: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Rank correlation of two WoE tables over their common bins, average ranks for ties; null under three bins."""
    from pyspark.sql import Window as W

    both = segment.select(*keys, "feature", "bin", F.col("woe").alias("a")).join(reference.select("feature", "bin", F.col("woe").alias("b")), ["feature", "bin"])
    group = W.partitionBy(*keys, "feature")

    def ranks(c: str) -> Column:
        ties = F.count("*").over(W.partitionBy(*keys, "feature", c))
        return F.rank().over(group.orderBy(c)) + (ties - 1) / 2

    ranked = both.select(*keys, "feature", ranks("a").alias("ra"), ranks("b").alias("rb"))
    enough = (F.count("*") >= 3) & (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0)
    return ranked.groupBy(*keys, "feature").agg(F.when(enough, F.round(F.corr("ra", "rb"), 12) + F.lit(0.0)).alias("woe_spearman"))


def feature_diagnostics(segments: DataFrame, book: DataFrame, features: list[str], y: str, keys: list[str], grouping: BinningModel | None = None, n_bins: int = 10) -> DataFrame:
    """IV on both sides, rank correlation of weights, univariate Gini, reversal and the PSI block; a row a cell and feature.

    Weights of both sides use one set of bins: the grouping's, or quantiles and levels of ``book``.
    """
    bins = psi_bins(book, features, grouping, n_bins)

    def cube(df: DataFrame, k: list[str]) -> DataFrame:
        pairs = [F.struct(F.lit(f).alias("feature"), c.alias("bin")) for f, (_, c) in bins.items()]
        rows = df.select(*k, F.col(y).cast("double").alias("y_"), F.explode(F.array(*pairs)).alias("x_"))
        return rows.groupBy(*k, "x_.feature", "x_.bin").agg(F.count("*").alias("n"), F.sum("y_").alias("events"))

    mine, theirs = woe_table(cube(segments, keys), keys), woe_table(cube(book, []))
    types = {f.name: f.dataType for f in segments.schema.fields}
    numeric = [f for f in features if isinstance(types[f], T.NumericType)]
    out = information_value(mine, keys).withColumnRenamed("iv", "iv_segment").join(information_value(theirs).withColumnRenamed("iv", "iv_overall"), "feature")
    out = out.join(woe_spearman(mine, theirs, keys), [*keys, "feature"], "left")
    if numeric:
        medians = segments.groupBy(*keys).agg(*[F.median(finite(F.col(f))).alias(f"m{i}") for i, f in enumerate(numeric)])
        filled = segments.join(medians, keys)
        pairs = [F.struct(F.lit(f).alias("feature"), F.coalesce(finite(F.col(f)), F.col(f"m{i}")).alias("v")) for i, f in enumerate(numeric)]
        long = filled.select(*keys, F.col(y).cast("double").alias("y_"), F.explode(F.array(*pairs)).alias("x_")).select(*keys, "y_", "x_.feature", "x_.v")
        g = rank_metrics(histogram(long, [*keys, "feature"], "y_", "v"), [*keys, "feature"]).select(*keys, "feature", F.col("gini").alias("univariate_gini_segment"))
        out = out.join(g, [*keys, "feature"], "left")
    psi = psi_from_counts(mine.select(*keys, "feature", "bin", "n"), theirs.select("feature", "bin", "n"), keys)
    methods = F.create_map(*[F.lit(x) for f, (m, _) in bins.items() for x in (f, m)])
    used = F.lit(grouping is not None)
    return out.join(psi, [*keys, "feature"]).withColumn("psi_method", methods[F.col("feature")]).withColumn("rank_reversal", F.coalesce(F.col("woe_spearman") < 0, F.lit(False))).withColumn("grouping_used", used)


def shape_divergence(diagnostics: DataFrame, keys: list[str], material: float = 0.25) -> DataFrame:
    return diagnostics.groupBy(*keys).agg(F.bool_or((F.col("psi") >= material) | F.col("rank_reversal")).alias("shape_divergent"))
