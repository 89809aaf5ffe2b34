"""Registered queries, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradewise import prepare
from gradewise.functions.columns import clipped, fantomas_mask, logit_transform, observable_mask, sigmoid, vintage, wilson
from gradewise.operators import bins as B
from gradewise.operators import decide as D
from gradewise.operators import metrics as M
from gradewise.operators import psi as P
from gradewise.operators.matched_ar import matched_ar
from gradewise.plans.spec import Gates, ScorecardColumns
from gradewise.sources.book import ORACLE_BOOK, book

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
COLS = ScorecardColumns("l_orderkey", "score_date", "obs", "y", "pd", ["x1", "x2", "cat"], ["channel"], "fantomas")
CELL = ["segment_col", "segment_value"]
GATES = Gates(min_n=400, min_events=25)
#: The grouping that the queries apply.
GROUPING = B.BinningModel({
    "x1": B.BinSpec("x1", "numeric", "fixed", edges=[-B.INF, 10.0, 20.0, 30.0, 40.0, B.INF]),
    "x2": B.BinSpec("x2", "numeric", "fixed", edges=[-B.INF, 0.025, 0.055, 0.085, B.INF], closed="left"),
    "cat": B.BinSpec("cat", "categorical", "fixed", groups={"A": ["A"], "N|R": ["N", "R"]}),
})


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _observable(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = book(spark, sf_dir)
    return b.where(observable_mask(b, COLS))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.to_cells(_observable(spark, sf_dir), ["channel"])


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


OBS = f"book as ({ORACLE_BOOK}), obs as (select * from book where obs = 1)"
CELLS = OBS + ", cells as (select 'channel' as segment_col, channel as segment_value, * from obs union all select '__overall__', 'ALL', * from obs)"


def _hist(keys: str, source: str, p: str = "least(greatest(pd, 1e-6), 1 - 1e-6)", y: str = "y", name: str = "hist") -> str:
    return f"""{name} as (
  select *, n_upto - n as n_below, b_upto - b as b_below, sum(n) over (partition by {keys}) as nn, sum(b) over (partition by {keys}) as bb from (
    select {keys}, p, n, b, sum(n) over (partition by {keys} order by p) as n_upto, sum(b) over (partition by {keys} order by p) as b_upto
    from (select {keys}, {p} as p, count(*) as n, cast(sum({y}) as double) as b from {source} where ({p}) is not null group by {keys}, {p})))"""


GINI = "case when max(bb) > 0 and max(nn) > max(bb) and count(*) > 1 then 2 * sum(b * (n_below - b_below + (n - b) / 2)) / (max(bb) * (max(nn) - max(bb))) - 1 end"
RANKS = f"""ranks as (select segment_col, segment_value, {GINI} as gini, max(abs(b_upto / bb - (n_upto - b_upto) / (nn - bb))) as ks from hist group by segment_col, segment_value)"""
MOMENTS = """moments as (select segment_col, segment_value, count(*) as n, cast(sum(y) as bigint) as defaults, avg(y) as obs_rate, avg(p) as mean_pd, avg(y) / avg(p) as oe,
  avg((p - y) * (p - y)) as brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) as logloss
  from (select *, least(greatest(pd, 1e-6), 1 - 1e-6) as p from cells) group by segment_col, segment_value)"""
_QS = ", ".join(f"{i} * 0.1e0" if i < 10 else "1e0" for i in range(11))
CALIBRATION = f"""edges as (select segment_col, segment_value, list_sort(list_distinct(quantile_cont(p, [{_QS}]))) as e
  from (select *, least(greatest(pd, 1e-6), 1 - 1e-6) as p from cells) group by segment_col, segment_value),
calbins as (select segment_col, segment_value, greatest(len(list_filter(e, lambda x: x < p)), 1) as bin, sum(n) as nb, sum(b) as eb, sum(n * p) as sb
  from hist join edges using (segment_col, segment_value) group by all),
cal as (select segment_col, segment_value, sum(abs(sb - eb)) / sum(nb) as ece, sum((eb - sb) * (eb - sb) / greatest(sb * (1 - sb / nb), 1e-12)) as hosmer_lemeshow,
  cast(greatest(count(*) - 2, 1) as integer) as hl_df from calbins group by segment_col, segment_value)"""
FULL = f"with {CELLS}, {_hist('segment_col, segment_value', 'cells')}, {RANKS}, {MOMENTS}, {CALIBRATION}"


@query("segment_gini", f"with {CELLS}, {_hist('segment_col, segment_value', 'cells')}, {RANKS}, {MOMENTS} select segment_col, segment_value, n, defaults, round(obs_rate, 6) as obs_rate, round(mean_pd, 6) as mean_pd, round(oe, 6) as oe, round(brier, 6) as brier, round(gini, 6) as gini from moments join ranks using (segment_col, segment_value)")
def segment_gini(spark, sf_dir):
    counts = M.score_counts(_cells(spark, sf_dir), CELL, "y", "pd")
    ranks = M.rank_metrics(M.histogram_of(counts, CELL), CELL).select(*CELL, "gini")
    out = M.moments_of(counts, CELL).join(ranks, CELL).select(*CELL, "n", "defaults", "obs_rate", "mean_pd", "oe", "brier", "gini")
    return _rounded(out, "obs_rate", "mean_pd", "oe", "brier", "gini")


PERF = ("obs_rate", "mean_pd", "oe", "brier", "logloss", "gini", "ks", "ece", "hosmer_lemeshow")


@query("performance_bundle", FULL + " select segment_col, segment_value, n, defaults, " + ", ".join(f"round({c}, 6) as {c}" for c in PERF) + ", hl_df, round((gini + 1) / 2, 6) as auc from moments join ranks using (segment_col, segment_value) join cal using (segment_col, segment_value)")
def performance(spark, sf_dir):
    out = M.performance_bundle(_cells(spark, sf_dir), CELL, "y", "pd")
    return _rounded(out, *PERF, "auc").select(*CELL, "n", "defaults", *PERF, "hl_df", "auc")


@query("calibration_bins", FULL + " select segment_col, segment_value, cast(bin as integer) as bin, cast(nb as bigint) as n_rows, eb as events, round(sb, 4) as score_sum from calbins")
def calibration_bins(spark, sf_dir):
    hist = M.histogram(_cells(spark, sf_dir), CELL, "y", "pd")
    return M.calibration_bins(hist, CELL, 10).select(*CELL, F.col("bin").cast("int").alias("bin"), F.col("rows").alias("n_rows"), "events", F.round("score_sum", 4).alias("score_sum"))


@query("slice_metrics", f"""with book as ({ORACLE_BOOK}), cells as (select 'observable' as slice, channel as segment_value, * from book where obs = 1
  union all select 'observable_ex_fantomas', channel, * from book where obs = 1 and fantomas = 0), {_hist('slice, segment_value', 'cells')}
select slice, segment_value, max(nn) as n, max(bb) as events, round({GINI}, 6) as gini from hist group by slice, segment_value""")
def slice_metrics(spark, sf_dir):
    b = _observable(spark, sf_dir)
    every = F.array(F.lit("observable"), F.when(~fantomas_mask(b, COLS), F.lit("observable_ex_fantomas")))
    rows = b.withColumn("slice", F.explode(F.array_compact(every))).withColumnRenamed("channel", "segment_value")
    keys = ["slice", "segment_value"]
    hist = M.histogram(rows, keys, "y", "pd")
    sums = hist.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("events"))
    return _rounded(sums.join(M.rank_metrics(hist, keys), keys).select(*keys, "n", "events", "gini"), "gini")


SHARES = """with book as ({book}), cells as (select 'channel' as segment_col, channel as segment_value, * from book union all select '__overall__', 'ALL', * from book),
total as (select count(*) as n_all, sum(case when obs = 1 then y end) as d_all from book)
select segment_col, segment_value, count(*) as n_ttd, round(count(*) * 1e0 / max(n_all), 6) as volume_share, round(coalesce(sum(case when obs = 1 then y end), 0) * 1e0 / max(d_all), 6) as default_share,
  round(avg(fantomas), 6) as fantomas_rate, count(*) * 1e0 / max(n_all) >= 0.05e0 or coalesce(sum(case when obs = 1 then y end), 0) * 1e0 / max(d_all) >= 0.05e0 as important
from cells cross join total group by segment_col, segment_value"""


@query("segment_shares", SHARES.format(book=ORACLE_BOOK))
def segment_shares(spark, sf_dir):
    b = book(spark, sf_dir)
    bad = F.sum(F.when(observable_mask(b, COLS), F.col("y")))
    total = b.agg(F.count("*").alias("n_all"), bad.alias("d_all"))
    cells = M.to_cells(b, ["channel"]).groupBy(*CELL).agg(F.count("*").alias("n_ttd"), F.coalesce(bad, F.lit(0)).alias("d"), F.avg(fantomas_mask(b, COLS).cast("double")).alias("fantomas_rate"))
    out = cells.crossJoin(F.broadcast(total)).select(*CELL, "n_ttd", (F.col("n_ttd") / F.col("n_all")).alias("volume_share"), (F.col("d") / F.col("d_all")).alias("default_share"), "fantomas_rate")
    return _rounded(out.withColumn("important", D.is_important(F.col("volume_share"), F.col("default_share"), GATES)), "volume_share", "default_share", "fantomas_rate")


VTAIL = f"vcells as (select *, strftime(score_date, '%Y-%m') as vintage from cells), {_hist('segment_col, segment_value, vintage', 'vcells', name='vhist')}, vgini as (select segment_col, segment_value, vintage, max(nn) as n, max(bb) as defaults, {GINI} as gini, max(bb) / sum(n * p) as oe from vhist group by all)"
VINT = f"{CELLS}, {VTAIL}"
RATIO = """vplaced as (select *, row_number() over (partition by segment_col, segment_value order by vintage) as place, count(*) over (partition by segment_col, segment_value) as k from vgini where gini is not null),
ratios as (select segment_col, segment_value, max_by(gini, vintage) / avg(case when place <= greatest(k // 2, 1) then gini end) as ratio, count(*) as k from vplaced group by segment_col, segment_value having count(*) >= 2)"""


def _dated_counts(spark, sf_dir):
    """Scores of (cell, vintage); cells' own counts are their sums."""
    rows = _cells(spark, sf_dir).withColumn("vintage", vintage(F.col("score_date")))
    return M.score_counts(rows, [*CELL, "vintage"], "y", "pd")


def _vintages(counts):
    keys = [*CELL, "vintage"]
    hist = M.histogram_of(counts.where("vintage is not null"), keys)
    sums = hist.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("defaults"), (F.sum("b") / F.sum(F.col("n") * F.col("p_"))).alias("oe"))
    return sums.join(M.rank_metrics(hist, keys).select(*keys, "gini"), keys)


@query("vintage_table", f"with {VINT} select segment_col, segment_value, vintage, n, defaults, round(gini, 6) as gini, round(oe, 6) as oe from vgini")
def vintage_table(spark, sf_dir):
    return _rounded(_vintages(_dated_counts(spark, sf_dir)).select(*CELL, "vintage", "n", "defaults", "gini", "oe"), "gini", "oe")


@query("vintage_ratio", f"with {VINT}, {RATIO} select segment_col, segment_value, round(ratio, 6) as latest_to_early_gini_ratio, cast(k as integer) as n_vintages from ratios")
def vintage_ratio(spark, sf_dir):
    return _rounded(M.vintage_ratio(_vintages(_dated_counts(spark, sf_dir)), CELL), "latest_to_early_gini_ratio")


Q1_SQL = FULL + f""", {VTAIL}, {RATIO},
pooled as (select gini as pooled_gini from ranks where segment_col = '__overall__'),
facts as (select * from moments join ranks using (segment_col, segment_value) join cal using (segment_col, segment_value) left join ratios using (segment_col, segment_value) cross join pooled),
tests as (select *, n >= 400 and defaults >= 25 as power, coalesce(gini >= 0.25e0 and gini / pooled_gini >= 0.8e0, false) as rank_ok, oe between 0.8e0 and 1.25e0 and ece <= 0.03e0 as cal_ok, coalesce(ratio >= 0.7e0, true) as stable from facts)
select segment_col, segment_value, n, defaults, case when not power then 'INCONCLUSIVE' when rank_ok and cal_ok and stable then 'GOOD' else 'WEAK' end as q1_verdict,
  case when not power then 'insufficient_power' else concat_ws(';', case when not rank_ok then 'rank_order' end, case when not cal_ok then 'calibration' end, case when not stable then 'stability' end) end as failed_pillars from tests"""


def _verdicts(spark, sf_dir):
    counts = _dated_counts(spark, sf_dir)
    perf = M.performance_of(M.rolled_up(counts, CELL), CELL)
    pooled = perf.where("segment_col = '__overall__'").select(F.col("gini").alias("pooled_gini"))
    facts = perf.join(M.vintage_ratio(_vintages(counts), CELL), CELL, "left").crossJoin(F.broadcast(pooled))
    c = F.col
    verdict, pillars = D.q1_verdict(c("n"), c("defaults"), c("gini"), F.lit(None).cast("double"), c("pooled_gini"), c("oe"), c("ece"), c("latest_to_early_gini_ratio"), GATES)
    return facts.withColumn("q1_verdict", verdict).withColumn("failed_pillars", pillars)


@query("q1_verdicts", Q1_SQL)
def q1_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir).select(*CELL, "n", "defaults", "q1_verdict", "failed_pillars")


@query("action_list", f"with v as ({Q1_SQL}), s as ({SHARES.format(book=ORACLE_BOOK)}) select segment_col, segment_value, volume_share, q1_verdict, failed_pillars from v join s using (segment_col, segment_value) where important and q1_verdict = 'WEAK' and segment_col <> '__overall__'")
def action_list(spark, sf_dir):
    v, s = _verdicts(spark, sf_dir).select(*CELL, "q1_verdict", "failed_pillars"), segment_shares(spark, sf_dir)
    return v.join(F.broadcast(s), CELL).where("important and q1_verdict = 'WEAK' and segment_col <> '__overall__'").select(*CELL, "volume_share", "q1_verdict", "failed_pillars")


BIN_X1 = "case when x1 is null then '__missing__' when x1 <= 10 then '(-inf, 10]' when x1 <= 20 then '(10, 20]' when x1 <= 30 then '(20, 30]' when x1 <= 40 then '(30, 40]' else '(40, inf)' end"
BIN_X2 = "case when x2 is null then '__missing__' when x2 < 0.025e0 then '[-inf, 0.025)' when x2 < 0.055e0 then '[0.025, 0.055)' when x2 < 0.085e0 then '[0.055, 0.085)' else '[0.085, inf)' end"
BIN_CAT = "case when cat is null then '__missing__' when cat = 'A' then 'A' when cat in ('N', 'R') then 'N|R' else '__other__' end"
LONG = f"long as (select segment_col, segment_value, score_date, y, 'x1' as feature, {BIN_X1} as bin from cells union all select segment_col, segment_value, score_date, y, 'x2', {BIN_X2} from cells union all select segment_col, segment_value, score_date, y, 'cat', {BIN_CAT} from cells)"
CUBE = "cube as (select segment_col, segment_value, feature, bin, count(*) as n, cast(sum(y) as double) as events from long group by all)"
WOE = """woe as (select *, ln(good / bad) as woe, (good - bad) * ln(good / bad) as iv_part from (
  select *, (events + 0.5e0) / greatest(sum(events) over w + 1, 1) as bad, (n - events + 0.5e0) / greatest(sum(n - events) over w + 1, 1) as good
  from cube window w as (partition by segment_col, segment_value, feature)))"""


@query("bin_labels", f"with {OBS} select bx1, bx2, bcat, count(*) as n from (select {BIN_X1} as bx1, {BIN_X2} as bx2, {BIN_CAT} as bcat from obs) group by all")
def bin_labels(spark, sf_dir):
    return GROUPING.bin_frame(_observable(spark, sf_dir)).toDF("bx1", "bx2", "bcat").groupBy("bx1", "bx2", "bcat").agg(F.count("*").alias("n"))


def _woe(spark, sf_dir):
    return B.woe_table(B.bin_cube(_cells(spark, sf_dir), GROUPING.specs, "y", CELL), CELL)


@query("woe_table", f"with {CELLS}, {LONG}, {CUBE}, {WOE} select segment_col, segment_value, feature, bin, n, events, n - events as non_events, round(events / n, 6) as event_rate, round(woe, 6) as woe, round(iv_part, 6) as iv_part from woe")
def woe_table(spark, sf_dir):
    return _rounded(_woe(spark, sf_dir), "event_rate", "woe", "iv_part")


@query("information_value", f"with {CELLS}, {LONG}, {CUBE}, {WOE} select segment_col, segment_value, feature, round(sum(iv_part), 6) as iv from woe group by all")
def information_value(spark, sf_dir):
    return _rounded(B.information_value(_woe(spark, sf_dir), CELL), "iv")


PSI = """bins_all as (select distinct s.segment_col, s.segment_value, r.feature, r.bin from cube s join (select feature, bin from cube where segment_col = '__overall__') r using (feature)),
shares as (select a.*, coalesce(c.n, 0) as sn, coalesce(o.n, 0) as rn from bins_all a left join cube c using (segment_col, segment_value, feature, bin)
  left join (select feature, bin, n from cube where segment_col = '__overall__') o using (feature, bin)),
contribs as (select *, (ss - sr) * ln(ss / sr) as contrib from (select *, greatest(sn / sum(sn) over w, 1e-6) as ss, greatest(rn / sum(rn) over w, 1e-6) as sr from shares window w as (partition by segment_col, segment_value, feature))),
psi as (select segment_col, segment_value, feature, sum(contrib) as psi, arg_max(bin, contrib) as worst_bin, cast(sum(case when sn = 0 or rn = 0 then 1 else 0 end) as integer) as empty_bins from contribs group by all)"""


@query("psi_grouping", f"with {CELLS}, {LONG}, {CUBE}, {PSI} select segment_col, segment_value, feature, round(psi, 6) as psi, empty_bins, 'grouping_bins' as psi_method from psi where segment_col = 'channel'")
def psi_grouping(spark, sf_dir):
    obs = _observable(spark, sf_dir)
    out = P.psi_table(M.to_cells(obs, ["channel"], overall=False), obs, ["x1", "x2", "cat"], GROUPING, CELL)
    return _rounded(out.select(*CELL, "feature", "psi", "empty_bins", "psi_method"), "psi")


_DEC = ", ".join(f"{i / 10}e0" for i in range(11))
DECILES = f"""dec as (select list_sort(list_distinct(quantile_cont(x1, [{_DEC}]))) as e from obs),
long as (select segment_col, segment_value, y, 'x1' as feature, case when x1 is null then -1 else len(list_filter(e[2:len(e) - 1], lambda v: v < x1)) end as bin from cells cross join dec)"""


@query("psi_numeric_deciles", f"with {CELLS}, {DECILES}, {CUBE}, {PSI} select segment_col, segment_value, feature, round(psi, 6) as psi, empty_bins, 'numeric_portfolio_deciles' as psi_method from psi where segment_col = 'channel'")
def psi_numeric(spark, sf_dir):
    obs = _observable(spark, sf_dir)
    out = P.psi_table(M.to_cells(obs, ["channel"], overall=False), obs, ["x1"], None, CELL)
    return _rounded(out.select(*CELL, "feature", "psi", "empty_bins", "psi_method"), "psi")


@query("psi_categorical", f"with {CELLS}, long as (select segment_col, segment_value, y, 'cat' as feature, coalesce(cat, '__missing__') as bin from cells), {CUBE}, {PSI} select segment_col, segment_value, feature, round(psi, 6) as psi, empty_bins, 'categorical_levels' as psi_method from psi where segment_col = 'channel'")
def psi_categorical(spark, sf_dir):
    obs = _observable(spark, sf_dir)
    out = P.psi_table(M.to_cells(obs, ["channel"], overall=False), obs, ["cat"], None, CELL)
    return _rounded(out.select(*CELL, "feature", "psi", "empty_bins", "psi_method"), "psi")


@query("out_of_range_share", f"with {CELLS}, b as (select min(x1) as lo, max(x1) as hi from obs where channel = 'tiny') select segment_col, segment_value, 'x1' as feature, round(avg(case when x1 < lo or x1 > hi then 1e0 when x1 is not null then 0e0 end), 6) as out_of_range_share from cells cross join b group by all")
def out_of_range(spark, sf_dir):
    obs = _observable(spark, sf_dir)
    return _rounded(P.out_of_range_share(M.to_cells(obs, ["channel"]), obs.where("channel = 'tiny'"), ["x1"], CELL), "out_of_range_share")


DIAG = f"""ranked as (select s.segment_col, s.segment_value, s.feature, s.woe as a, o.woe as b from woe s join woe o on o.segment_col = '__overall__' and o.feature = s.feature and o.bin = s.bin where s.segment_col = 'channel'),
rr as (select segment_col, segment_value, feature, rank() over (partition by segment_col, segment_value, feature order by a) + (count(*) over (partition by segment_col, segment_value, feature, a) - 1) / 2e0 as ra,
  rank() over (partition by segment_col, segment_value, feature order by b) + (count(*) over (partition by segment_col, segment_value, feature, b) - 1) / 2e0 as rb from ranked),
spear as (select segment_col, segment_value, feature, case when count(*) >= 3 then round(corr(ra, rb), 12) + 0e0 end as woe_spearman from rr group by all),
ivs as (select segment_col, segment_value, feature, sum(iv_part) as iv from woe group by all),
med as (select segment_value, median(x1) as m1, median(x2) as m2 from cells where segment_col = 'channel' group by 1),
uni as (select c.segment_value as seg, 'x1' as feature, coalesce(x1, m1) as v, y from cells c join med using (segment_value) where c.segment_col = 'channel' union all select c.segment_value, 'x2', coalesce(x2, m2), y from cells c join med using (segment_value) where c.segment_col = 'channel'),
{_hist('seg, feature', 'uni', 'least(greatest(v, 1e-6), 1 - 1e-6)', name='uhist')}, ug as (select seg, feature, {GINI} as g from uhist group by all)"""


@query("feature_diagnostics", f"with {CELLS}, {LONG}, {CUBE}, {WOE}, {PSI}, {DIAG} select i.segment_col, i.segment_value, i.feature, round(i.iv, 6) as iv_segment, round(o.iv, 6) as iv_overall, round(woe_spearman, 6) as woe_spearman, coalesce(woe_spearman < 0, false) as rank_reversal, round(g, 6) as univariate_gini_segment, round(psi, 6) as psi from ivs i join ivs o on o.segment_col = '__overall__' and o.feature = i.feature join spear s on s.segment_value = i.segment_value and s.feature = i.feature join psi p on p.segment_value = i.segment_value and p.feature = i.feature left join ug on ug.seg = i.segment_value and ug.feature = i.feature where i.segment_col = 'channel'")
def feature_diagnostics(spark, sf_dir):
    obs = _observable(spark, sf_dir)
    out = P.feature_diagnostics(M.to_cells(obs, ["channel"], overall=False), obs, ["x1", "x2", "cat"], "y", CELL, GROUPING)
    cols = ("iv_segment", "iv_overall", "woe_spearman", "univariate_gini_segment", "psi")
    return _rounded(out.select(*CELL, "feature", "iv_segment", "iv_overall", "woe_spearman", "rank_reversal", "univariate_gini_segment", "psi"), *cols)


VCUBE = f"""{OBS}, long as (select strftime(score_date, '%Y-%m') as vintage, y, 'x1' as feature, {BIN_X1} as bin from obs union all select strftime(score_date, '%Y-%m'), y, 'cat', {BIN_CAT} from obs),
vc as (select *, n * 1e0 / sum(n) over w as share, events / n as event_rate, sum(n) over w as total from (select vintage, feature, bin, count(*) as n, cast(sum(y) as double) as events from long group by all) window w as (partition by vintage, feature)),
vcube as (select * from vc where total >= 30)"""
BOUNDS = """wil as (select *, greatest((r + 2.6896e0 / (2 * n)) / (1 + 2.6896e0 / n) - half, 0) as lo, least((r + 2.6896e0 / (2 * n)) / (1 + 2.6896e0 / n) + half, 1) as hi from (
  select *, event_rate as r, 1.64e0 * sqrt(event_rate * (1 - event_rate) / n + 2.6896e0 / (4e0 * n * n)) / (1 + 2.6896e0 / n) as half from vcube)),
bounds as (select feature, bin, case when count(*) = 1 then min(lo) else min(event_rate) end as lo, case when count(*) = 1 then max(hi) else max(event_rate) end as hi, count(*) as vintages from wil where hi - lo < 0.9e0 group by all)"""


def _vcube(spark, sf_dir):
    return B.vintage_cube(_observable(spark, sf_dir), {f: GROUPING.specs[f] for f in ("x1", "cat")}, "y", "score_date")


@query("vintage_bin_stability", f"with {VCUBE} select vintage, feature, bin, n, events, round(share, 6) as share, round(event_rate, 6) as event_rate from vcube")
def vintage_bins(spark, sf_dir):
    return _rounded(_vcube(spark, sf_dir), "share", "event_rate")


@query("event_rate_bounds", f"with {VCUBE}, {BOUNDS} select feature, bin, round(lo, 6) as lo, round(hi, 6) as hi, vintages from bounds")
def event_rate_bounds(spark, sf_dir):
    return _rounded(B.event_rate_bounds(_vcube(spark, sf_dir)), "lo", "hi")


@query("overlapping_bins", f"with {VCUBE}, {BOUNDS}, o as (select *, lead(bin) over w as next_bin, lead(lo) over w as next_lo, lead(hi) over w as next_hi from bounds join (values ('(-inf, 10]', 0), ('(10, 20]', 1), ('(20, 30]', 2), ('(30, 40]', 3), ('(40, inf)', 4), ('A', 0), ('N|R', 1)) t(bin, place) using (bin) window w as (partition by feature order by place)) select feature, bin, next_bin from o where next_bin is not null and lo <= next_hi and next_lo <= hi")
def overlapping_bins(spark, sf_dir):
    return B.overlapping_pairs(B.event_rate_bounds(_vcube(spark, sf_dir)), {f: GROUPING.specs[f] for f in ("x1", "cat")})


@query("matched_ar", f"""with {CELLS}, ref as (select quantile_cont(pd, 0.85e0) as cut from obs), ra as (select avg(case when pd <= cut then 1e0 else 0e0 end) as ar_reference from obs cross join ref),
seg as (select segment_col, segment_value, avg(case when pd <= cut then 1e0 else 0e0 end) as ar_segment, count(*) as n, sum(y) as b from cells cross join ref where segment_col = 'channel' group by all having count(*) >= 100 and sum(y) >= 10),
gap as (select *, ar_segment - ar_reference as ar_gap, least(ar_segment, ar_reference) as matched from seg cross join ra),
lists as (select segment_col, segment_value, list_sort(list(pd)) as l, (count(*) - 1) as m from cells group by all),
at_ as (select g.segment_value, s.l as sl, s.m * matched as sa, r.l as rl, r.m * matched as rt from gap g join lists s using (segment_col, segment_value) join lists r on r.segment_col = '__overall__' where abs(ar_gap) >= 0.1e0),
cuts as (select segment_value, sl[cast(floor(sa) as bigint) + 1] + (sa - floor(sa)) * (sl[cast(ceil(sa) as bigint) + 1] - sl[cast(floor(sa) as bigint) + 1]) as own from at_),
rcuts as (select segment_value, rl[cast(floor(rt) as bigint) + 1] + (rt - floor(rt)) * (rl[cast(ceil(rt) as bigint) + 1] - rl[cast(floor(rt) as bigint) + 1]) as theirs from at_),
sapp as (select c.segment_value, pd, y from cells c join cuts using (segment_value) where segment_col = 'channel' and pd <= own), {_hist('segment_value', 'sapp', 'pd', name='sh')},
rapp as (select r.segment_value, pd, y from obs join rcuts r on pd <= theirs), {_hist('segment_value', 'rapp', 'pd', name='rh')},
sg as (select segment_value, {GINI} as gs from sh group by 1), rg as (select segment_value, {GINI} as gr from rh group by 1)
select g.segment_col, g.segment_value, round(ar_segment, 6) as ar_segment, round(ar_reference, 6) as ar_reference, round(ar_gap, 6) as ar_gap, abs(ar_gap) >= 0.1e0 as ar_gap_triggered,
  case when ar_gap <= 0 then 'segment' else 'reference' end as ar_anchor, round(gs, 6) as gini_segment_at_matched_ar, round(gr, 6) as gini_reference_at_matched_ar, round(case when abs(gr) >= 0.05e0 then gs / gr end, 6) as gini_at_matched_ar_ratio
from gap g left join sg using (segment_value) left join rg using (segment_value)""")
def matched(spark, sf_dir):
    obs = _observable(spark, sf_dir)
    out = matched_ar(M.to_cells(obs, ["channel"], overall=False), obs, CELL, "y", "pd", GATES)
    cols = ("ar_segment", "ar_reference", "ar_gap", "gini_segment_at_matched_ar", "gini_reference_at_matched_ar", "gini_at_matched_ar_ratio")
    return _rounded(out, *cols).select(*CELL, "ar_segment", "ar_reference", "ar_gap", "ar_gap_triggered", "ar_anchor", *cols[3:])


@query("time_holdout", f"with {CELLS}, t as (select distinct segment_col, segment_value, score_date from cells), r as (select *, row_number() over w - 1 as i, count(*) over (partition by segment_col, segment_value) as k from t window w as (partition by segment_col, segment_value order by score_date)), c as (select segment_col, segment_value, score_date as cutoff from r where k >= 2 and i = least(greatest(cast(floor(k * 0.75e0) as bigint), 1), k - 1)) select segment_col, segment_value, cutoff, count(*) filter (where score_date >= cutoff) as n_holdout, count(*) filter (where score_date < cutoff) as n_train from cells join c using (segment_col, segment_value) group by all")
def time_holdout(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    cut = M.time_holdout_cutoff(cells, CELL, "score_date", 0.25)
    late = F.col("score_date") >= F.col("cutoff")
    return cells.join(cut, CELL).groupBy(*CELL, "cutoff").agg(F.count_if(late).alias("n_holdout"), F.count_if(~late).alias("n_train"))


@query("scalar_transforms", f"with {OBS} select l_orderkey, l_linenumber, x1, round(ln(p / (1 - p)), 6) as logit, round(1 / (1 + exp(-least(greatest(x1 / 10, -30), 30))), 6) as sig, round(p, 6) as clipped, count(*) as n from (select *, least(greatest(pd, 1e-6), 1 - 1e-6) as p from obs) group by all")
def scalar_transforms(spark, sf_dir):
    b = _observable(spark, sf_dir)
    out = b.select("l_orderkey", "l_linenumber", "x1", F.round(logit_transform(F.col("pd")), 6).alias("logit"), F.round(sigmoid(F.col("x1") / 10), 6).alias("sig"), F.round(clipped(F.col("pd")), 6).alias("clipped"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query("wilson_bounds", f"with {OBS}, t as (select channel, cat, count(*) as n, sum(y) as k, avg(y) as r from obs group by all) select channel, cat, n, k, round(greatest((r + 2.6896e0 / (2 * n)) / (1 + 2.6896e0 / n) - 1.64e0 * sqrt(r * (1 - r) / n + 2.6896e0 / (4e0 * n * n)) / (1 + 2.6896e0 / n), 0), 6) as lo, round(least((r + 2.6896e0 / (2 * n)) / (1 + 2.6896e0 / n) + 1.64e0 * sqrt(r * (1 - r) / n + 2.6896e0 / (4e0 * n * n)) / (1 + 2.6896e0 / n), 1), 6) as hi from t")
def wilson_bounds(spark, sf_dir):
    t = _observable(spark, sf_dir).groupBy("channel", "cat").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return _rounded(t.withColumn("lo", lo).withColumn("hi", hi), "lo", "hi")


@query("column_profile", "select l_returnflag as value, count(*) as n_rows, count(distinct l_orderkey) as n_ids from lineitem group by 1")
def column_profile(spark, sf_dir):
    from gradewise.sources.catalogue import column_profile as profile

    return profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_orderkey", sample_limit=None)


@query("dominant_portfolio", "select c_mktsegment as portfolio, count(distinct c_custkey) as n_ids from customer group by 1 order by n_ids desc, portfolio limit 1")
def dominant_portfolio(spark, sf_dir):
    from gradewise.sources.catalogue import fetch_portfolio

    return fetch_portfolio(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_mktsegment", "c_custkey", sample_limit=None).limit(1)


@query("fetch_columns", "select o_orderkey, o_totalprice, o_orderpriority from orders")
def fetch_columns(spark, sf_dir):
    from gradewise.sources.catalogue import fetch_columns_by_id

    return fetch_columns_by_id(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", ["o_totalprice", "o_orderpriority"])


@query("describe_table", "select column_name, case column_type when 'BIGINT' then 'bigint' when 'DOUBLE' then 'double precision' when 'VARCHAR' then 'character varying' when 'INTEGER' then 'integer' else 'timestamp' end as data_type from (describe lineitem)")
def describe_table(spark, sf_dir):
    from gradewise.sources.catalogue import describe_table as describe

    return describe(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query("build_frame", "select o_orderkey, o_custkey, c_name, c_acctbal from orders left join customer on o_custkey = c_custkey")
def build_frame(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    fetched = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    return orders.join(fetched, "c_custkey", "left").select("o_orderkey", F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")


@query("max_psi_by_feature", f"with {CELLS}, {LONG}, {CUBE}, {PSI} select feature, round(max(psi), 6) as max_psi from psi where segment_col = 'channel' and psi >= 0.0001e0 group by feature")
def max_psi(spark, sf_dir):
    obs = _observable(spark, sf_dir)
    out = P.psi_table(M.to_cells(obs, ["channel"], overall=False), obs, ["x1", "x2", "cat"], GROUPING, CELL)
    return _rounded(out.where("psi >= 0.0001").groupBy("feature").agg(F.max("psi").alias("max_psi")), "max_psi")


@query("ranked_segments", f"with s as ({SHARES.format(book=ORACLE_BOOK)}) select segment_value, volume_share, cast(row_number() over (order by important desc, volume_share desc, segment_value) as integer) as rank from s where segment_col = 'channel'")
def ranked_segments(spark, sf_dir):
    order = W.orderBy(F.desc("important"), F.desc("volume_share"), "segment_value")
    return segment_shares(spark, sf_dir).where("segment_col = 'channel'").select("segment_value", "volume_share", F.row_number().over(order).alias("rank"))


SCORECARD_SQL = """
select s.*, 1 / (1 + exp(-LINEAR_SCORE)) as SCORE from (
  select w.*, w.x1_WOE * -0.8 + w.cat_WOE * 0.5 + w.pd_VAL * 0.9 + w.INTERCEPT_ * -0.25 as LINEAR_SCORE from (
    select t.*,
      case when x1 is null then 0.1 when x1 < 10 then 0.9 when x1 < 25 then 0.2 when x1 < 40 then -0.3 when 1=1 then -0.7 end as x1_WOE,
      case when cat is null then 0 when cat = 'A' then 0.4 when cat = 'N' then -0.1 else -0.2 end as cat_WOE,
      coalesce_marker
    from book t) w) s
""".replace("coalesce_marker", "case when pd is null then -2 when 1=1 then ln(pd/(1-pd)) end as pd_VAL, case when 1=1 then 1 end as INTERCEPT_")


@query("scorecard_scores", f"""with {OBS}, w as (select *, case when x1 is null then 0.1e0 when x1 < 10 then 0.9e0 when x1 < 25 then 0.2e0 when x1 < 40 then -0.3e0 else -0.7e0 end as a,
  case when cat is null then 0e0 when cat = 'A' then 0.4e0 when cat = 'N' then -0.1e0 else -0.2e0 end as c, ln(least(greatest(pd, 1e-6), 1 - 1e-6) / (1 - least(greatest(pd, 1e-6), 1 - 1e-6))) as v from obs),
z as (select *, a * -0.8e0 + c * 0.5e0 + v * 0.9e0 - 0.25e0 as l from w)
select channel, cat, count(*) as n, round(avg(a), 6) as avg_x1_woe, round(avg(l), 6) as avg_linear, round(avg(1 / (1 + exp(-l))), 6) as avg_score from z group by channel, cat""")
def scorecard_scores(spark, sf_dir):
    from gradewise.operators.scorecard import parse_scorecard_sql

    scored = parse_scorecard_sql(SCORECARD_SQL).transform_frame(_observable(spark, sf_dir))
    out = scored.groupBy("channel", "cat").agg(F.count("*").alias("n"), F.avg("x1_WOE").alias("avg_x1_woe"), F.avg("LINEAR_SCORE").alias("avg_linear"), F.avg("SCORE").alias("avg_score"))
    return _rounded(out, "avg_x1_woe", "avg_linear", "avg_score")


# --- what SQL cannot express: fitted models, resampling, whole evaluations; tests hold these against plain versions ---


@query("predictor_stability")
def stability_query(spark, sf_dir):
    from gradewise.operators.stability import predictor_stability

    obs = _observable(spark, sf_dir)
    fitted = GROUPING.refresh_stats(obs, "y")
    return predictor_stability(obs, ["x1", "x2", "cat"], "y", "score_date", GATES, fitted)


@query("bootstrap_gini")
def bootstrap_gini(spark, sf_dir):
    from gradewise.operators.refit import bootstrap_ginis

    return bootstrap_ginis(_observable(spark, sf_dir), "y", ["pd"], 100, 42).toDF("replicate", "gini")


@query("fitted_bins")
def fitted_bins(spark, sf_dir):
    model = B.BinningModel.fit(_observable(spark, sf_dir), "y", ["x1", "x2", "cat"], GATES)
    rows = [(f, b, float(s.counts.get(b, 0)), float(s.events.get(b, 0)), float(s.woe.get(b, 0.0))) for f, s in model.specs.items() for b in s.bin_order() if s.counts.get(b)]
    return spark.createDataFrame(rows, "feature string, bin string, n double, events double, woe double")


@query("grouping_comparison")
def grouping_comparison(spark, sf_dir):
    from gradewise.operators.compare import COLUMNS, compare_groupings

    obs = _observable(spark, sf_dir)
    segment = B.BinningModel.fit(obs.where("channel = 'inverted'"), "y", ["x1", "cat"], GATES)
    rows = compare_groupings(segment, GROUPING.refresh_stats(obs, "y"), gates=GATES)
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], "feature string, segment_bin string, portfolio_bin string, kind string, segment_woe double, portfolio_woe double, delta_woe double, significant boolean, note string")


@query("recalibrated_segment")
def recalibrated(spark, sf_dir):
    from gradewise.operators.refit import recalibrate_with_diagnostics

    rows = _observable(spark, sf_dir).where("channel = 'miscal'")
    p = recalibrate_with_diagnostics(rows, "pd", "y").artifact.predict_proba()
    return rows.groupBy("cat").agg(F.count("*").alias("n"), F.avg("y").alias("obs_rate"), F.avg("pd").alias("pd_before"), F.avg(p).alias("pd_after"))


@query("refitted_segment")
def refitted(spark, sf_dir):
    from gradewise.operators.refit import refit_with_diagnostics

    rows = _observable(spark, sf_dir).where("channel = 'inverted'")
    p = refit_with_diagnostics(rows, ["x1", "x2", "cat"], "y", GATES).artifact.predict_proba(rows.columns)
    return M.performance_bundle(rows.withColumn("p_refit", p).withColumn("segment_value", F.col("channel")), ["segment_value"], "y", "p_refit")


@query("segment_decisions")
def segment_decisions(spark, sf_dir):
    from gradewise.plans.evaluate import evaluate_segments
    from gradewise.plans.report import decision_table

    return decision_table(evaluate_segments(book(spark, sf_dir), COLS, GATES, GROUPING.refresh_stats(_observable(spark, sf_dir), "y")))


@query("recommended_actions")
def recommended_actions(spark, sf_dir):
    from gradewise.plans.evaluate import evaluate_portfolio_whatif
    from gradewise.plans.report import recommendations

    return recommendations(evaluate_portfolio_whatif(book(spark, sf_dir), COLS, GATES))
