"""Bin specifications that compile to columns, and their fitting on aggregated histograms."""

from __future__ import annotations

import copy
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.functions.columns import MISSING, OTHER, finite, logit_transform, vintage
from gradewise.plans.spec import Gates

WOE_EPS = 0.5
INF = math.inf


def edge_text(x: float, digits: int = 6) -> str:
    return "-inf" if x == -INF else "inf" if x == INF else f"%.{digits}g" % x


def edge_labels(edges: list[float], closed: str = "right") -> list[str]:
    """Interval labels; more digits where six give equal ones, numbered bins as a last resort."""
    for digits in (6, 12):
        text = [edge_text(e, digits) for e in edges]
        pairs = list(zip(text, text[1:], strict=False))
        if closed == "left":
            out = [f"[{a}, {b})" for a, b in pairs]
        else:
            out = [f"({a}, {b})" if b == "inf" else f"({a}, {b}]" for a, b in pairs]
        if len(set(out)) == len(out) and len(set(text)) == len(text):
            return out
    return [f"bin_{i:02d}" for i in range(len(edges) - 1)]


def numeric_bin(c: Column, edges: list[float], labels: list, closed: str = "right", missing=MISSING) -> Column:
    """The label (or value) of the interval that holds ``c``; ``missing`` where ``c`` is no finite number."""
    x = finite(c.try_cast("double"))
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges[1:-1], labels[:-1], strict=True))):
        out = F.when(x < edge if closed == "left" else x <= edge, label).otherwise(out)
    return F.when(x.isNull(), missing).otherwise(out)


@dataclass
class BinSpec:
    """The grouping of one feature."""

    feature: str
    kind: str  # numeric, categorical, mixed or logit
    method: str
    edges: list[float] | None = None
    groups: dict[str, list[str]] | None = None
    labels: list[str] = field(default_factory=list)
    woe: dict[str, float] = field(default_factory=dict)
    counts: dict[str, float] = field(default_factory=dict)
    events: dict[str, float] = field(default_factory=dict)
    iv: float = float("nan")
    monotonic: bool = False
    missing_label: str = MISSING
    notes: list[str] = field(default_factory=list)
    closed: str = "right"
    impute: float | None = None
    transform: str | None = None
    output_name: str | None = None
    rules: list[dict] | None = None

    def _by_rules(self, c: Column, key: str) -> Column:
        number, text = finite(c.try_cast("double")), c.cast("string")
        tests = {"null": lambda v: c.isNull(), "eq": lambda v: text == F.lit(str(v)), "lt": lambda v: number < v, "le": lambda v: number <= v, "gt": lambda v: number > v, "ge": lambda v: number >= v, "else": lambda v: F.lit(True)}
        out = F.lit(None).cast("double" if key == "woe" else "string")
        for rule in reversed(self.rules):
            out = F.when(tests[rule["op"]](rule.get("value")), F.lit(rule[key])).otherwise(out)
        return out

    def _by_groups(self, c: Column, otherwise: Column, of=str) -> Column:
        out = otherwise
        for label, members in reversed(list((self.groups or {}).items())):
            plain = [m for m in members if m != MISSING]
            hit = c.cast("string").isin(plain) if plain else F.lit(False)
            out = F.when(hit | (c.isNull() if MISSING in members else F.lit(False)), of(label)).otherwise(out)
        return out

    def assign(self, c: Column) -> Column:
        """The bin label of a value."""
        if self.kind == "logit":
            return F.when(finite(c.try_cast("double")).isNull(), MISSING).otherwise("logit")
        if self.rules:
            return F.coalesce(self._by_rules(c, "label"), F.lit(OTHER))
        return self._bin(c, str)

    def _bin(self, c: Column, of) -> Column:
        """One CASE that gives ``of(label)``."""
        values = [of(x) for x in self.interval_labels()]
        missing, other = F.lit(of(MISSING)), F.lit(of(OTHER))
        if self.kind == "mixed":
            number = finite(c.try_cast("double"))
            inner = F.when(number.isNotNull(), numeric_bin(c, self.edges, values, self.closed, of(MISSING))).otherwise(other) if self.edges else other
            return F.when(c.isNull(), missing).otherwise(self._by_groups(c, inner, of))
        if self.kind == "numeric" and self.edges:
            return numeric_bin(c, self.edges, values, self.closed, of(MISSING))
        known = any(MISSING in m for m in (self.groups or {}).values())
        return self._by_groups(c, other, of) if known else F.when(c.isNull(), missing).otherwise(self._by_groups(c, other, of))

    def transform_woe(self, c: Column) -> Column:
        """The weight of evidence (or logit) of a value."""
        if self.kind == "logit":
            return logit_transform(c.try_cast("double"), self.impute)
        if self.rules:
            return self._by_rules(c, "woe")
        default = float(self.woe.get(OTHER, 0.0))
        return self._bin(c, lambda label: float(self.woe.get(label, default)))

    def interval_labels(self) -> list[str]:
        if not self.edges:
            return []
        named = [x for x in self.labels if x not in (MISSING, OTHER) and x not in (self.groups or {})]
        return named if len(named) == len(self.edges) - 1 else edge_labels(self.edges, self.closed)

    def bin_order(self) -> list[str]:
        order = [*self.interval_labels(), *(self.groups or {})]
        order += [x for x in (*self.labels, *self.counts) if x not in order]
        return [x for x in dict.fromkeys(order) if x not in (MISSING, OTHER)] + [MISSING, OTHER]

    def to_dict(self) -> dict:
        return {k: _plain(v) for k, v in self.__dict__.items()}

    @classmethod
    def from_dict(cls, payload: dict) -> BinSpec:
        return cls(**{k: _numbers(v) if k in ("edges", "iv", "impute", "woe", "counts", "events") else v for k, v in payload.items() if k in cls.__dataclass_fields__})


def _plain(x):
    """JSON has no infinities: they and NaN are written as text."""
    if isinstance(x, float) and not math.isfinite(x):
        return "nan" if math.isnan(x) else edge_text(x)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def _numbers(x):
    if isinstance(x, dict):
        return {k: _numbers(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_numbers(v) for v in x]
    return float(x) if isinstance(x, str) else x


class BinningModel:
    """An ordered set of bin specifications."""

    def __init__(self, specs: dict[str, BinSpec] | None = None, gates: Gates | None = None):
        self.specs, self.gates = dict(specs or {}), gates or Gates()

    def closed(self, feature: str) -> str:
        return self.specs[feature].closed

    def bin_frame(self, df: DataFrame) -> DataFrame:
        return df.select(*[(s.assign(F.col(f)) if f in df.columns else F.lit(MISSING)).alias(f) for f, s in self.specs.items()])

    def transform(self, df: DataFrame) -> DataFrame:
        """Weights of evidence in the order of the specs; a column that is not there gives 0."""
        return df.select(*[(s.transform_woe(F.col(f)) if f in df.columns else F.lit(0.0)).alias(s.output_name or f) for f, s in self.specs.items()])

    transform_woe = transform

    def iv_table(self) -> list[dict]:
        return [{"feature": f, "kind": s.kind, "method": s.method, "n_bins": len([x for x in s.bin_order() if s.counts.get(x)]), "iv": s.iv, "monotonic": s.monotonic, "notes": "; ".join(s.notes)} for f, s in self.specs.items()]

    def clone(self) -> BinningModel:
        return BinningModel(copy.deepcopy(self.specs), self.gates)

    def to_dict(self) -> dict:
        return {"version": 1, "specs": {f: s.to_dict() for f, s in self.specs.items()}}

    @classmethod
    def from_dict(cls, payload: dict) -> BinningModel:
        specs = payload.get("specs", payload.get("features", {}))
        return cls({f: BinSpec.from_dict(s) for f, s in specs.items()})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2)

    @classmethod
    def load(cls, path: str) -> BinningModel:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    @classmethod
    def fit(cls, df: DataFrame, y: str, features: list[str] | None = None, gates: Gates | None = None, n_jobs: int | None = None, date_col: str | None = None) -> BinningModel:
        """Bins of every feature from one job over all of them; ``n_jobs`` is accepted and Spark schedules."""
        gates = gates or Gates()
        names = features or [c for c in df.columns if c not in (y, date_col)]
        return cls({f: fit_from_histogram(f, *h, gates) for f, h in value_histograms(df, names, y).items()}, gates)

    def refresh_stats(self, df: DataFrame, y: str) -> BinningModel:
        """New counts, events and weights on other rows; logit features stay as they are."""
        out = self.clone()
        names = [f for f, s in out.specs.items() if s.kind != "logit" and f in df.columns]
        got = {(r["feature"], r["bin"]): r for r in woe_table(bin_cube(df, {f: out.specs[f] for f in names}, y, [])).collect()}
        for f in names:
            s = out.specs[f]
            rows = {b: r for (g, b), r in got.items() if g == f}
            s.counts = {b: float(r["n"]) for b, r in rows.items()}
            s.events = {b: float(r["events"]) for b, r in rows.items()}
            s.woe = {b: 0.0 for b in s.bin_order()} | {b: r["woe"] for b, r in rows.items()}
            s.iv = sum(r["iv_part"] for r in rows.values())
        return out


def save_grouping(model: BinningModel, path: str) -> None:
    model.save(path)


def load_grouping(path: str) -> BinningModel:
    return BinningModel.load(path)


def grouping_from_dict(payload: dict) -> BinningModel:
    return BinningModel.from_dict(payload)


def bin_cube(df: DataFrame, specs: dict[str, BinSpec], y: str, keys: list[str]) -> DataFrame:
    """``keys, feature, bin, n, events``: all features in one pass, unpivoted before one aggregation."""
    pairs = [F.struct(F.lit(f).alias("feature"), s.assign(F.col(f)).alias("bin")) for f, s in specs.items()]
    rows = df.select(*keys, F.col(y).cast("double").alias("y_"), F.explode(F.array(*pairs)).alias("x_"))
    return rows.groupBy(*keys, "x_.feature", "x_.bin").agg(F.count("*").alias("n"), F.sum("y_").alias("events"))


def woe_table(cube: DataFrame, keys: list[str] | None = None, eps: float = WOE_EPS) -> DataFrame:
    """Adds ``non_events, event_rate, woe, iv_part``: positive weights are safer."""
    keys = [*(keys or []), "feature"]
    totals = cube.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.sum("events").alias("e_all"))
    t = cube.join(totals, keys)
    bad = (F.col("events") + eps) / F.greatest(F.col("e_all") + 1, F.lit(1.0))
    good = (F.col("n") - F.col("events") + eps) / F.greatest(F.col("n_all") - F.col("e_all") + 1, F.lit(1.0))
    woe = F.ln(good / bad)
    return t.select(*keys, "bin", "n", "events", (F.col("n") - F.col("events")).alias("non_events"), (F.col("events") / F.col("n")).alias("event_rate"), woe.alias("woe"), ((good - bad) * woe).alias("iv_part"))


def information_value(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return table.groupBy(*(keys or []), "feature").agg(F.sum("iv_part").alias("iv"))


# --- fitting: one distributed histogram, then small work on the driver -----------------------------------------------


#: Distinct values of a feature that reach the driver; beyond them numeric values are counted in so many quantile steps.
MOST_VALUES = 5000


def value_histograms(df: DataFrame, features: list[str], y: str) -> dict[str, tuple[bool, list[tuple]]]:
    """For each feature whether it is numeric (type, and over two distinct values), and (value, n, events) ascending."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [f for f in features if isinstance(types[f], T.NumericType)]
    distinct = df.agg(*[F.approx_count_distinct(finite(F.col(f)) if f in numeric else F.col(f)).alias(f"d{i}") for i, f in enumerate(features)]).first()
    size = {f: distinct[f"d{i}"] for i, f in enumerate(features)}
    steps = {f: df.agg(F.percentile_approx(finite(F.col(f)), F.array(*[F.lit(i / MOST_VALUES) for i in range(MOST_VALUES + 1)]), 20_000)).first()[0] for f in numeric if size[f] > MOST_VALUES}
    pairs = []
    for f in features:
        c = finite(F.col(f)) if f in numeric else F.col(f)
        if f in steps:
            known = F.array(*[F.lit(v) for v in sorted(set(steps[f]))])
            c = F.when(c.isNotNull(), F.element_at(known, F.greatest(F.size(F.filter(known, lambda e: e <= c)), F.lit(1))))
        pairs.append(F.struct(F.lit(f).alias("feature"), c.cast("double").alias("v") if f in numeric else F.lit(None).cast("double").alias("v"), F.lit(None).cast("string").alias("s") if f in numeric else c.cast("string").alias("s")))
    rows = df.select(F.col(y).cast("double").alias("y_"), F.explode(F.array(*pairs)).alias("x_")).groupBy("x_.feature", "x_.v", "x_.s").agg(F.count("*").alias("n"), F.sum("y_").alias("e"))
    out = {f: (f in numeric and size[f] > 2, []) for f in features}
    for r in rows.collect():
        value = r["v"] if r["feature"] in numeric else r["s"]
        out[r["feature"]][1].append((value if value is None or out[r["feature"]][0] else str(value), r["n"], r["e"]))
    for _, h in out.values():
        h.sort(key=lambda t: (t[0] is None, t[0] if t[0] is not None else 0))
    return out


def _gain(n: float, e: float) -> float:
    return 2 * e * (n - e) / n if n else 0.0


def tree_edges(hist: list[tuple], gates: Gates) -> list[float] | None:
    """Thresholds of a one-feature classification tree grown best first: Gini impurity, bounded leaves and depth."""
    total, events = sum(h[1] for h in hist), sum(h[2] for h in hist)
    if total < 10 or not 0 < events < total or len(hist) < 3:
        return None
    depth, leaves = math.ceil(math.log2(gates.binning_max_bins)), gates.binning_max_bins
    least = min(max(math.ceil(gates.binning_min_bin_frac * total), 10), total / 2)

    def split(lo: int, hi: int):
        n, e = sum(h[1] for h in hist[lo:hi]), sum(h[2] for h in hist[lo:hi])
        best, ln, le = None, 0, 0
        for i in range(lo, hi - 1):
            ln, le = ln + hist[i][1], le + hist[i][2]
            if ln >= least and n - ln >= least:
                drop = _gain(n, e) - _gain(ln, le) - _gain(n - ln, e - le)
                if drop > 1e-12 and (best is None or drop > best[0] + 1e-12):
                    best = (drop, i + 1)
        return best

    open_, cuts = [(0, len(hist), 0, split(0, len(hist)))], []
    while len(open_) < leaves:
        able = [x for x in open_ if x[3] and x[2] < depth]
        if not able:
            break
        x = max(able, key=lambda t: t[3][0])
        open_.remove(x)
        at = x[3][1]
        cuts.append((hist[at - 1][0] + hist[at][0]) / 2)
        open_ += [(a, b, x[2] + 1, split(a, b)) for a, b in ((x[0], at), (at, x[1]))]
    return [-INF, *sorted(cuts), INF] if cuts else None


def quantile_edges(hist: list[tuple], n_bins: int) -> list[float] | None:
    total, found = sum(h[1] for h in hist), []
    upto, k = [], 0
    for h in hist:
        k += h[1]
        upto.append(k)
    value = lambda i: next(h[0] for h, u in zip(hist, upto, strict=True) if u > i)
    for b in range(n_bins + 1):
        at = (total - 1) * b / n_bins
        lo, hi = value(math.floor(at)), value(math.ceil(at))
        found.append(lo + (at - math.floor(at)) * (hi - lo))
    inner = sorted(set(found))
    return [-INF, *inner[1:-1], INF] if len(inner) >= 3 else None


def _per_bin(hist: list[tuple], edges: list[float]) -> list[list[float]]:
    out = [[0, 0] for _ in edges[1:]]
    for v, n, e in hist:
        k = next(i for i, b in enumerate(edges[1:]) if v <= b)
        out[k][0] += n
        out[k][1] += e
    return out


def merge_sparse(hist: list[tuple], edges: list[float], gates: Gates, total: float) -> list[float]:
    """Drops edges until every bin has rows, events and non-events enough, weakest bin first; two bins remain."""
    edges = list(edges)
    floor = gates.binning_min_bin_frac * total
    short = lambda b: min(b[0] / max(floor, 1), b[1] / max(gates.binning_min_bin_events, 1), (b[0] - b[1]) / max(gates.binning_min_bin_events, 1))
    while len(edges) > 3:
        bins = _per_bin(hist, edges)
        k = min(range(len(bins)), key=lambda i: short(bins[i]))
        if short(bins[k]) >= 1:
            break
        left = k > 0 and (k == len(bins) - 1 or bins[k - 1][0] <= bins[k + 1][0])
        del edges[k if left else k + 1]
    return edges


def _woes(bins: list[list[float]], n: float, e: float) -> tuple[list[float], float]:
    woe, iv = [], 0.0
    for m, k in bins:
        good, bad = (m - k + WOE_EPS) / max(n - e + 1, 1), (k + WOE_EPS) / max(e + 1, 1)
        woe.append(math.log(good / bad))
        iv += (good - bad) * woe[-1]
    return woe, iv


def make_monotonic(hist: list[tuple], edges: list[float], gates: Gates, n: float, e: float) -> tuple[list[float], bool, list[str]]:
    """Merges neighbours that break the weighted trend; kept only if the information value holds up."""
    bins = _per_bin(hist, edges)
    woe, before = _woes(bins, n, e)
    weight = sum(b[0] for b in bins)
    mid = sum(i * b[0] for i, b in enumerate(bins)) / weight
    way = 1 if sum(b[0] * (i - mid) * w for i, (b, w) in enumerate(zip(bins, woe, strict=True))) >= 0 else -1
    tried = list(edges)
    while len(tried) > 3:
        w = _woes(_per_bin(hist, tried), n, e)[0]
        breaks = [(way * (w[i] - w[i + 1]), i) for i in range(len(w) - 1) if way * (w[i + 1] - w[i]) < 0]
        if not breaks:
            break
        del tried[max(breaks)[1] + 1]
    after_woe, after = _woes(_per_bin(hist, tried), n, e)
    if all(way * (b - a) >= 0 for a, b in zip(after_woe, after_woe[1:], strict=False)) and after >= (1 - gates.binning_monotonic_iv_tolerance) * before:
        return tried, True, []
    return list(edges), False, ["monotonicity_not_feasible"]


def group_levels(hist: list[tuple], gates: Gates, n: float, e: float) -> dict[str, list[str]]:
    """Levels in order of their weight, joined until each group is large enough and there are few enough."""
    floor = gates.binning_min_bin_frac * n
    order = sorted((h for h in hist if h[0] is not None), key=lambda h: (_woes([[h[1], h[2]]], n, e)[0][0], h[0]))
    groups: list[list] = []
    for v, m, k in order:
        if groups and (groups[-1][1] < floor or groups[-1][2] < gates.binning_min_bin_events):
            groups[-1] = [[*groups[-1][0], v], groups[-1][1] + m, groups[-1][2] + k]
        else:
            groups.append([[v], m, k])
    join = lambda i: groups.__setitem__(slice(i, i + 2), [[groups[i][0] + groups[i + 1][0], groups[i][1] + groups[i + 1][1], groups[i][2] + groups[i + 1][2]]])
    if len(groups) > 1 and (groups[-1][1] < floor or groups[-1][2] < gates.binning_min_bin_events):
        join(len(groups) - 2)
    while len(groups) > gates.binning_max_bins:
        join(min(range(len(groups) - 1), key=lambda i: groups[i][1] + groups[i + 1][1]))
    named = {}
    for i, (members, _, _) in enumerate(groups):
        label = "|".join(members)
        named[label if len(label) <= 60 else f"grp_{i:02d}"] = members
    return named


def fit_from_histogram(feature: str, numeric: bool, hist: list[tuple], gates: Gates) -> BinSpec:
    n, e = sum(h[1] for h in hist), sum(h[2] for h in hist)
    known = [h for h in hist if h[0] is not None]
    spec = BinSpec(feature, "categorical", "categorical")
    edges = None
    if numeric and known:
        edges, method = (None, "") if gates.binning_method == "quantile" else (tree_edges(known, gates), "tree")
        if edges is None:
            edges, method = quantile_edges(known, gates.n_woe_bins), "quantile"
        if edges:
            edges = merge_sparse(known, edges, gates, n)
            spec.kind, spec.method = "numeric", method
            if gates.binning_monotonic:
                edges, spec.monotonic, spec.notes = make_monotonic(known, edges, gates, n, e)
            spec.edges, spec.labels = edges, edge_labels(edges)
            bins = dict(zip(spec.labels, _per_bin(known, edges), strict=True))
        else:
            known, spec.method = [(str(v), m, k) for v, m, k in known], "degenerate"
    if not edges:
        spec.groups = group_levels(known, gates, n, e)
        spec.labels = list(spec.groups)
        where = {v: g for g, vs in spec.groups.items() for v in vs}
        bins = {g: [0, 0] for g in spec.groups}
        for v, m, k in known:
            bins[where[v]][0] += m
            bins[where[v]][1] += k
    if len(known) < len(hist):
        bins[MISSING] = [sum(h[1] for h in hist if h[0] is None), sum(h[2] for h in hist if h[0] is None)]
    woe, spec.iv = _woes(list(bins.values()), n, e)
    spec.woe = dict(zip(bins, woe, strict=True)) | {x: 0.0 for x in (MISSING, OTHER) if x not in bins}
    spec.counts, spec.events = {b: float(v[0]) for b, v in bins.items()}, {b: float(v[1]) for b, v in bins.items()}
    return spec


def fit_bin_spec(df: DataFrame, feature: str, y: str, gates: Gates | None = None) -> BinSpec:
    return BinningModel.fit(df, y, [feature], gates).specs[feature]


def vintage_cube(df: DataFrame, specs: dict[str, BinSpec], y: str, date: str, freq: str = "M", min_rows: int = 30) -> DataFrame:
    """``vintage, feature, bin, n, events, share, event_rate`` of vintages with ``min_rows`` rows at least."""
    dated = df.withColumn("vintage", vintage(F.col(date), freq)).where("vintage is not null")
    cube = bin_cube(dated, specs, y, ["vintage"])
    totals = cube.groupBy("vintage", "feature").agg(F.sum("n").alias("rows"))
    joined = cube.join(totals, ["vintage", "feature"]).where(F.col("rows") >= min_rows)
    return joined.select("vintage", "feature", "bin", "n", "events", (F.col("n") / F.col("rows")).alias("share"), (F.col("events") / F.col("n")).alias("event_rate"))


def event_rate_bounds(cube: DataFrame, z: float = 1.64, widest: float = 0.9) -> DataFrame:
    """``feature, bin, lo, hi``: the least and largest rate over vintages whose Wilson interval is narrow enough; with
    one such vintage its interval."""
    from gradewise.functions.columns import wilson

    low, high = wilson(F.col("events"), F.col("n"), z)
    usable = cube.withColumn("w_lo", low).withColumn("w_hi", high).where((F.col("w_hi") - F.col("w_lo")) < widest)
    one = F.count("*") == 1
    return usable.groupBy("feature", "bin").agg(F.when(one, F.min("w_lo")).otherwise(F.min("event_rate")).alias("lo"), F.when(one, F.max("w_hi")).otherwise(F.max("event_rate")).alias("hi"), F.count("*").alias("vintages"))


def overlapping_pairs(bounds: DataFrame, specs: dict[str, BinSpec]) -> DataFrame:
    """``feature, bin, next_bin`` of neighbours whose bounds share a point."""
    from pyspark.sql import Window as W

    order = bounds.sparkSession.createDataFrame([(f, b, i) for f, s in specs.items() if s.kind != "logit" for i, b in enumerate(x for x in s.bin_order() if x not in (MISSING, OTHER))], "feature string, bin string, place int")
    w = W.partitionBy("feature").orderBy("place")
    placed = bounds.join(F.broadcast(order), ["feature", "bin"])
    nxt = placed.select("feature", "bin", "lo", "hi", F.lead("bin").over(w).alias("next_bin"), F.lead("lo").over(w).alias("next_lo"), F.lead("hi").over(w).alias("next_hi"))
    return nxt.where("next_bin is not null and lo <= next_hi and next_lo <= hi").select("feature", "bin", "next_bin")
