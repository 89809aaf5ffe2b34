"""Comparing, merging and recovering groupings; bins are few, so this is driver work on aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.functions.columns import MISSING, OTHER, finite
from gradewise.functions.names import VAL_AFFIXES, WOE_AFFIXES, strip_affix
from gradewise.operators.bins import INF, BinningModel, BinSpec, edge_labels, vintage_cube
from gradewise.plans.spec import Gates

COLUMNS = ("feature", "segment_bin", "portfolio_bin", "kind", "segment_woe", "portfolio_woe", "delta_woe", "significant", "note")


def resolve_portfolio_spec(feature: str, portfolio_grouping: BinningModel | None, pred_woe_map: dict[str, str] | None = None) -> BinSpec | None:
    """The book's spec of a feature: by name, output name, map, or a stem that one spec alone has."""
    if portfolio_grouping is None:
        return None
    specs = portfolio_grouping.specs
    if feature in specs:
        return specs[feature]
    named = [s for s in specs.values() if s.output_name == feature or (pred_woe_map or {}).get(s.feature) == feature or (pred_woe_map or {}).get(feature) in (s.feature, s.output_name) and s.output_name]
    stems = [s for f, s in specs.items() if strip_affix(f, WOE_AFFIXES + VAL_AFFIXES) == strip_affix(feature, WOE_AFFIXES + VAL_AFFIXES)]
    return named[0] if named else stems[0] if len(stems) == 1 else None


def _row(feature: str, mine, theirs, kinds: list[str], a: float | None, b: float | None, note: str = "") -> dict:
    delta = None if a is None or b is None else a - b
    return dict(zip(COLUMNS, (feature, mine, theirs, "+".join(kinds) or "aligned", a, b, delta, bool(kinds), note), strict=True))


def _weights(a: float | None, b: float | None, g: Gates) -> list[str]:
    if a is None or b is None:
        return []
    flip = a * b < 0 and min(abs(a), abs(b)) >= g.grouping_sign_flip_floor
    return ["woe_sign_flip"] if flip else ["woe_shift"] if abs(a - b) >= g.grouping_woe_shift_material else []


def compare_bin_specs(segment_spec: BinSpec, portfolio_spec: BinSpec | None, gates: Gates | None = None) -> list[dict]:
    """A row for each segment bin, and one for each split book bin: how the segment's grouping departs from the book's."""
    g, f = gates or Gates(), segment_spec.feature
    if portfolio_spec is None:
        return [_row(f, None, None, ["no_portfolio_spec"], None, None)]
    if (segment_spec.kind == "logit") != (portfolio_spec.kind == "logit") or bool(segment_spec.edges) != bool(portfolio_spec.edges):
        return [_row(f, segment_spec.kind, portfolio_spec.kind, ["form_change"], None, None)]
    if segment_spec.kind == "logit":
        return [_row(f, "logit", "logit", [], None, None)]
    rows, hits = [], {}
    if segment_spec.edges:
        bins = lambda s: list(zip(s.interval_labels(), s.edges, s.edges[1:], strict=False))
        for label, lo, hi in bins(segment_spec):
            over = [p for p in bins(portfolio_spec) if lo < p[2] and p[1] < hi]
            kinds = ["merged"] if len(over) > 1 else []
            a = segment_spec.woe.get(label)
            if not over:
                rows.append(_row(f, label, None, ["unmatched"], a, None))
                continue
            size = lambda p: min(hi, p[2]) - max(lo, p[1])
            best = max(over, key=lambda p: (size(p), -p[1]))
            width = best[2] - best[1]
            moved = [abs(x - y) for x, y in ((lo, best[1]), (hi, best[2])) if math.isfinite(x) and math.isfinite(y)]
            if not kinds and moved and math.isfinite(width) and width > 0 and max(moved) >= g.grouping_edge_shift_frac * width:
                kinds.append("edge_shift")
            b = portfolio_spec.woe.get(best[0])
            rows.append(_row(f, label, "; ".join(p[0] for p in over), kinds + _weights(a, b, g), a, b))
            for p in over:
                hits.setdefault(p[0], []).append(label)
    else:
        where = {m: label for label, members in (portfolio_spec.groups or {}).items() for m in members}
        for label, members in (segment_spec.groups or {}).items():
            theirs = list(dict.fromkeys(where.get(m, OTHER) for m in members))
            whole = {m for t in theirs for m in (portfolio_spec.groups or {}).get(t, [])}
            kinds = (["merged"] if len(theirs) > 1 else []) + (["membership_change"] if set(members) != whole else [])
            a, b = segment_spec.woe.get(label), portfolio_spec.woe.get(theirs[0])
            rows.append(_row(f, label, "; ".join(theirs), kinds + _weights(a, b, g), a, b))
            for t in theirs:
                hits.setdefault(t, []).append(label)
    rows += [_row(f, "; ".join(mine), p, ["split"], None, portfolio_spec.woe.get(p)) for p, mine in hits.items() if len(mine) > 1]
    return rows


def compare_groupings(segment_grouping: BinningModel, portfolio_grouping: BinningModel | None, pred_woe_map: dict[str, str] | None = None, gates: Gates | None = None) -> list[dict]:
    return [r for f, s in segment_grouping.specs.items() for r in compare_bin_specs(s, resolve_portfolio_spec(f, portfolio_grouping, pred_woe_map), gates)]


def bin_spec_from_woe_column(df: DataFrame, raw: str, woe: str, feature: str | None = None, gates: Gates | None = None) -> BinSpec | None:
    """The bins behind a WoE column: one a distinct weight, edges midway between neighbouring ranges of the raw values."""
    g = gates or Gates()
    name, most = feature or raw, max(3 * g.binning_max_bins, 4)
    rows = df.select(F.round(finite(F.col(woe)), 9).alias("w"), F.col(raw).alias("v")).where("w is not null")
    number = dict(df.dtypes)[raw] not in ("string", "boolean")
    known = rows.where(F.col("v").isNotNull())
    span = known.groupBy("w").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.col("v").cast("string"))).alias("members") if not number else F.lit(None).alias("members")).limit(most + 1).collect()
    if not 2 <= len(span) <= most:
        return None
    missing = rows.where(F.col("v").isNull()).agg(F.max("w")).first()[0]
    extra = {MISSING: float(missing if missing is not None else 0.0), OTHER: 0.0}
    if not number:
        groups = {"|".join(r["members"]) if len("|".join(r["members"])) <= 60 else f"grp_{i:02d}": r["members"] for i, r in enumerate(span)}
        woes = {label: float(r["w"]) for label, r in zip(groups, span, strict=True)}
        return BinSpec(name, "categorical", "from_woe", groups=groups, labels=list(groups), woe=woes | extra, output_name=woe)
    span.sort(key=lambda r: r["lo"])
    if any(a["hi"] >= b["lo"] for a, b in zip(span, span[1:], strict=False)):
        return None
    edges = [-INF, *[(a["hi"] + b["lo"]) / 2 for a, b in zip(span, span[1:], strict=False)], INF]
    labels = edge_labels(edges)
    return BinSpec(name, "numeric", "from_woe", edges=edges, labels=labels, woe={x: float(r["w"]) for x, r in zip(labels, span, strict=True)} | extra, counts={x: float(r["n"]) for x, r in zip(labels, span, strict=True)}, output_name=woe)


def grouping_from_woe_columns(df: DataFrame, pred_woe_map: dict[str, str], gates: Gates | None = None) -> BinningModel:
    found = {p: bin_spec_from_woe_column(df, p, w, gates=gates) for p, w in pred_woe_map.items() if p in df.columns and w in df.columns}
    return BinningModel({p: s for p, s in found.items() if s is not None}, gates)


def _bounds(counts: dict[str, list[tuple[float, float]]], z: float) -> dict[str, tuple[float, float]]:
    out = {}
    for label, pairs in counts.items():
        usable = []
        for n, e in pairs:
            r, zz = e / n, z * z
            mid, half = (r + zz / (2 * n)) / (1 + zz / n), z * math.sqrt(r * (1 - r) / n + zz / (4 * n * n)) / (1 + zz / n)
            if min(1, mid + half) - max(0, mid - half) < 0.9:
                usable.append((r, max(0, mid - half), min(1, mid + half)))
        if usable:
            out[label] = usable[0][1:] if len(usable) == 1 else (min(u[0] for u in usable), max(u[0] for u in usable))
    return out


def merge_overlapping(df: DataFrame, model: BinningModel, y: str, date_col: str, freq: str = "M", min_rows: int = 30, z: float = 1.64, rounds: int = 40) -> BinningModel:
    """Merges the first neighbouring bins whose vintage rates overlap, again and again; two bins remain.

    One job counts (feature, bin, vintage); merging adds those counts up on the driver, with no further scan.
    """
    out = model.clone()
    specs = {f: s for f, s in out.specs.items() if s.kind != "logit" and not s.rules and f in df.columns}
    counts: dict[str, dict[str, dict[str, list[float]]]] = {f: {} for f in specs}
    for r in vintage_cube(df, specs, y, date_col, freq, min_rows).select("feature", "bin", "vintage", "n", "events").collect():
        counts[r["feature"]].setdefault(r["bin"], {})[r["vintage"]] = [r["n"], r["events"]]
    changed = False
    for f, s in specs.items():
        for _ in range(rounds):
            order = [b for b in s.bin_order() if b not in (MISSING, OTHER)]
            bounds = _bounds({b: [tuple(v) for v in counts[f].get(b, {}).values()] for b in order}, z)
            pair = next(((i, a, b) for i, (a, b) in enumerate(zip(order, order[1:], strict=False)) if a in bounds and b in bounds and bounds[a][0] <= bounds[b][1] and bounds[b][0] <= bounds[a][1]), None)
            if pair is None or len(order) <= 2:
                break
            i, a, b = pair
            if s.edges:
                del s.edges[i + 1]
                s.labels = edge_labels(s.edges, s.closed)
                label = s.labels[i]
            else:
                label = f"{a}|{b}" if len(f"{a}|{b}") <= 60 else f"grp_{i:02d}m"
                s.groups = {label if k == a else k: [*v, *s.groups[b]] if k == a else v for k, v in s.groups.items() if k != b}
                s.labels = list(s.groups)
            joined: dict[str, list[float]] = {}
            for part in (counts[f].pop(a, {}), counts[f].pop(b, {})):
                for v, (n, e) in part.items():
                    have = joined.setdefault(v, [0, 0])
                    have[0], have[1] = have[0] + n, have[1] + e
            counts[f][label] = joined
            s.notes.append(f"merged_overlapping_event_rates:{a}+{b}")
            changed = True
    return out.refresh_stats(df, y) if changed else out


merge_overlapping_event_rate_bounds = merge_overlapping
