"""Decision tables, recommendations and reports from the small result tables."""

from __future__ import annotations

import html
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradewise.plans.evaluate import SegmentEvalResult
from gradewise.plans.spec import Gates

#: The columns of the decision table and the order of actions.
DECISION_COLUMNS = (
    "segment_col", "segment_value", "important", "q1_verdict", "failed_pillars", "q2_action", "q2_reason", "gini", "gini_ratio", "oe", "ece", "volume_share", "default_share", "ar_gap",
    "gini_at_matched_ar", "ar_artifact_suspected", "psi_method", "stability_score", "unstable_predictors",
)
ACTION_PRIORITY = {"SPLIT": 0, "REFIT": 0, "RECALIBRATE": 1, "MONITOR": 2, "KEEP_POOLED": 4, "NONE": 5}
HEADLINES = {
    "SPLIT": "Give {cell} a scorecard of its own", "REFIT": "Refit the scorecard of {cell}", "RECALIBRATE": "Recalibrate the score on {cell}",
    "MONITOR": "Watch {cell}: a refit helps, but its predictors are not stable", "KEEP_POOLED": "Keep the pooled score on {cell}", "NONE": "Too little data to judge {cell}",
}


def decision_table(result: SegmentEvalResult) -> DataFrame:
    return result.decisions.select(*DECISION_COLUMNS).orderBy(F.desc("important"), F.desc("volume_share"))


def action_list(result: SegmentEvalResult) -> DataFrame:
    return decision_table(result).where((F.col("important")) & (F.col("q1_verdict") == "WEAK"))


def recommendations(result: SegmentEvalResult, gates: Gates | None = None) -> DataFrame:
    """``rank, priority, segment_col, segment_value, action, headline, why, evidence``: a row a cell, most urgent first."""
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in ACTION_PRIORITY.items() for x in kv])[F.col("q2_action")], F.lit(6))
    cell = F.when(F.col("segment_col") == "__overall__", "the whole book").otherwise(F.concat_ws(" = ", "segment_col", "segment_value"))
    head = F.lit("Review {cell}")
    for action, text in HEADLINES.items():
        head = F.when(F.col("q2_action") == action, text).otherwise(head)
    number = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("n/a"))
    evidence = F.concat(F.lit("Gini "), number("gini"), F.lit(", observed/expected "), number("oe"), F.lit(", ECE "), number("ece"), F.when(F.col("ar_artifact_suspected"), F.lit("; the weak rank order is gone at a matched approval rate")).otherwise(F.lit("")))
    share = F.greatest(F.coalesce("volume_share", F.lit(0.0)), F.coalesce("default_share", F.lit(0.0)))
    rows = result.decisions.select(order.alias("priority"), "important", share.alias("importance_share"), "segment_col", "segment_value", F.col("q2_action").alias("action"), F.replace(head, F.lit("{cell}"), cell).alias("headline"), F.concat_ws(": ", F.nullif("failed_pillars", F.lit("")), "q2_reason").alias("why"), evidence.alias("evidence"))
    rank = F.row_number().over(W.orderBy("priority", F.desc("important"), F.desc("importance_share"), "segment_col", "segment_value"))
    return rows.select(rank.alias("rank"), *rows.columns).orderBy("rank")


def kpis(result: SegmentEvalResult) -> dict[str, object]:
    """Headline figures: the book's Gini and verdict, the number of segments, and cells by recommended action."""
    d = result.decisions
    overall = F.col("segment_col") == "__overall__"
    counts = [F.count_if(F.col("q2_action") == a).alias(a) for a in ("SPLIT", "REFIT", "RECALIBRATE", "MONITOR")]
    r = d.agg(F.max(F.when(overall, F.col("gini"))).alias("gini"), F.max(F.when(overall, F.col("q1_verdict"))).alias("q1"), F.count_if(~overall).alias("n"), *counts).first()
    rows = result.metrics.where(overall).agg(F.max("n_ttd").alias("rows"), F.max("n").alias("observable")).first()
    return {"Rows": rows["rows"], "Observable": rows["observable"], "Portfolio Gini": r["gini"], "Portfolio Q1": r["q1"] or "-", "Segments": r["n"]} | {a.capitalize(): r[a] for a in ("SPLIT", "REFIT", "RECALIBRATE", "MONITOR")}


def next_actions(result: SegmentEvalResult) -> DataFrame:
    """``action, cells, names``: cells grouped by what to do about them, most urgent first; no row for cells to keep."""
    order = F.create_map(*[F.lit(x) for kv in ACTION_PRIORITY.items() for x in kv])[F.col("action")]
    named = result.decisions.where(~F.col("q2_action").isin("KEEP_POOLED", "NONE")).select(F.col("q2_action").alias("action"), F.concat_ws(" = ", "segment_col", "segment_value").alias("cell"))
    return named.groupBy("action").agg(F.count("*").alias("cells"), F.concat_ws("; ", F.array_sort(F.collect_list("cell"))).alias("names")).orderBy(order, "action")


def _cell(v) -> str:
    return "n/a" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)


def html_safe(text) -> str:
    return html.escape(str(text))


def _rows(df: DataFrame | None) -> tuple[list[str], list]:
    return ([], []) if df is None else (df.columns, df.collect())


def html_table(df: DataFrame | None, columns: list[str] | None = None, empty_message: str = "No rows.") -> str:
    names, rows = _rows(df.select(*[c for c in columns if c in df.columns]) if df is not None and columns else df)
    if not rows:
        return f"<p>{html_safe(empty_message)}</p>"
    head = "".join(f"<th>{html_safe(c)}</th>" for c in names)
    return f"<table><thead><tr>{head}</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{html_safe(_cell(v))}</td>" for v in r) + "</tr>" for r in rows) + "</tbody></table>"


def frozen_html_table(df: DataFrame | None, columns: list[str] | None = None, empty_message: str = "No rows.", index_cols: list[str] | None = None) -> str:
    """A table whose first columns stay in view."""
    return f'<div class="frozen" data-frozen="{len(index_cols or [])}">{html_table(df, columns, empty_message)}</div>'


def markdown_table(df: DataFrame | None) -> str:
    names, rows = _rows(df)
    if not rows:
        return "No rows."
    line = lambda xs: "| " + " | ".join(str(x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *[line(map(_cell, r)) for r in rows]])


def _sections(result: SegmentEvalResult, recs: DataFrame | None) -> list[tuple[str, str, DataFrame | None]]:
    drift = result.characteristics.where("psi >= 0.25").orderBy(F.desc("psi")).drop("psi_bin_table") if result.characteristics is not None else None
    return [
        ("actions", "Recommended actions", recs if recs is not None else recommendations(result)),
        ("verdicts", "Verdicts", decision_table(result)),
        ("performance", "Performance by slice", result.slices),
        ("matched-ar", "Matched approval rate", result.matched_ar.where("ar_gap_triggered")),
        ("drift", "Drifted characteristics", drift),
        ("refit", "Refit and recalibration", result.refit_comparison),
        ("stability", "Predictor stability", result.stability),
        ("vintages", "Vintages", result.vintages.orderBy("segment_col", "segment_value", "vintage") if result.vintages is not None else None),
    ]


def _material(result: SegmentEvalResult, recs: DataFrame | None) -> list[tuple[str, str, DataFrame | None]]:
    """The sections of the condensed report: rows that ask for something, and what speaks for it."""
    d = result.decisions
    asking = d.where(~F.col("q2_action").isin("KEEP_POOLED", "NONE") | F.col("ar_artifact_suspected") | (F.col("important") & (F.col("q1_verdict") == "WEAK"))).select("segment_col", "segment_value")
    shaky = d.where(F.col("failed_pillars").contains("stability")).select("segment_col", "segment_value")
    cell = ["segment_col", "segment_value"]
    only = lambda df, of: df.join(F.broadcast(of), cell, "left_semi") if df is not None else None
    full = {a: (t, df) for a, t, df in _sections(result, recs)}
    worst = result.characteristics.where("psi >= 0.25").groupBy("feature").agg(F.max("psi").alias("max_psi"), F.count("*").alias("cells")).orderBy(F.desc("max_psi")) if result.characteristics is not None else None
    rows = {
        "next": ("Next actions", next_actions(result)),
        "verdicts": ("Cells to act on", only(decision_table(result), asking).orderBy(F.desc("important"), F.desc("volume_share"))),
        "calibration": ("Calibration of cells to act on", only(result.metrics.select(*cell, "n", "defaults", "obs_rate", "mean_pd", "oe", "ece"), asking)),
        "matched-ar": full["matched-ar"],
        "drift": ("Drifted characteristics", worst),
        "refit": full["refit"],
        "vintages": ("Vintages of unstable cells", only(result.vintages, shaky)),
    }
    return [(a, t, df) for a, (t, df) in rows.items()]


STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 7px}.frozen{overflow-x:auto}.frozen td:first-child,.frozen th:first-child{position:sticky;left:0;background:#fff}"


def _page(title: str, body: str) -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html_safe(title)}</title><style>{STYLE}</style></head><body><h1>{html_safe(title)}</h1>{body}</body></html>'


def render_html_report(result: SegmentEvalResult, title: str = "Segment scorecard evaluation", gates: Gates | None = None, recs: DataFrame | None = None) -> str:
    g = "".join(f"<li>{html_safe(k)}: {html_safe(v)}</li>" for k, v in (gates.__dict__ if gates else result.meta["gates"]).items())
    parts = [f'<h2 id="{a}">{k}. {t}</h2>{html_table(df)}' for k, (a, t, df) in enumerate(_sections(result, recs), 1)]
    head = "".join(f"<li>{html_safe(k)}: {html_safe(_cell(v))}</li>" for k, v in kpis(result).items())
    return _page(title, f'<ul class="kpi">{head}</ul>' + "".join(parts) + f"<h2>Thresholds</h2><ul>{g}</ul>")


def render_condensed_html_report(result: SegmentEvalResult, title: str = "Segment scorecard evaluation (condensed)", gates: Gates | None = None, recs: DataFrame | None = None) -> str:
    """A table of contents and only material rows: cells to act on, gaps of 0.10, drift of 0.25, unstable vintages."""
    sections = _material(result, recs)
    toc = "".join(f'<li><a href="#{a}">{t}</a></li>' for a, t, _ in sections)
    return _page(title, f"<ul>{toc}</ul>" + "".join(f'<h2 id="{a}">{t}</h2>{frozen_html_table(df, index_cols=["segment_col", "segment_value"])}' for a, t, df in sections))


def render_markdown_report(result: SegmentEvalResult, title: str = "Segment scorecard evaluation", gates: Gates | None = None, recs: DataFrame | None = None) -> str:
    return f"# {title}\n\n" + "\n\n".join(f"## {t}\n\n{markdown_table(df)}" for _, t, df in _sections(result, recs)) + "\n"


def save_report(result: SegmentEvalResult, path: str, fmt: str | None = None, title: str = "Segment scorecard evaluation", gates: Gates | None = None) -> str:
    """Writes the report; the format follows the name: ``*condensed*.html``, Markdown, else HTML."""
    name = os.path.basename(path).lower()
    fmt = fmt or ("condensed" if "condensed" in name and name.endswith((".html", ".htm")) else "md" if name.endswith((".md", ".markdown", ".txt")) else "html")
    render = {"condensed": render_condensed_html_report, "md": render_markdown_report, "markdown": render_markdown_report}.get(fmt, render_html_report)
    if os.path.dirname(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(result, title=title, gates=gates))
    return path
