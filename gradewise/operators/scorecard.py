"""Scorecards written as SQL: parsing into bins and coefficients, scoring as columns, rendering back."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.functions.columns import MISSING, OTHER, sigmoid
from gradewise.functions.names import looks_like_val_column
from gradewise.operators.bins import INF, BinningModel, BinSpec, edge_labels
from gradewise.plans.spec import ScorecardColumns

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
CASE = re.compile(r"\bcase\b((?:(?!\bcase\b).)*?)\bend\s+as\s+\"?(\w+)\"?", re.I | re.S)
BRANCH = re.compile(r"\bwhen\b(.*?)\bthen\b(.*?)(?=\bwhen\b|\belse\b|\Z)", re.I | re.S)
ELSE = re.compile(r"\belse\b(.*)\Z", re.I | re.S)
TERM = re.compile(rf"([-+]?)\s*(?:\w+\.)?\"?(\w+)\"?\s*\*\s*\(?\s*({NUMBER})\s*\)?")
LOGIT = re.compile(rf"(?:(?:nvl|coalesce)\s*\(\s*)?\bln\s*\(.*?\)\s*\)?(?:\s*,\s*({NUMBER})\s*\))?\s*\Z", re.I | re.S)
COMPARISONS = {"<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def strip_comments(sql: str) -> str:
    return re.sub(r"--[^\n]*", " ", re.sub(r"/\*.*?\*/", " ", sql, flags=re.S))


def _condition(text: str) -> tuple[str | None, dict | None]:
    """The raw column and the rule of one WHEN condition; (None, None) if it is not known."""
    t = text.strip().strip("()").strip()
    if re.fullmatch(r"1\s*=\s*1", t):
        return None, {"op": "else"}
    if m := re.fullmatch(r"(?:\w+\.)?\"?(\w+)\"?\s+is\s+null", t, re.I):
        return m[1], {"op": "null"}
    if m := re.fullmatch(r"(?:\w+\.)?\"?(\w+)\"?\s*=\s*'((?:[^']|'')*)'", t, re.S):
        return m[1], {"op": "eq", "value": m[2].replace("''", "'")}
    if m := re.fullmatch(rf"(?:\w+\.)?\"?(\w+)\"?\s*(<=|>=|<|>)\s*({NUMBER})", t):
        return m[1], {"op": COMPARISONS[m[2]], "value": float(m[3])}
    return None, None


@dataclass
class ScorecardSQLModel:
    """A parsed scorecard: what it reads, its bins, its coefficients."""

    cols_pred: list[str]
    cols_pred_woe: list[str]
    cols_pred_used: list[str]
    pred_map: dict[str, str]
    coefficients: dict[str, float]
    intercept: float
    grouping: BinningModel
    formula: str
    source_table: str | None = None
    notes: list[str] = field(default_factory=list)

    def to_columns(self, col_id: str, **kwargs) -> ScorecardColumns:
        return ScorecardColumns(col_id=col_id, cols_pred=list(self.cols_pred), cols_pred_woe=list(self.cols_pred_woe), cols_pred_used=list(self.cols_pred_used), pred_map=dict(self.pred_map), **kwargs)

    def linear(self, columns: list[str]) -> Column:
        """The linear score; a spec whose raw column is absent counts as a null value."""
        out = F.lit(float(self.intercept))
        for raw, alias in self.pred_map.items():
            if alias in self.coefficients:
                value = F.col(raw) if raw in columns else F.lit(None).cast("string")
                out = out + self.grouping.specs[raw].transform_woe(value) * F.lit(self.coefficients[alias])
        return out

    def predict_proba(self, df: DataFrame) -> Column:
        return sigmoid(self.linear(df.columns))

    def transform_frame(self, df: DataFrame, score_col: str = "SCORE", linear_col: str = "LINEAR_SCORE") -> DataFrame:
        """Adds every transformed predictor, the linear score and the probability."""
        new = {a: self.grouping.specs[r].transform_woe(F.col(r) if r in df.columns else F.lit(None).cast("string")) for r, a in self.pred_map.items()}
        z = self.linear(df.columns)
        return df.withColumns(new | {linear_col: z, score_col: sigmoid(z)})

    def to_sql(self, table: str | None = None, score_alias: str | None = None) -> str:
        return render_scorecard_sql(self.grouping, self.coefficients, table or self.source_table or "_SOURCETABLENAME_", score_alias or "SCORE", self.pred_map, intercept=self.intercept)

    def save_grouping(self, path: str) -> None:
        self.grouping.save(path)

    def to_dict(self) -> dict:
        return {k: v.to_dict() if isinstance(v, BinningModel) else v for k, v in self.__dict__.items()}


def _spec(alias: str, body: str) -> tuple[str | None, BinSpec | None, float | None, list[str]]:
    """Raw column, spec, constant (for an intercept) and notes of one CASE."""
    notes, rules, raw, impute, logit = [], [], None, None, False
    branches = [(c, v) for c, v in BRANCH.findall(body)]
    if m := ELSE.search(BRANCH.sub(" ", body) if not branches else body[body.lower().rfind("else") :] if re.search(r"\belse\b", body, re.I) else ""):
        branches.append(("1=1", m[1]))
    for condition, value in branches:
        name, rule = _condition(condition)
        raw = raw or name
        if rule is None:
            notes.append(f"unknown condition: {condition.strip()}")
            continue
        v = value.strip()
        if re.fullmatch(NUMBER, v):
            if rule["op"] == "null" and logit or rule["op"] in ("null", "else") and impute is None and looks_like_val_column(alias):
                impute = float(v)
            rules.append(rule | {"woe": float(v)})
        elif re.search(r"\bln\s*\(", v, re.I):
            logit = True
            inner = LOGIT.search(v)
            if inner and inner[1]:
                impute = float(inner[1])
            if not raw and (m := re.search(r"ln\s*\(\s*\(?\s*(?:\w+\.)?\"?([A-Za-z_]\w*)", v, re.I)):
                raw = m[1]
        else:
            notes.append(f"unknown value: {v}")
    if logit:
        return raw, BinSpec(raw, "logit", "sql", transform="logit", impute=impute, output_name=alias, notes=notes), None, notes
    if raw is None:
        return None, None, rules[0]["woe"] if rules else None, notes
    numbers = sorted({r["value"] for r in rules if r["op"] in COMPARISONS.values()})
    texts = [r["value"] for r in rules if r["op"] == "eq"]
    kind = "mixed" if numbers and texts else "numeric" if numbers else "categorical"
    edges = [-INF, *numbers, INF] if numbers else None
    labels = edge_labels(edges, "left") if edges else []
    for r in rules:
        if r["op"] in ("lt", "le"):
            r["label"] = labels[numbers.index(r["value"])]
        elif r["op"] in ("gt", "ge"):
            r["label"] = labels[numbers.index(r["value"]) + 1]
        else:
            r["label"] = {"null": MISSING, "else": OTHER}.get(r["op"]) or str(r["value"])
    if edges and any(r["op"] == "else" for r in rules):
        # after rising upper bounds the rest is the last interval
        free = [x for x in labels if x not in {r["label"] for r in rules}]
        for r in rules:
            if r["op"] == "else" and free == labels[-1:] and kind == "numeric":
                r["label"] = labels[-1]
    woe = {r["label"]: r["woe"] for r in reversed(rules)}
    return raw, BinSpec(raw, kind, "sql", edges=edges, groups={t: [t] for t in texts} or None, labels=labels, woe=woe, closed="left", output_name=alias, rules=rules, notes=notes), None, notes


def parse_scorecard_sql(sql: str) -> ScorecardSQLModel:
    """Reads CASE blocks and the linear combination; ValueError if either is absent.

    A raw column that feeds two aliases keeps the last. A term after a minus sign counts negative.
    """
    text = strip_comments(sql)
    specs, pred_map, constants, notes = {}, {}, {}, []
    for m in CASE.finditer(text):
        raw, spec, constant, said = _spec(m[2], m[1])
        notes += said
        if spec is not None and raw:
            if raw in specs:
                notes.append(f"{raw} feeds several columns; the last counts")
            specs[raw], pred_map[raw] = spec, m[2]
        elif constant is not None:
            constants[m[2].lower()] = constant
    if not specs:
        raise ValueError("no CASE ... END AS alias block found")
    end = re.search(r"\bas\s+\"?linear_score\"?", text, re.I)
    head = text[: end.start()] if end else text
    head = head[max((m.end() for m in re.finditer(r"\bselect\b|\bend\s+as\s+\"?\w+\"?\s*,?", head, re.I)), default=0) :]
    aliases = {a.lower(): a for a in pred_map.values()}
    coefficients, intercept = {}, 0.0
    for sign, alias, number in TERM.findall(head):
        value = float(number) * (-1 if sign == "-" else 1)
        if alias.lower() in aliases:
            coefficients[aliases[alias.lower()]] = value
        elif alias.lower() in constants or "intercept" in alias.lower():
            intercept += value * constants.get(alias.lower(), 1.0)
    if not coefficients:
        raise ValueError("no alias * coefficient terms before LINEAR_SCORE")
    tables = re.findall(r"\bfrom\s+([\w.\"`]+)", text, re.I)
    used = list(coefficients)
    formula = " + ".join([f"{intercept:.6g}", *[f"{c:.6g} * {a}" for a, c in coefficients.items()]])
    woe = [a for a in pred_map.values() if not looks_like_val_column(a)]
    return ScorecardSQLModel(list(pred_map), woe, used, pred_map, coefficients, intercept, BinningModel(specs), formula, tables[-1] if tables else None, notes)


def parse_scorecard_sql_path(path: str) -> ScorecardSQLModel:
    with open(path, encoding="utf-8") as f:
        return parse_scorecard_sql(f.read())


def _num(x: float) -> str:
    return f"{x:.17g}" if x == x and abs(x) != INF else "0"


def _case(raw: str, alias: str, s: BinSpec) -> str:
    col, lines = f'"{raw}"', []
    text = lambda v: "'" + str(v).replace("'", "''") + "'"
    if s.kind == "logit":
        rest = _num(s.impute) if s.impute is not None else "NULL"
        return f"CASE WHEN {col} > 0 AND {col} < 1 THEN ln({col}/(1-{col})) ELSE {rest} END AS \"{alias}\""
    if s.rules:
        signs = {v: k for k, v in COMPARISONS.items()}
        for r in s.rules:
            test = "1=1" if r["op"] == "else" else f"{col} IS NULL" if r["op"] == "null" else f"{col} = {text(r['value'])}" if r["op"] == "eq" else f"{col} {signs[r['op']]} {_num(r['value'])}"
            lines.append(f"WHEN {test} THEN {_num(r['woe'])}")
        return f"CASE {' '.join(lines)} END AS \"{alias}\""
    lines.append(f"WHEN {col} IS NULL THEN {_num(s.woe.get(MISSING, s.woe.get(OTHER, 0.0)))}")
    for label, members in (s.groups or {}).items():
        lines += [f"WHEN {col} = {text(m)} THEN {_num(s.woe.get(label, 0.0))}" for m in members if m != MISSING]
    labels = s.interval_labels()
    sign = "<" if s.closed == "left" else "<="
    lines += [f"WHEN {col} {sign} {_num(e)} THEN {_num(s.woe.get(x, 0.0))}" for e, x in zip((s.edges or [])[1:-1], labels[:-1], strict=False)]
    rest = s.woe.get(labels[-1], 0.0) if labels else s.woe.get(OTHER, 0.0)
    return f"CASE {' '.join(lines)} ELSE {_num(rest)} END AS \"{alias}\""


def render_scorecard_sql(grouping: BinningModel, coefficients: dict[str, float] | None = None, table: str = "_SOURCETABLENAME_", score_alias: str = "SCORE", pred_map: dict[str, str] | None = None, pred_woe_map: dict[str, str] | None = None, intercept: float | None = None) -> str:
    """Nested SELECTs: a CASE for each feature, the linear score, its sigmoid."""
    names = {f: (pred_map or {}).get(f) or (pred_woe_map or {}).get(f) or s.output_name or f + ("_VAL" if s.kind == "logit" else "_WOE") for f, s in grouping.specs.items()}
    weights = coefficients or {}
    terms = [f'w."{a}" * {_num(weights.get(a, weights.get(f, 0.0)))}' for f, a in names.items() if a in weights or f in weights]
    cases = [_case(f, names[f], s) for f, s in grouping.specs.items()] + ['CASE WHEN 1=1 THEN 1 END AS "INTERCEPT_"']
    linear = " + ".join([*terms, f'w."INTERCEPT_" * {_num(intercept or 0.0)}'])
    return f"SELECT s.*, 1/(1+exp(-s.LINEAR_SCORE)) AS {score_alias}\nFROM (\n  SELECT w.*, {linear} AS LINEAR_SCORE\n  FROM (\n    SELECT t.*,\n      " + ",\n      ".join(cases) + f"\n    FROM {table} t\n  ) w\n) s"
