"""From a table's name to roles, capabilities, settings and an analysis frame."""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.operators.scorecard import ScorecardSQLModel, parse_scorecard_sql, parse_scorecard_sql_path
from gradewise.plans.spec import ANALYSIS_KEYS, ScorecardColumns
from gradewise.sources import catalogue

# Portfolios with their target and observation columns, and the names that stand for roles.
PORTFOLIO_TARGET_MAP = {"PortfolioA": ("TargetA", "TargetAObs"), "PortfolioB": ("TargetB", "TargetBObs"), "PortfolioC": ("TargetC", "TargetCObs")}
DATE_COLUMN_CANDIDATES = ("DATE_DECISION", "SCORE_DATE", "DTIME_DECISION", "APPLICATION_DATE")
PORTFOLIO_COLUMN_CANDIDATES = ("PORTFOLIO", "NAME_PORTFOLIO")
SEGMENT_COLUMN_CANDIDATES = ("PRODUCT", "CHANNEL", "SEGMENT", "NAME_PRODUCT", "CODE_SEGMENT")
DATE_TYPE_TOKENS = ("date", "timestamp", "datetime")
MAX_SEGMENT_CARDINALITY = 30
SETTINGS_VERSION = 1

TEMPLATES = {
    "describe_table": "SELECT column_name, data_type FROM columns WHERE lower(table_name) = lower('{table_name}') ORDER BY ordinal_position",
    "column_profile": "SELECT {column} AS value, COUNT(*) AS n_rows, COUNT(DISTINCT {col_id}) AS n_ids FROM (SELECT {column}, {col_id} FROM {table} LIMIT {sample_limit}) s GROUP BY {column} ORDER BY n_rows DESC",
    "fetch_portfolio": "SELECT {column} AS portfolio, COUNT(DISTINCT {col_id}) AS n_ids FROM (SELECT {column}, {col_id} FROM {table} LIMIT {sample_limit}) s GROUP BY {column} ORDER BY n_ids DESC",
    "fetch_columns_by_id": "SELECT {col_id}, {columns} FROM {table}",
}


class MetadataInferenceWarning(UserWarning):
    """A role was inferred, not given."""


def target_for_portfolio(portfolio: str | None) -> tuple[str, str] | None:
    return PORTFOLIO_TARGET_MAP.get(portfolio) if portfolio else None


def target_from_obs(target_obs: str | None) -> str | None:
    return next((t for t, o in PORTFOLIO_TARGET_MAP.values() if o == target_obs), target_obs[:-3] if target_obs and target_obs.endswith("Obs") else None)


def obs_from_target(target: str | None) -> str | None:
    return next((o for t, o in PORTFOLIO_TARGET_MAP.values() if t == target), f"{target}Obs" if target else None)


def known_targets() -> list[str]:
    return [t for t, _ in PORTFOLIO_TARGET_MAP.values()]


def known_obs_flags() -> list[str]:
    return [o for _, o in PORTFOLIO_TARGET_MAP.values()]


def available_queries() -> list[str]:
    return sorted(TEMPLATES)


def read_sql_template(name: str) -> str:
    if name not in TEMPLATES:
        raise KeyError(f"no SQL template {name!r}; there are {available_queries()}")
    return TEMPLATES[name]


def split_table(table: str) -> tuple[str, str]:
    """Schema and name of ``db.schema.name``; the schema may be empty."""
    parts = table.split(".")
    return (parts[-2] if len(parts) > 1 else ""), parts[-1]


def render_sql(name: str, **params) -> str:
    """A template with its parameters, and both named in comments for audit."""
    text = read_sql_template(name)
    missing = sorted(set(re.findall(r"\{(\w+)\}", text)) - set(params))
    if missing:
        raise KeyError(f"{name} lacks {missing}")
    shown = {k: ", ".join(v) if isinstance(v, (list, tuple)) else v for k, v in params.items()}
    return f"-- query: {name}\n{text.format(**shown)}\n-- params: {json.dumps(params, sort_keys=True, default=str)}"


def parse_sql_metadata(sql: str) -> dict:
    name, params = re.search(r"-- query: (\w+)", sql), re.search(r"-- params: (\{.*\})", sql)
    return {"query": name[1] if name else None, "params": json.loads(params[1]) if params else {}}


class SqlExecutor:
    """Runs SQL text on a session and keeps a log; columns may be hidden from the catalogue."""

    def __init__(self, spark: SparkSession, hidden_columns: tuple[str, ...] = ()):
        self.spark, self.hidden, self.queries = spark, {c.lower() for c in hidden_columns}, []

    def __call__(self, sql: str) -> DataFrame:
        self.queries.append(sql)
        return self.spark.sql("\n".join(x for x in sql.split("\n") if not x.startswith("--")))

    execute = __call__

    def register(self, name: str, frame: DataFrame) -> None:
        frame.createOrReplaceTempView(name)

    def frame_for(self, table: str) -> DataFrame:
        df = self.spark.table(table)
        return df.select(*[c for c in df.columns if c.lower() not in self.hidden])


FakeSqlExecutor = SqlExecutor


@dataclass
class CapabilityReport:
    available: list[str]
    blocked: dict[str, str]

    def is_available(self, analysis: str) -> bool:
        return analysis in self.available

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, "available" if k in self.available else "blocked", self.blocked.get(k, "")) for k in ANALYSIS_KEYS]
        return spark.createDataFrame(rows, "analysis string, status string, reason string")

    def render_text(self) -> str:
        return "\n".join(f"{k}: " + ("available" if k in self.available else f"blocked ({self.blocked[k]})") for k in ANALYSIS_KEYS)


@dataclass
class ResolvedMetadata:
    table: str
    columns: ScorecardColumns
    portfolio: str | None = None
    grouping_path: str | None = None
    sources: dict[str, str] = field(default_factory=dict)
    catalogue: dict[str, str] = field(default_factory=dict)
    model: ScorecardSQLModel | None = None

    @property
    def grouping(self):
        return self.model.grouping if self.model else None

    def _with(self, prefix: str) -> list[str]:
        return [k for k, v in self.sources.items() if v.startswith(prefix)]

    def inferred_fields(self) -> list[str]:
        return self._with("inferred")

    def supplied_fields(self) -> list[str]:
        return self._with("supplied")

    def missing_fields(self) -> list[str]:
        return self._with("missing")

    def to_dict(self) -> dict:
        return {"version": SETTINGS_VERSION, "table": self.table, "columns": asdict(self.columns), "portfolio": self.portfolio, "grouping_path": self.grouping_path, "sources": self.sources, "catalogue": self.catalogue}

    @classmethod
    def from_dict(cls, payload: dict) -> ResolvedMetadata:
        known = {f.name for f in fields(cls)}
        return cls(**{k: ScorecardColumns.from_dict(v) if k == "columns" else v for k, v in payload.items() if k in known})


def _first(candidates, names: dict[str, str]) -> str | None:
    return next((names[c.lower()] for c in candidates if c.lower() in names), None)


def resolve_metadata(table: str, col_id: str, col_score: str, cols_pred_used: list[str] | None = None, executor: SqlExecutor | None = None, col_date=None, cols_segment=None, col_target=None, target_str=None, col_obs=None, target_obs=None, cols_pred=None, cols_pred_woe=None, col_fantomas=None, portfolio=None, grouping_path=None, sample_limit: int | None = 100_000, warn: bool = True, model_sql: str | None = None, model_sql_path: str | None = None) -> ResolvedMetadata:
    """Roles given, else inferred from the catalogue; each inference warns and is written down.

    The date: a known name, else the first date column. Segments: known names with few values (one aggregate for all).
    The target: given, from the observation flag, from the dominant portfolio, else the first known one that exists.
    """
    model = parse_scorecard_sql(model_sql) if model_sql else parse_scorecard_sql_path(model_sql_path) if model_sql_path else None
    if not table or not col_id or not col_score or not (cols_pred_used or model):
        raise ValueError("table, col_id, col_score and cols_pred_used (or a scorecard SQL) are needed")
    executor = executor or SqlExecutor(SparkSession.getActiveSession())
    df = executor.frame_for(table)
    types = dict(df.dtypes)
    names, sources = {c.lower(): c for c in df.columns}, {}

    def note(name: str, given, found, how: str = "catalogue"):
        value = given if given else found
        sources[name] = "supplied" if given else f"inferred:{how}" if found else "missing"
        if not given and found and warn:
            warnings.warn(f"{name} was not given; using {found}", MetadataInferenceWarning, stacklevel=3)
        return value

    date = note("col_date", col_date, _first(DATE_COLUMN_CANDIDATES, names) or next((c for c, t in types.items() if t.startswith(DATE_TYPE_TOKENS)), None))
    tried = [names[c.lower()] for c in SEGMENT_COLUMN_CANDIDATES if c.lower() in names]
    sample = df.limit(sample_limit) if sample_limit else df
    counts = sample.agg(*[F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(tried)]).first() if tried and not cols_segment else None
    segments = note("cols_segment", cols_segment, [c for i, c in enumerate(tried) if counts[f"c{i}"] <= MAX_SEGMENT_CARDINALITY] if counts else [])
    portfolio_col = _first(PORTFOLIO_COLUMN_CANDIDATES, names)
    top = catalogue.fetch_portfolio(df, portfolio_col, col_id, sample_limit).first() if portfolio_col and not portfolio else None
    portfolio = note("portfolio", portfolio, top["portfolio"] if top else None)
    target, flag = col_target or target_str, col_obs or target_obs
    pair = target_for_portfolio(portfolio)
    guess = target_from_obs(flag) or (pair[0] if pair else None)
    if not guess or guess.lower() not in names:
        guess = _first(known_targets(), names)
    target = note("col_target", target, guess, "portfolio" if pair else "catalogue")
    guess = obs_from_target(target)
    flag = note("col_obs", flag, guess if guess and guess.lower() in names else _first(known_obs_flags(), names), "target")
    model_lists = (model.cols_pred, model.cols_pred_woe, model.cols_pred_used) if model else ([], [], [])
    pred, woe, used = (note(n, given, found, "sql_model") for n, given, found in zip(("cols_pred", "cols_pred_woe", "cols_pred_used"), (cols_pred, cols_pred_woe, cols_pred_used), model_lists, strict=True))
    sources["grouping_path"] = "supplied" if grouping_path else "inferred:sql_model" if model else "missing"
    columns = ScorecardColumns(col_id, date, flag, target, col_score, list(pred or []), list(segments or []), col_fantomas, list(woe or []), list(used or []), dict(model.pred_map) if model else {})
    return ResolvedMetadata(table, columns, portfolio, grouping_path, sources, {c: catalogue.type_name(t) for c, t in types.items()}, model)


def _missing(pairs) -> str:
    return ", ".join(n for n, ok in pairs if not ok) or "nothing"


def resolve_capabilities(meta: ResolvedMetadata) -> CapabilityReport:
    """Which analyses the roles allow, and why the others are blocked; evaluation itself never asks."""
    c = meta.columns
    has = {"col_score": bool(c.col_score), "col_target": bool(c.col_target), "cols_segment": bool(c.cols_segment), "col_date": bool(c.col_date), "cols_pred": bool(c.cols_pred), "cols_pred_woe": bool(c.cols_pred_woe)}
    needs = {
        "segment_performance": ("col_score", "col_target", "cols_segment"), "vintage_stability": ("col_score", "col_target", "col_date"), "matched_ar_gini": ("col_score", "col_target", "cols_segment"),
        "recalibration": ("cols_pred_woe", "col_score", "col_target"), "refit": ("cols_pred", "col_target", "col_date"), "report": ("col_score", "col_target", "cols_segment"),
    }
    blocked = {k: f"missing: {_missing([(n, has[n]) for n in names])}" for k, names in needs.items() if not all(has[n] for n in names)}
    if not (has["col_target"] and (c.cols_pred_used or c.cols_pred)):
        blocked["psi_numeric"] = "needs predictors and col_target"
    if not (meta.grouping or meta.grouping_path) or not has["cols_pred"]:
        blocked["psi_grouping"] = "needs a grouping and cols_pred"
    blocked["submodel"] = "needs a boosting package, cols_pred, col_target and col_date"
    return CapabilityReport([k for k in ANALYSIS_KEYS if k not in blocked], blocked)


def render_metadata_summary(meta: ResolvedMetadata) -> str:
    lines = [f"table: {meta.table}", f"portfolio: {meta.portfolio}"]
    lines += [f"{k}: {v} [{meta.sources.get(k, 'supplied')}]" for k, v in meta.columns.as_dict().items()]
    return "\n".join([*lines, resolve_capabilities(meta).render_text()])


@dataclass
class ConfirmationResult:
    confirmed: bool
    settings_path: str | None
    how: str


def confirm_settings(meta: ResolvedMetadata, auto_confirm: bool | None = None, prompt=None, settings_path: str | None = None, save: bool = True, display_fn=None) -> ConfirmationResult:
    """Shows the roles and asks; with ``auto_confirm``, or nobody to ask, they count as confirmed."""
    (display_fn or print)(render_metadata_summary(meta))
    auto = auto_confirm if auto_confirm is not None else prompt is None
    yes = auto or str(prompt("Use these settings? [Y/n] ")).strip().lower() in ("", "y", "yes")
    if yes and save and settings_path:
        save_settings(meta, settings_path)
    return ConfirmationResult(yes, settings_path if yes and save else None, "auto" if auto else "prompt")


def save_settings(meta: ResolvedMetadata, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(meta.to_dict(), f, indent=2)
    return path


def load_settings(path: str) -> ResolvedMetadata:
    with open(path, encoding="utf-8") as f:
        payload = json.load(f)
    if payload.get("version", 0) > SETTINGS_VERSION:
        warnings.warn("settings were written by a newer version", MetadataInferenceWarning, stacklevel=2)
    return ResolvedMetadata.from_dict(payload)


def required_columns(meta: ResolvedMetadata) -> list[str]:
    c = meta.columns
    return list(dict.fromkeys(x for x in [c.col_id, c.col_date, c.col_obs, c.col_target, c.col_score, c.col_fantomas, *c.cols_segment, *c.cols_pred, *c.cols_pred_woe, *c.cols_pred_used] if x))


def build_analysis_frame(meta: ResolvedMetadata, executor: SqlExecutor, base: DataFrame | None = None, warn: bool = True) -> DataFrame:
    """``base`` with the columns that it lacks, joined by id from the table; what the scorecard can compute is computed.

    Only missing columns are read. Ids that repeat in the table multiply rows, as a left join does.
    """
    table, made = executor.frame_for(meta.table), set()
    if meta.model:
        made = {*meta.model.pred_map.values(), meta.columns.col_score}
    wanted = [c for c in required_columns(meta) if base is None or c not in base.columns]
    fetch = [c for c in wanted if c in table.columns and (c not in made or c == meta.columns.col_id)]
    absent = [c for c in wanted if c not in table.columns and c not in made]
    if absent and warn:
        warnings.warn(f"columns that are nowhere: {absent}", MetadataInferenceWarning, stacklevel=2)
    rows = catalogue.fetch_columns_by_id(table, meta.columns.col_id, fetch)
    out = rows if base is None else base.join(rows, meta.columns.col_id, "left") if fetch else base
    if meta.model:
        scored = meta.model.transform_frame(out, score_col="score_", linear_col="linear_")
        new = {a: F.col(a) for a in meta.model.pred_map.values() if a not in out.columns}
        if meta.columns.col_score not in out.columns:
            new[meta.columns.col_score] = F.col("score_")
        out = scored.select(*out.columns, *[v.alias(k) for k, v in new.items()])
    return out
