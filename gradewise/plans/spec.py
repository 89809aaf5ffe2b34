"""Column roles and thresholds."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from gradewise.functions.names import looks_like_val_column, map_pred_to_val, map_pred_to_woe

#: The analyses that capability reports know.
ANALYSIS_KEYS = ("segment_performance", "vintage_stability", "matched_ar_gini", "psi_numeric", "psi_grouping", "recalibration", "refit", "submodel", "report")
OVERALL_SEGMENT_COL, OVERALL_SEGMENT_VALUE = "__overall__", "ALL"


@dataclass(frozen=True)
class Gates:
    """Every threshold behind a verdict; the defaults are fixed values of the method."""

    min_n: int = 1000
    min_events: int = 50
    gini_floor: float = 0.25
    gini_ratio_floor: float = 0.80
    oe_lo: float = 0.80
    oe_hi: float = 1.25
    ece_max: float = 0.03
    vintage_gini_ratio_floor: float = 0.70
    holdout_frac: float = 0.25
    min_delta_gini: float = 0.03
    delta_gini_z: float = 1.64
    importance_share_floor: float = 0.05
    psi_woe_material: float = 0.25
    woe_spearman_reversal: float = 0.0
    n_bootstrap: int = 200
    n_ece_bins: int = 10
    n_woe_bins: int = 10
    bootstrap_seed: int = 42
    binning_method: str = "auto"
    binning_min_bin_frac: float = 0.05
    binning_min_bin_events: int = 10
    binning_max_bins: int = 8
    binning_monotonic: bool = True
    binning_monotonic_iv_tolerance: float = 0.20
    submodel_max_depth: int = 3
    grouping_woe_shift_material: float = 0.25
    grouping_edge_shift_frac: float = 0.20
    grouping_sign_flip_floor: float = 0.05
    stability_psi_max: float = 0.25
    stability_gini_ratio_min: float = 0.50
    stability_sign_consistency_min: float = 0.80
    stability_score_min: float = 0.60
    stability_min_vintages: int = 3
    stability_max_weak_vintage_share: float = 0.34
    stability_min_reference_gini: float = 0.05
    stability_merge_overlapping_rates: bool = True
    refit_requires_stability: bool = True
    reference_approval_rate: float = 0.85
    ar_gap_trigger: float = 0.10
    matched_ar_min_n: int = 100
    matched_ar_min_events: int = 10
    n_jobs: int = 1
    max_workers_cap: int = 8


@dataclass(frozen=True)
class ScorecardColumns:
    """Which column plays which part; parts without a column switch their analyses off."""

    col_id: str
    col_date: str | None = None
    col_obs: str | None = None
    col_target: str | None = None
    col_score: str | None = None
    cols_pred: list[str] = field(default_factory=list)
    cols_segment: list[str] = field(default_factory=list)
    col_fantomas: str | None = None
    cols_pred_woe: list[str] = field(default_factory=list)
    cols_pred_used: list[str] = field(default_factory=list)
    pred_map: dict[str, str] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, payload: dict) -> ScorecardColumns:
        """Unknown keys are ignored; nulls stand for empty lists and maps."""
        known = {f.name: payload[f.name] for f in fields(cls) if f.name in payload}
        for name in ("cols_pred", "cols_segment", "cols_pred_woe", "cols_pred_used"):
            known[name] = list(known.get(name) or [])
        known["pred_map"] = dict(known.get("pred_map") or {})
        return cls(**known)

    def pred_woe_map(self) -> dict[str, str]:
        named = {p: w for p, w in self.pred_map.items() if w in self.cols_pred_woe} if self.pred_map else {}
        return named or map_pred_to_woe(self.cols_pred, self.cols_pred_woe)

    def pred_val_map(self) -> dict[str, str]:
        named = {p: v for p, v in self.pred_map.items() if looks_like_val_column(v)}
        rest = [p for p in self.cols_pred if p not in named]
        used = [c for c in self.cols_pred_used if looks_like_val_column(c) and c not in named.values()]
        return named | map_pred_to_val(rest, used)

    def logit_pred_cols(self, grouping=None) -> list[str]:
        """Predictors that enter a model through their logit: by their names, or by the grouping's specs."""
        found = list(self.pred_val_map())
        for name, spec in (grouping.specs.items() if grouping else ()):
            if spec.kind == "logit" and name not in found and name in self.cols_pred:
                found.append(name)
        return found
