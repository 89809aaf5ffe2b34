"""A weight-of-evidence encoder over fitted bins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from gradewise.operators.bins import BinningModel
from gradewise.plans.spec import Gates


class WoEEncoder:
    """``fit`` learns bins and weights, ``transform`` adds up to columns of weights; ``n_bins`` is the most bins a
    feature gets where no gates are given. ``edges_``, ``woe_`` and ``columns_`` hold what was learned."""

    def __init__(self, n_bins: int = 10, gates: Gates | None = None, method: str | None = None, n_jobs: int | None = None):
        gates = gates or Gates(n_woe_bins=n_bins, binning_max_bins=max(int(n_bins), 2))
        self.n_bins, self.gates = n_bins, replace(gates, binning_method=method) if method else gates
        self.model_: BinningModel | None = None
        self.columns_: list[str] = []

    @property
    def edges_(self) -> dict[str, list[float] | None]:
        return {c: self.to_grouping().specs[c].edges for c in self.columns_}

    @property
    def woe_(self) -> dict[str, dict[str, float]]:
        return {c: dict(self.to_grouping().specs[c].woe) for c in self.columns_}

    def _hold(self, model: BinningModel) -> WoEEncoder:
        self.model_, self.columns_ = model, list(model.specs)
        return self

    def fit(self, df: DataFrame, y: str, columns: list[str] | None = None) -> WoEEncoder:
        """Bins of ``columns`` (all but ``y`` by default) of ``df``."""
        return self._hold(BinningModel.fit(df, y, columns or [c for c in df.columns if c != y], self.gates))

    def to_grouping(self) -> BinningModel:
        if self.model_ is None:
            raise ValueError("the encoder is not fitted")
        return self.model_

    def transform(self, df: DataFrame) -> DataFrame:
        return self.to_grouping().transform(df)

    def bin_frame(self, df: DataFrame) -> DataFrame:
        return self.to_grouping().bin_frame(df)

    @classmethod
    def from_grouping(cls, model: BinningModel) -> WoEEncoder:
        gates = model.gates or Gates()
        return cls(gates.binning_max_bins, gates)._hold(model)
