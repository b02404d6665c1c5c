"""Rescaling of features."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.operators.profile import Roles, collect_stats, missing_as_null

METHODS = ("MinMaxScaler", "StandardScaler", "RobustScaler")


@dataclass(frozen=True)
class Rescaler:
    """(x - shift) / scale for features that are not binary; a constant feature becomes 0.

    MinMax: lowest value and range; Standard: mean and population deviation; Robust: median and interquartile range.
    """

    method: str = "MinMaxScaler"
    roles: Roles = Roles()
    deactivate: bool = False
    factors: dict[str, tuple[float, float]] = field(default_factory=dict)

    def setting(self, **changes) -> Rescaler:
        if unknown := set(changes) - {"method", "roles", "deactivate"}:
            raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **changes)

    def fit(self, df: DataFrame) -> Rescaler:
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")
        if self.deactivate:
            return self
        df = missing_as_null(df)
        factors = {}
        for c, s in collect_stats(df, self.roles.features(df)).items():
            if not s["is_binary"]:
                shift, scale = {
                    "MinMaxScaler": (s["low"], s["high"] - s["low"]),
                    "StandardScaler": (s["mean"], s["variance"] ** 0.5),
                    "RobustScaler": (s["median"], s["q3"] - s["q1"]),
                }[self.method]
                factors[c] = (shift, scale or 1.0)
        return replace(self, factors=factors)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.deactivate:
            return df
        cols = {c: f for c, f in self.factors.items() if c in df.columns}
        return df.withColumns({c: (F.col(c) - F.lit(shift)) / F.lit(scale) for c, (shift, scale) in cols.items()})
