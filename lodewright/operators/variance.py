"""Features that hardly vary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.operators.profile import Roles, collect_stats, feature_stats, missing_as_null

CURVE = tuple(round(0.05 * i, 2) for i in range(20))


def variance_curve(df: DataFrame, cols: Sequence[str], thresholds: Sequence[float] = CURVE) -> DataFrame:
    """(`threshold`, `n_features`): how many features a threshold keeps; binary features are always kept."""
    stats = feature_stats(df, cols)
    kept = F.col("is_binary") | (F.coalesce(F.col("variance"), F.lit(0.0)) > F.col("threshold"))
    marks = F.explode(F.array(*map(F.lit, map(float, thresholds))))
    return stats.select("is_binary", "variance", marks.alias("threshold")).groupBy("threshold").agg(F.count_if(kept).alias("n_features"))


@dataclass(frozen=True)
class LowVarianceHandler:
    """Keeps binary features, then those with a population variance above `threshold`."""

    threshold: float = 0.05
    roles: Roles = Roles()
    deactivate: bool = False
    selected: tuple[str, ...] | None = None

    def fit(self, df: DataFrame) -> LowVarianceHandler:
        if self.deactivate:
            return self
        df = missing_as_null(df)
        cols = self.roles.features(df)
        stats = collect_stats(df, cols)
        binary = [c for c in cols if stats[c]["is_binary"]]
        varied = [c for c in cols if c not in binary and (stats[c]["variance"] or 0.0) > self.threshold]
        return replace(self, selected=(*binary, *varied))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.deactivate or self.selected is None:
            return df
        return df.select(*(c for c in df.columns if c in self.roles.names), *(c for c in self.selected if c in df.columns))
