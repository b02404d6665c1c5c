"""Binning of features that still have outliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.operators.outliers import outlier_counts
from lodewright.operators.profile import Roles, collect_stats, missing_as_null
from lodewright.operators.running import quantile_row


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """Number of interior edges at or below a value: bins are closed on the left, the last one on both sides."""
    return sum((F.when(x >= F.lit(float(e)), 1).otherwise(0) for e in edges[1:-1]), F.lit(0)) if len(edges) > 2 else F.when(x.isNotNull(), F.lit(0))


def bin_edges(df: DataFrame, cols: Sequence[str], n_bins: int = 3, strategy: str = "quantile", rounds: int = 50) -> dict[str, list[float]]:
    """Edges by column: equal widths, quantiles (repeated ones merged) or midpoints of one-dimensional k-means."""
    if not cols:
        return {}
    stats = collect_stats(df, cols)
    if strategy == "quantile":
        found = quantile_row(df, {c: F.col(c) for c in cols}, [i / n_bins for i in range(n_bins + 1)])
        edges = {c: found.get(c, []) for c in cols}
        return {c: [e for i, e in enumerate(v) if i == 0 or e - v[i - 1] > 1e-8] for c, v in edges.items()}
    even = {c: [stats[c]["low"] + (stats[c]["high"] - stats[c]["low"]) * i / n_bins for i in range(n_bins + 1)] for c in cols}
    if strategy == "uniform":
        return even
    if strategy != "kmeans":
        raise ValueError("strategy must be uniform, quantile or kmeans")
    centers = {c: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for c, v in even.items()}
    between = lambda v: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
    for _ in range(rounds):
        now = {c: [stats[c]["low"], *between(centers[c]), stats[c]["high"]] for c in cols}
        aggs = [F.avg(F.when(bin_of(F.col(c), now[c]) == j, F.col(c))).alias(f"{i}_{j}") for i, c in enumerate(cols) for j in range(n_bins)]
        row = df.agg(*aggs).first()
        new = {c: [row[f"{i}_{j}"] if row[f"{i}_{j}"] is not None else centers[c][j] for j in range(n_bins)] for i, c in enumerate(cols)}
        if all(abs(a - b) < 1e-9 for c in cols for a, b in zip(new[c], centers[c], strict=True)):
            break
        centers = new
    return {c: [stats[c]["low"], *between(sorted(centers[c])), stats[c]["high"]] for c in cols}


@dataclass(frozen=True)
class KBinHandler:
    """Replaces the features with outliers by `Kbin1..m` at the end: ordinal numbers, or 0/1 columns `Kbin1_0..`."""

    n_bins: int = 3
    encode: str = "ordinal"
    strategy: str = "quantile"
    roles: Roles = Roles()
    deactivate: bool = False
    edges: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> KBinHandler:
        if self.encode not in ("ordinal", "onehot", "onehot-dense"):
            raise ValueError("encode must be ordinal, onehot or onehot-dense")
        if self.deactivate:
            return self
        df = missing_as_null(df)
        cols = self.roles.features(df)
        found = {r["feature"] for r in outlier_counts(df, cols).where("n_outliers > 0").collect()}
        return replace(self, edges=bin_edges(df, [c for c in cols if c in found], self.n_bins, self.strategy))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.deactivate:
            return df
        new = []
        for i, (c, edges) in enumerate(self.edges.items(), 1):
            b = bin_of(F.col(c), edges)
            if self.encode == "ordinal":
                new.append(b.cast("double").alias(f"Kbin{i}"))
            else:
                new += [F.when(b == j, 1.0).otherwise(0.0).alias(f"Kbin{i}_{j}") for j in range(max(1, len(edges) - 1))]
        return df.select(*(c for c in df.columns if c not in self.edges), *new)
