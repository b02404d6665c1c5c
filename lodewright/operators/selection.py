"""Feature selection: scores of single features and importances of models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewright.operators.models import fit_model, importances
from lodewright.operators.profile import Roles, long_form


def anova_scores(df: DataFrame, cols: Sequence[str], class_col: str) -> DataFrame:
    """(`feature`, `f`): ratio of the variance between classes to that within; every feature in one aggregation."""
    cells = long_form(df, cols, [class_col]).where("x is not null")
    by_class = cells.groupBy("feature", class_col).agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("within"))
    total = by_class.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("within").alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"),
    )
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return total.select("feature", F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))


def regression_scores(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """(`feature`, `f`) from the correlation with the target."""
    cells = long_form(df, cols, [y]).where(F.col("x").isNotNull() & F.col(y).isNotNull())
    stats = cells.groupBy("feature").agg(F.corr("x", F.col(y).cast("double")).alias("r"), F.count("*").alias("n"))
    rr = F.col("r") * F.col("r")
    return stats.select("feature", F.try_divide(rr * (F.col("n") - 2), 1 - rr).alias("f"))


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    while (x < 8).any():
        out = np.where(x < 8, out - 1 / x, out)
        x = np.where(x < 8, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def _kth_distances(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Distance (the greater of both differences) of each point to its k-th nearest other one.

    Points are compared along the more finely graded axis with a window around each block, which grows until nothing
    beyond it can be nearer.
    """
    if len(np.unique(np.round(y, 6))) > len(np.unique(np.round(x, 6))):
        x, y = y, x
    order = np.argsort(x)
    x, y, n = x[order], y[order], len(x)
    out, i, reach = np.zeros(n), 0, 64
    while i < n:
        stop = min(n, i + max(1, min(512, (1 << 20) // reach)))
        low, high = max(0, i - reach), min(n, stop + reach)
        d = np.maximum(np.abs(x[i:stop, None] - x[low:high]), np.abs(y[i:stop, None] - y[low:high]))
        r = np.partition(d, k, axis=1)[:, k]
        before = x[i:stop] - x[low - 1] if low else np.inf
        after = x[high] - x[i:stop] if high < n else np.inf
        if (r <= np.minimum(before, after)).all():
            out[order[i:stop]] = r
            i, reach = stop, max(64, reach * 9 // 10)
        else:
            reach *= 2
    return out


def mutual_information(x: np.ndarray, y: np.ndarray, discrete: bool, k: int = 3, seed: int = 42) -> float:
    """Nearest-neighbour estimate between one feature and the target, with a trace of noise against ties."""
    rng = np.random.default_rng(seed)
    x = (x - x.mean()) / (x.std() or 1.0) + 1e-10 * rng.standard_normal(len(x))
    n = len(x)
    if discrete:
        radius, count, m = np.zeros(n), np.zeros(n), np.zeros(n)
        use = np.zeros(n, bool)
        for c in np.unique(y):
            at = np.flatnonzero(y == c)
            if len(at) > 1:
                use[at] = True
                order = at[np.argsort(x[at])]
                v, kk = x[order], min(k, len(at) - 1)
                pad = np.concatenate([np.full(kk, -np.inf), v, np.full(kk, np.inf)])
                around = np.stack([np.abs(pad[i : i + len(v)] - v) for i in range(2 * kk + 1) if i != kk])
                radius[order] = np.partition(around, kk - 1, axis=0)[kk - 1]
                count[order], m[order] = kk, len(at)
        s = np.sort(x)
        inside = np.searchsorted(s, x + radius * (1 - 1e-12), "right") - np.searchsorted(s, x - radius * (1 - 1e-12), "left")
        total = _digamma(np.array([use.sum()]))[0] + _digamma(count[use]).mean() - _digamma(m[use]).mean() - _digamma(np.maximum(inside[use], 1)).mean()
        return max(0.0, float(total))
    y = (y - y.mean()) / (y.std() or 1.0) + 1e-10 * rng.standard_normal(n)
    k = min(k, n - 1)
    r = _kth_distances(x, y, k) * (1 - 1e-12)
    nx, ny = (np.searchsorted(s, v + r, "right") - np.searchsorted(s, v - r, "left") for s, v in ((np.sort(x), x), (np.sort(y), y)))
    return max(0.0, float(_digamma(np.array([n]))[0] + _digamma(np.array([k]))[0] - _digamma(np.maximum(nx, 1)).mean() - _digamma(np.maximum(ny, 1)).mean()))


def mutual_information_scores(df: DataFrame, cols: Sequence[str], y: str, discrete: bool, id_col: str) -> DataFrame:
    """(`feature`, `f`) on all rows, one feature to a task, which holds that feature's values and the target's."""
    cells = long_form(df, cols, [id_col, y]).where(F.col("x").isNotNull() & F.col(y).isNotNull())

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(id_col)
        return pd.DataFrame({"feature": [g["feature"].iloc[0]], "f": [mutual_information(g["x"].to_numpy(float), g[y].to_numpy(float), discrete)]})

    return cells.groupBy("feature").applyInPandas(run, "feature string, f double")


def top_k(scores: DataFrame, k: int = 20) -> list[str]:
    """The k features of greatest score, by name on a tie; scores are one row per feature."""
    w = Window.orderBy(F.col("f").desc_nulls_last(), "feature")
    return [r["feature"] for r in scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).orderBy("r").collect()]


MODEL_SELECTORS = ("RandomForest", "ExtraTrees", "AdaBoost", "GradientBoosting", "XGB")


@dataclass(frozen=True)
class FeatureSelector:
    """Selects features by `method`: `NoFS`, `Anova`, `MutualInformation`, one of the tree models (importance at or
    above the mean), `Logistic` (half L1) or `Lasso` (its penalty by cross-validation; weights above 1e-5), or a registered function (df, cols, y) -> names."""

    method: str = "NoFS"
    classification: bool = True
    k: int = 20
    roles: Roles = Roles()
    deactivate: bool = False
    registry: dict[str, Callable] = field(default_factory=dict)
    selected: tuple[str, ...] | None = None

    def add_method(self, name: str, function: Callable) -> FeatureSelector:
        return replace(self, registry=self.registry | {name: function})

    def fit(self, df: DataFrame) -> FeatureSelector:
        if self.deactivate or self.method == "NoFS":
            return self
        cols, y = self.roles.features(df), self.roles.activity
        if self.method in self.registry:
            names = list(self.registry[self.method](df, cols, y))
        elif self.method == "Anova":
            names = top_k(anova_scores(df, cols, y) if self.classification else regression_scores(df, cols, y), self.k)
        elif self.method == "MutualInformation":
            names = top_k(mutual_information_scores(df, cols, y, self.classification, self.roles.id), self.k)
        elif self.method in (*MODEL_SELECTORS, "Logistic", "Lasso"):
            params = {"elasticNetParam": 0.5} if self.method == "Logistic" else {}
            weights = importances(fit_model("LassoCV" if self.method == "Lasso" else self.method, df, cols, y, self.classification, **params), cols)
            cut = 1e-5 if self.method in ("Logistic", "Lasso") else sum(weights.values()) / max(1, len(weights))
            names = [c for c in cols if abs(weights[c]) >= cut]
        else:
            raise ValueError(f"unknown method {self.method}")
        return replace(self, selected=tuple(c for c in cols if c in names))

    def transform(self, df: DataFrame) -> DataFrame:
        """Selected features, then id and activity (whole numbers for classes)."""
        if self.deactivate or self.selected is None:
            return df
        kind = "int" if self.classification else "double"
        ends = [F.col(self.roles.id), *([F.col(self.roles.activity).cast(kind).alias(self.roles.activity)] if self.roles.activity in df.columns else [])]
        return df.select(*self.selected, *ends)
