"""Prediction intervals and label sets from out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.operators.models import Fitted
from lodewright.operators.profile import Roles
from lodewright.operators.running import quantile_row
from lodewright.operators.splits import repeated_folds
from lodewright.session import Scratch


#: Distinct residuals of a fold that may be sent to every task; more are joined.
MAX_RESIDUALS = 2_000_000


def _order_statistic(values: list[np.ndarray], counts: list[np.ndarray], k: int) -> float:
    """The k-th least of several sorted lists with counts, by bisection over their values."""
    lists = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
    every = np.unique(np.concatenate(values))
    low, high = 0, len(every) - 1
    while low < high:
        middle = (low + high) // 2
        if sum(c[np.searchsorted(v, every[middle], "right")] for v, c in zip(values, lists, strict=True)) >= k:
            high = middle
        else:
            low = middle + 1
    return float(every[low])


def plus_intervals(fold_predictions: DataFrame, residuals: DataFrame, alpha: float) -> DataFrame:
    """(`id`, `lower`, `upper`): cross-validation-plus intervals, rounded half to even at 3 places.

    `fold_predictions` (`id`, `fold`, `predicted`): each row predicted by the model that left a fold out; `residuals`
    (`fold`, `residual`): absolute out-of-fold residuals of the fitted rows, n in all. The bounds are the
    floor(alpha (n + 1))-th least of prediction - residual and the ceil((1 - alpha)(n + 1))-th least of prediction +
    residual. Residuals are counted by value and sent out once as sorted lists; a row needs a search in them for each
    fold and no list of its own. More than `MAX_RESIDUALS` distinct ones are an error: cut them to fewer digits first.
    """
    counted = residuals.where("residual is not null").groupBy("fold", "residual").agg(F.count("*").alias("c"))
    table = counted.limit(MAX_RESIDUALS + 1).toPandas().sort_values(["fold", "residual"])
    if len(table) > MAX_RESIDUALS:
        raise ValueError(f"more than {MAX_RESIDUALS} distinct residuals")
    n = int(table["c"].sum())
    if not n:
        return fold_predictions.groupBy("id").agg(F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    low = max(1, min(n, int(alpha * (n + 1) + 1e-9)))
    high = max(1, min(n, -int(-((1 - alpha) * (n + 1) - 1e-9) // 1)))
    by_fold = {f: (g["residual"].to_numpy(float), g["c"].to_numpy(np.int64)) for f, g in table.groupby("fold")}
    shared = fold_predictions.sparkSession.sparkContext.broadcast(by_fold)

    @F.pandas_udf("struct<lower:double,upper:double>")
    def bounds(maps: pd.Series) -> pd.DataFrame:
        out = []
        for pairs in maps:
            folds = [(shared.value[r["fold"]], r["predicted"]) for r in pairs if r["fold"] in shared.value and r["predicted"] is not None]
            if not folds:
                out.append((None, None))
                continue
            minus = [(p - v[::-1], c[::-1]) for (v, c), p in folds]
            plus = [(p + v, c) for (v, c), p in folds]
            out.append((_order_statistic(*map(list, zip(*minus, strict=True)), low), _order_statistic(*map(list, zip(*plus, strict=True)), high)))
        return pd.DataFrame(out, columns=["lower", "upper"])

    rows = fold_predictions.groupBy("id").agg(F.collect_list(F.struct("fold", "predicted")).alias("ps"))  # one entry for each fold
    return rows.select("id", bounds("ps").alias("b")).select("id", F.bround("b.lower", 3).alias("lower"), F.bround("b.upper", 3).alias("upper"))


def label_sets(fold_probabilities: DataFrame, calibration: DataFrame, alpha: float) -> DataFrame:
    """(`id`, `labels`): labels whose score 1 - p is not among the alpha share of worst calibration scores; may be empty.

    `fold_probabilities` (`id`, `label`, `p`), averaged over folds if repeated; `calibration` (`score`), the scores
    1 - p of the true labels out of fold.
    """
    n = calibration.count()
    level = min(1.0, -int(-((n + 1) * (1 - alpha) - 1e-9) // 1) / max(n, 1))
    place = max(1, min(n, -int(-(level * n - 1e-9) // 1)))
    cut = quantile_row(calibration, {"score": F.col("score")}, [(place - 1) / max(n - 1, 1)]).get("score", [1.0])[0]
    mean = fold_probabilities.groupBy("id", "label").agg(F.avg("p").alias("p"))
    kept = F.array_sort(F.collect_list(F.when(1 - F.col("p") <= F.lit(cut) + 1e-12, F.col("label"))))
    return mean.groupBy("id").agg(kept.alias("labels"))


@dataclass(frozen=True)
class ConformalPredictor:
    """Intervals for numbers, sets of labels for classes, from models that each left one fold out.

    `method`: `plus` (cross-validation plus) or `base` (the plain quantile of residuals about the full model's
    prediction) for numbers; sets of labels always come from the least ambiguous classifier rule.
    """

    n_splits: int = 5
    method: str = "plus"
    seed: int = 42
    roles: Roles = Roles()
    classification: bool = False
    models: tuple[Fitted, ...] = ()
    full: Fitted | None = None
    residuals: DataFrame | None = field(default=None)

    def fit(self, df: DataFrame, fit: Callable[[DataFrame], Fitted], classification: bool) -> ConformalPredictor:
        """Fit `n_splits` models and one on all rows; scores out of fold are written."""
        if self.method not in ("plus", "base"):
            raise ValueError("method must be plus or base")
        scratch = Scratch(df.sparkSession)
        y = self.roles.activity
        folds = repeated_folds(df, self.roles.id, self.n_splits, 1, y if classification else None, self.seed).select(F.col(self.roles.id).alias("__id"), "fold")
        rows = scratch.save(df.join(folds, df[self.roles.id] == F.col("__id")).drop("__id"))
        models, parts = [], None
        for f in range(self.n_splits):
            model = fit(rows.where(F.col("fold") != f).drop("fold"))
            scored = model.score(rows.where(F.col("fold") == f))
            p = F.when(F.col(y) == 1, F.col("probability")).otherwise(1 - F.col("probability")) if classification else None
            value = 1 - p if classification else F.abs(F.col("predicted") - F.col(y))
            part = scored.select("fold", value.alias("residual"))
            models.append(model)
            parts = part if parts is None else parts.unionByName(part)
        return replace(self, classification=classification, models=tuple(models), full=fit(df), residuals=scratch.save(parts))

    def predict(self, df: DataFrame, alphas: float | Sequence[float] | None = None) -> DataFrame:
        """(id, `Predicted value`, and for each alpha `Prediction Interval (alpha=a)` or `Prediction Set (alpha=a)`)."""
        i = self.roles.id
        out = self.full.score(df).select(i, F.col("predicted").alias("Predicted value"))
        alphas = [] if alphas is None else [alphas] if isinstance(alphas, int | float) else list(alphas)
        if not alphas:
            return out
        scratch = Scratch(df.sparkSession)
        parts = None
        for f, model in enumerate(self.models):
            scored = model.score(df).select(F.col(i).alias("id"), F.lit(f).alias("fold"), "predicted", *(["probability"] if self.classification else []))
            parts = scored if parts is None else parts.unionByName(scored)
        parts = scratch.save(parts)
        for a in alphas:
            if self.classification:
                labels = parts.select("id", F.explode(F.array(F.struct(F.lit("0").alias("label"), (1 - F.col("probability")).alias("p")), F.struct(F.lit("1").alias("label"), F.col("probability").alias("p")))).alias("l"))
                one = label_sets(labels.select("id", "l.label", "l.p"), self.residuals.select(F.col("residual").alias("score")), a).select("id", F.col("labels").alias(f"Prediction Set (alpha={a})"))
            elif self.method == "plus":
                one = plus_intervals(parts, self.residuals, a).select("id", F.array("lower", "upper").alias(f"Prediction Interval (alpha={a})"))
            else:
                n = self.residuals.count()
                k = min(n, -int(-((1 - a) * (n + 1) - 1e-9) // 1))
                half = quantile_row(self.residuals, {"r": F.col("residual")}, [(k - 1) / max(n - 1, 1)]).get("r", [0.0])[0]
                p = F.col("Predicted value")
                one = out.select(F.col(i).alias("id"), F.array(F.bround(p - half, 3), F.bround(p + half, 3)).alias(f"Prediction Interval (alpha={a})"))
            out = out.join(one.withColumnRenamed("id", i), i)
        return out
