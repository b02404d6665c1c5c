"""Scores of predictions, exact and grouped: every function takes the grouping columns first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.operators.running import exact_quantiles, running_sums
from lodewright.session import Scratch


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def threshold_metrics(df: DataFrame, by: Sequence[str], y: str, predicted: str) -> DataFrame:
    """accuracy, precision, recall, f1 and mcc of 0/1 labels; undefined ones are 0."""
    t, p = F.col(y) == 1, F.col(predicted) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(t & p).cast("double").alias("tp"), F.count_if(~t & p).cast("double").alias("fp"),
        F.count_if(t & ~p).cast("double").alias("fn"), F.count_if(~t & ~p).cast("double").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def probability_metrics(df: DataFrame, by: Sequence[str], y: str, p: str, eps: float = 1e-15) -> DataFrame:
    """log_loss (clipped) and brier."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    loss = -F.avg(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log1p(-q)))
    return df.groupBy(*by).agg(loss.alias("log_loss"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def curve_points(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """(*by, `score`, `tp`, `fp`, `positives`, `negatives`): cumulative counts by falling score, ties together.

    Scores are counted first and summed in ranges of scores, so no task holds all scores of a group.
    """
    scratch = Scratch(df.sparkSession)
    steps = scratch.save(df.groupBy(*by, F.col(p).alias("score")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg")))
    sums = running_sums(steps, by, [F.struct(F.col("score").isNull(), -F.col("score"))], {"tp": "pos", "fp": "neg"}, scratch)
    total = steps.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    if not by:
        return sums.join(F.broadcast(total)).select("score", "tp", "fp", "pos", "neg", "positives", "negatives")  # one row
    match = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    total = total.select(*(F.col(b).alias(f"__{b}") for b in by), "positives", "negatives")
    return sums.join(total, match).select(*by, "score", "tp", "fp", "pos", "neg", "positives", "negatives")


def ranking_metrics(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """roc_auc (ties count half) and average_precision; null where a class is absent."""
    c = curve_points(df, by, y, p)
    pairs = F.sum(F.col("pos") * (F.col("negatives") - F.col("fp") + F.col("neg") / 2))
    ap = F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("positives") * (F.col("tp") + F.col("fp"))))
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    return c.groupBy(*by).agg(
        F.when(both, F.try_divide(pairs, F.max("positives") * F.max("negatives"))).alias("roc_auc"), F.when(F.max("positives") > 0, ap).alias("average_precision")
    )


def regression_metrics(df: DataFrame, by: Sequence[str], y: str, predicted: str, eps: float = 2.220446049250313e-16) -> DataFrame:
    """r2, mse, rmse, mae, median_ae, mape and max_error (positive)."""
    e = F.col(predicted) - F.col(y)
    a = F.abs(e)
    out = df.groupBy(*by).agg(
        F.when(F.var_pop(y) > 0, 1 - F.avg(e * e) / F.var_pop(y)).alias("r2"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(a).alias("mae"), F.avg(a / F.greatest(F.abs(y), F.lit(eps))).alias("mape"), F.max(a).alias("max_error"),
    )
    middle = exact_quantiles(df.select(*by, a.alias("x")), by, [0.5]).select(*(F.col(b).alias(f"__{b}") for b in by), F.col("q")[0].alias("median_ae"))
    joined = out.join(middle, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], "left") if by else out.join(F.broadcast(middle), how="left")  # one row
    return joined.select(*by, "r2", "mse", "rmse", "mae", "median_ae", "mape", "max_error")


def plain_name(name: Column) -> Column:
    """A metric's name without the sign prefix."""
    return F.regexp_replace(name, "^neg_", "")
