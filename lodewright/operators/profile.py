"""One row of statistics per feature, from one pass over a table of records.

A record table has role columns (id, activity) and feature columns. Features are read in long form (feature, value):
one aggregation with map-side combine serves any number of columns, where one expression per column and statistic
would outgrow a plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from lodewright.operators.running import quantiles_of_counts
from lodewright.session import Scratch


@dataclass(frozen=True)
class Roles:
    """Names of the columns that are not features."""

    id: str = "rec_id"
    activity: str = "activity"
    others: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return (self.id, self.activity, *self.others)

    def features(self, df: DataFrame) -> list[str]:
        """Numeric columns without a role, in the table's order."""
        return [f.name for f in df.schema.fields if f.name not in self.names and isinstance(f.dataType, NumericType)]


def missing_as_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and null are one concept of a missing value: null. Negative zero becomes zero."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType) and (cols is None or f.name in cols)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c) + F.lit(0.0)) for c in floats})


def keep_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that exist, in the given order."""
    return df.select([c for c in names if c in df.columns])


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, `feature`, `x`): one row per record and feature."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols))
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.feature", "cell.x")


def is_binary(x: Column) -> Column:
    """Aggregate: whether all values present are 0 or 1; true where none is present."""
    return F.coalesce(F.bool_and(x.isin(0.0, 1.0)), F.lit(True))


def feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(`feature`, `n`, `n_missing`, `missing_pct`, `is_binary`, `mean`, `median`, `mode`, `variance`, `q1`, `q3`,
    `low`, `high`): population variance, interpolated quantiles, the smallest of the most frequent values.

    Values are counted once and written; moments, modes and quantiles come from the counts, in ranges of values, so
    neither a feature with billions of distinct values nor one value with all rows fills a task.
    """
    scratch = Scratch(df.sparkSession)
    x = F.col("x")
    cells = long_form(df, cols)
    counts = scratch.save(cells.groupBy("feature", "x").agg(F.count("*").alias("c")))
    there = F.when(x.isNotNull(), F.col("c"))
    mean = counts.groupBy("feature").agg(
        F.sum("c").alias("n"), F.sum(F.when(x.isNull(), F.col("c")).otherwise(0)).alias("n_missing"), is_binary(x).alias("is_binary"),
        F.try_divide(F.sum(x * there), F.sum(there)).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.min_by(F.when(x.isNotNull(), x), F.when(x.isNotNull(), F.struct(-F.col("c"), x))).alias("mode"),
    )
    mean = scratch.save(mean)
    centred = counts.where("x is not null").join(F.broadcast(mean.select("feature", "mean")), "feature")  # one row per column
    spread = centred.groupBy("feature").agg((F.sum(F.col("c") * (x - F.col("mean")) * (x - F.col("mean"))) / F.sum("c")).alias("variance"))
    quantiles = quantiles_of_counts(counts.where("x is not null"), ["feature"], (0.25, 0.5, 0.75), scratch)
    return (
        mean.join(F.broadcast(spread), "feature", "left").join(F.broadcast(quantiles), "feature", "left")
        .select(
            "feature", "n", "n_missing", (F.lit(100.0) * F.col("n_missing") / F.col("n")).alias("missing_pct"), "is_binary", "mean", F.col("q")[1].alias("median"), "mode", "variance",
            F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "low", "high",
        )
    )


def collect_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """The statistics by feature; as many rows as there are columns."""
    return {r["feature"]: r.asDict() for r in feature_stats(df, cols).collect()} if cols else {}
