"""Predictions beside the records they belong to: write-back, domain, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_back(records: DataFrame, predictions: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Records with the predicted columns where there is a prediction, else their own; ids of predictions are unique."""
    new = predictions.select(F.col(id_col).alias("__id"), *(quoted(c).alias(f"__{i}") for i, c in enumerate(cols)))
    joined = records.join(new, F.col(id_col) == F.col("__id"), "left")
    kept = {c: F.coalesce(F.col(f"__{i}"), quoted(c)) if c in records.columns else F.col(f"__{i}") for i, c in enumerate(cols)}
    return joined.select(*(kept.get(c, quoted(c)).alias(c) for c in records.columns), *(kept[c].alias(c) for c in cols if c not in records.columns))


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_domain(predictions: DataFrame, domain: DataFrame, id_col: str) -> DataFrame:
    """Predictions with their `domain`; repeated ids multiply, as in any inner join."""
    return predictions.join(domain.select(F.col("id").alias(id_col), F.col("domain").alias("Applicability domain")), id_col)


def side_by_side(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two reports joined on their keys; shared names get _1 and _2, and columns are in order of name."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    for name in shared:
        a, b = a.withColumnRenamed(name, f"{name}_1"), b.withColumnRenamed(name, f"{name}_2")
    out = a.join(b, list(keys))
    return out.select(*keys, *sorted(c for c in out.columns if c not in keys))


def find_columns(df: DataFrame, *words: str) -> list[str]:
    """Columns whose names contain all words, whatever their case."""
    return [c for c in df.columns if all(w.lower() in c.lower() for w in words)]


def summary(df: DataFrame, predicted: str, domain: str | None = None) -> DataFrame:
    """One row: count, mean, population deviation, missing share, deciles, and rows in and out of the domain."""
    x = F.expr(f"try_cast(`{predicted}` as double)")
    q = F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    where: dict[str, Column] = {} if domain is None else {"n_in": F.count_if(F.col(domain) == "in"), "n_out": F.count_if(F.col(domain) == "out")}
    return (
        df.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.avg(F.when(x.isNull(), 1.0).otherwise(0.0)).alias("missing"), q.alias("q"), *(c.alias(n) for n, c in where.items()))
        .select("n", "mean", "std", "missing", F.col("q")[0].alias("q10"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q90"), *where)
    )


def extremes(df: DataFrame, id_col: str, predicted: str, k: int = 3) -> DataFrame:
    """The k highest and k lowest predictions, ties by id: two top-k selections without a full sort."""
    rows = df.where(F.col(predicted).isNotNull()).select(id_col, predicted)
    top = rows.orderBy(F.col(predicted).desc(), id_col).limit(k).withColumn("end", F.lit("top"))
    return top.unionByName(rows.orderBy(predicted, id_col).limit(k).withColumn("end", F.lit("bottom")))
