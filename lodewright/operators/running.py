"""Running sums and exact quantiles over any number of rows, without a task that sorts a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.session import Scratch


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], values: dict[str, str], scratch: Scratch | None = None) -> DataFrame:
    """The rows with, for each name in `values`, the running sum of a column within `by`, in `order`, its own row included.

    Rows are cut into ranges of (by, order), summed within each range and shifted by the sums of the ranges before;
    rows that are equal in `by` and `order` get sums in any order among themselves. Only sums of ranges meet in one
    task. A null in a summed column counts as 0.
    """
    scratch = scratch or Scratch(df.sparkSession)
    cols = df.columns
    keys = [f"__o{i}" for i in range(len(order))]
    named = df.withColumns(dict(zip(keys, (F.col(o) if isinstance(o, str) else o for o in order), strict=True)))
    ranged = scratch.save(named.repartitionByRange(*(F.col(c) for c in (*by, *keys))).withColumn("__p", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "__p").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"__s{i}") for i, c in enumerate(values.values())))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("__p") == F.col("__q")
    for i, b in enumerate(by):
        match = match & F.col(b).eqNullSafe(F.col(f"__b{i}"))
    before = parts.select(
        *(F.col(b).alias(f"__b{i}") for i, b in enumerate(by)), F.col("__p").alias("__q"),
        *(F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).alias(f"__before{i}") for i in range(len(values))),
    )
    inner = Window.partitionBy(*by, "__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = {name: F.sum(F.coalesce(c, F.lit(0))).over(inner) + F.col(f"__before{i}") for i, (name, c) in enumerate(values.items())}
    return ranged.join(before, match).withColumns(summed).select(*cols, *values)


def counted(cells: DataFrame, by: Sequence[str], x: str = "x") -> DataFrame:
    """(*by, `x`, `c`): how often each value occurs; missing values are left out."""
    return cells.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("x")).agg(F.count("*").alias("c"))


def exact_quantiles(cells: DataFrame, by: Sequence[str], probs: Sequence[float], x: str = "x", scratch: Scratch | None = None) -> DataFrame:
    """(*by, `q`): interpolated quantiles of a column within `by`, as an array in the order of `probs`.

    Values are counted first, so a value that fills the table is one row. Groups without a value get no row.
    """
    scratch = scratch or Scratch(cells.sparkSession)
    return quantiles_of_counts(scratch.save(counted(cells, by, x)), by, probs, scratch)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], probs: Sequence[float], scratch: Scratch) -> DataFrame:
    """As `exact_quantiles`, from a written table of counted values."""
    upto = running_sums(counts, by, ["x"], {"upto": "c"}, scratch)
    total = counts.groupBy(*(F.col(b).alias(f"__{b}") for b in by)).agg(F.sum("c").alias("total"))
    joined = upto.join(total, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]) if by else upto.join(F.broadcast(total))  # one row
    picks = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(place + F.lit(1e-12)), F.ceil(place - F.lit(1e-12))
        at = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("c") <= k), F.col("x")))
        picks += [at(low).alias(f"l{i}"), at(high).alias(f"h{i}")]
    rows = joined.groupBy(*by).agg(F.first("total").alias("total"), *picks)

    def value(i: int, p: float) -> Column:
        place = F.lit(float(p)) * (F.col("total") - 1)
        share = place - F.floor(place + F.lit(1e-12))
        return F.when(F.col(f"l{i}") == F.col(f"h{i}"), F.col(f"l{i}")).otherwise(F.col(f"l{i}") * (1 - share) + F.col(f"h{i}") * share)

    return rows.select(*by, F.array(*(value(i, p) for i, p in enumerate(probs))).alias("q"))


def quantile_row(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of several columns of a table, by name; columns without values are left out. The driver sees the quantiles."""
    cells = F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("double").alias("x")) for n, c in columns.items()))
    long = df.select(F.explode(cells).alias("cell")).select("cell.feature", "cell.x").where(~F.isnan("x"))
    return {r["feature"]: list(r["q"]) for r in exact_quantiles(long, ["feature"], probs).collect()} if columns else {}


def even_quantile_row(df: DataFrame, columns: dict[str, Column], m: int) -> dict[str, list[float]]:
    """As `quantile_row` at the `m` places i / (m - 1); each counted value finds the places it stands at by whole-number
    arithmetic, so a thousand places cost no more than a few."""
    if m < 2 or not columns:
        return quantile_row(df, columns, [0.5])
    scratch = Scratch(df.sparkSession)
    cells = F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("double").alias("x")) for n, c in columns.items()))
    long = df.select(F.explode(cells).alias("cell")).select("cell.feature", "cell.x").where(~F.isnan("x"))
    counts = scratch.save(counted(long, ["feature"]))
    totals = counts.groupBy("feature").agg(F.sum("c").alias("total"))
    rows = running_sums(counts, ["feature"], ["x"], {"upto": "c"}, scratch).join(F.broadcast(totals), "feature")  # one row per column
    step, last = F.lit(m - 1).cast("long"), F.greatest(F.col("total") - 1, F.lit(1))
    start, stop = F.col("upto") - F.col("c"), F.col("upto")
    ceil = lambda a: F.floor((a * step + last - 1) / last)
    floor = lambda a: F.floor(a * step / last)
    low = F.sequence(ceil(start), F.least(ceil(stop) - 1, step))
    high = F.sequence(F.when(start == 0, F.lit(0).cast("long")).otherwise(floor(start - 1) + 1), F.least(floor(stop - 1), step))
    single = F.sequence(F.lit(0).cast("long"), step)
    pick = lambda seq, a, b: F.when(F.col("total") == 1, single).when(a <= b, seq)
    at_low = rows.select("feature", "total", "x", F.explode(pick(low, ceil(start), F.least(ceil(stop) - 1, step))).alias("i"), F.lit(True).alias("below"))
    at_high = rows.select(
        "feature", "total", "x",
        F.explode(pick(high, F.when(start == 0, F.lit(0).cast("long")).otherwise(floor(start - 1) + 1), F.least(floor(stop - 1), step))).alias("i"), F.lit(False).alias("below"),
    )
    found = at_low.unionByName(at_high).groupBy("feature", "i").agg(
        F.max(F.when(F.col("below"), F.col("x"))).alias("a"), F.max(F.when(~F.col("below"), F.col("x"))).alias("b"), F.first("total").alias("total")
    )
    out: dict[str, list[float]] = {n: [0.0] * m for n in columns}
    seen = set()
    for r in found.collect():  # places times columns
        share = (r["i"] * max(r["total"] - 1, 0)) % (m - 1) / (m - 1)
        out[r["feature"]][r["i"]] = r["a"] if share == 0 else r["a"] * (1 - share) + r["b"] * share
        seen.add(r["feature"])
    return {n: v for n, v in out.items() if n in seen}
