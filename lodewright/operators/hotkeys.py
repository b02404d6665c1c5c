"""Joins of rows with the one row of their group, for groups of any size.

A join with an aggregated side keeps the aggregate's partitioning, and there adaptive execution does not split skewed
partitions. Groups above a share of the rows are therefore split here: their rows are spread over parts, and the
group's one row is repeated once for each part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group is split where it has more rows than this and more than one thousandth of all: at most 1000 groups are.
HOT_ROWS = 200_000
SHARE = 1000


def join_group(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], spread: Column | str, n_col: str = "n", how: str = "inner", hot_rows: int | None = None,
) -> DataFrame:
    """`rows` joined with `groups` on `keys`; `groups` has one row per key and `n_col`, the key's number of rows.

    `groups` should be a written table: its greatest groups are read first. `spread` tells the rows of one group apart
    (an id). Rows with a null key match nothing; with `how="left"` they are kept, and spread too. The driver sees the
    hashes and sizes of at most 1000 groups. The result has the columns of `rows`, then those of `groups` but the keys
    and `n_col`.
    """
    limit = hot_rows or HOT_ROWS
    total = groups.agg(F.sum(n_col)).first()[0] or 0
    least = max(limit, total // SHARE)
    mark = F.xxhash64(*keys)
    hot = groups.where(F.col(n_col) > least).select(mark.alias("__mark"), F.ceil(F.col(n_col) / F.lit(least)).cast("int").alias("__parts")).collect() if total > least else []
    out = [*rows.columns, *(c for c in groups.columns if c not in (*keys, n_col))]
    is_null = F.lit(False)
    for k in keys:
        is_null = is_null | F.col(k).isNull()
    if not hot and how != "left":
        return rows.join(groups.drop(n_col), list(keys), how).select(*out)
    parts: dict[int, int] = {}
    for r in hot:
        parts[r["__mark"]] = max(parts.get(r["__mark"], 1), r["__parts"])
    # At most SHARE entries, as a table that every task holds.
    table = F.broadcast(rows.sparkSession.createDataFrame(list(parts.items()), "__mark long, __parts int"))
    free = F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")
    many = rows.withColumn("__mark", mark).join(table, "__mark", "left") if parts else rows.withColumn("__parts", F.lit(None).cast("int"))
    many = many.withColumn("__part", F.when(is_null, free).otherwise(F.pmod(F.xxhash64(spread), F.coalesce("__parts", F.lit(1))).cast("int")))
    one = groups.drop(n_col).withColumn("__mark", mark)
    one = one.join(table, "__mark", "left") if parts else one.withColumn("__parts", F.lit(None).cast("int"))
    one = one.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return many.drop("__mark", "__parts").join(one.drop("__mark", "__parts"), [*keys, "__part"], how).select(*out)
