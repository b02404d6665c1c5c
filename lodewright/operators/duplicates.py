"""Duplicate columns and duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.operators.profile import Roles, long_form, missing_as_null

KEEPS = ("first", "last", "random", "min", "max", "mean", "median")


def duplicate_columns(df: DataFrame, cols: Sequence[str], id_col: str) -> list[str]:
    """Columns that equal an earlier one in every row, missing values being equal.

    Candidates share an order-free sum of hashes of (id, value); each is then compared with its first twin, all pairs
    in one more aggregation.
    """
    place = {c: i for i, c in enumerate(cols)}
    sums = (
        long_form(df, cols, [id_col]).groupBy("feature")
        .agg(F.sum(F.shiftright(F.xxhash64(id_col, "x"), 8).cast("decimal(20,0)")).alias("print")).collect()
    )
    twins: dict = {}
    for r in sorted(sums, key=lambda r: place[r["feature"]]):
        twins.setdefault(r["print"], []).append(r["feature"])
    pairs = [(group[i], c) for group in twins.values() for j, c in enumerate(group) for i in range(j)]
    if not pairs:
        return []
    same = df.agg(*(F.bool_and(F.col(a).cast("double").eqNullSafe(F.col(b).cast("double"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first()
    found = {b for i, (_, b) in enumerate(pairs) if same[f"p{i}"]}
    return [c for c in cols if c in found]


def duplicate_rows(df: DataFrame, cols: Sequence[str], roles: Roles = Roles(), keep: str = "mean", seed: int = 42) -> DataFrame:
    """One row for each combination of feature values; missing values are equal, and no features leave all rows.

    `first`/`last`: by id; `random`: by a hash of id and seed; `min`/`max`: by activity, missing last; `mean`/`median`:
    the first row, with the activity of the group. One aggregation with map-side combine, whatever the group sizes.
    """
    if keep not in KEEPS:
        raise ValueError(f"keep must be one of {', '.join(KEEPS)}")
    if not cols:
        return df
    rest = [c for c in df.columns if c not in cols]
    a, i = F.col(roles.activity).cast("double"), F.col(roles.id)
    row = F.struct(*rest)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string")))
    picked = {
        "last": F.max_by(row, i),
        "random": F.min_by(row, digest),
        "min": F.min_by(row, F.struct(a.isNull(), a, i)),
        "max": F.min_by(row, F.struct(a.isNull(), -a, i)),
    }.get(keep, F.min_by(row, i))
    value = {"mean": F.avg(a), "median": F.percentile(a, F.lit(0.5))}.get(keep)
    grouped = df.groupBy(*cols).agg(picked.alias("__row"), F.count("*").alias("__n"), *([value.alias("__value")] if value is not None else []))
    out = {c: F.col(f"__row.{c}") for c in rest}
    if value is not None:
        out[roles.activity] = F.when(F.col("__n") > 1, F.col("__value")).otherwise(F.col(f"__row.{roles.activity}").cast("double"))
    return grouped.select(*(out[c].alias(c) if c in out else F.col(c) for c in df.columns))


@dataclass(frozen=True)
class DuplicateHandler:
    """Drops duplicate columns (as fitted) and collapses duplicate rows (at each transform)."""

    cols: bool = True
    rows: bool = True
    keep: str = "mean"
    seed: int = 42
    roles: Roles = Roles()
    deactivate: bool = False
    dropped: tuple[str, ...] = field(default=())

    def fit(self, df: DataFrame) -> DuplicateHandler:
        from dataclasses import replace

        if self.deactivate or not self.cols:
            return self
        df = missing_as_null(df)
        return replace(self, dropped=tuple(duplicate_columns(df, self.roles.features(df), self.roles.id)))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.deactivate:
            return df
        out = missing_as_null(df).drop(*self.dropped)
        return duplicate_rows(out, self.roles.features(out), self.roles, self.keep, self.seed) if self.rows else out
