"""Missing values: columns to drop and values to fill in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodewright.operators.neighbours import chunked_pairs
from lodewright.operators.profile import Roles, collect_stats, missing_as_null
from lodewright.session import Scratch

STRATEGIES = ("mean", "median", "mode", "knn", "mice")


def bayesian_ridge(gram: np.ndarray, xy: np.ndarray, yy: float, n: int, rounds: int = 300) -> np.ndarray:
    """Coefficients of a ridge regression whose precisions maximise the evidence, from centred sums alone."""
    values, vectors = np.linalg.eigh(gram)
    values, proj = np.maximum(values, 0), vectors.T @ xy
    alpha, lam = n / max(yy, 1e-12), 1.0
    coef = np.zeros(len(xy))
    for _ in range(rounds):
        new = vectors @ (proj / (values + lam / alpha))
        used = float(np.sum(alpha * values / (lam + alpha * values)))
        error = max(yy - 2 * new @ xy + new @ gram @ new, 1e-12)
        lam, alpha = (used + 2e-6) / (new @ new + 2e-6), (n - used + 2e-6) / (error + 2e-6)
        if np.abs(new - coef).sum() < 1e-3:
            return new
        coef = new
    return coef


def _filled(x: np.ndarray, starts: tuple[float, ...], steps: tuple) -> np.ndarray:
    """Rows with their gaps at the starting values, then regressed again and again, step by step."""
    gaps = np.isnan(x)
    out = np.where(gaps, starts, x)
    for t, coef, offset in steps:
        value = np.delete(out, t, axis=1) @ np.array(coef) + offset
        out[:, t] = np.where(gaps[:, t], value, out[:, t])
    return out


def _centred_sums(rows: DataFrame, starts: tuple[float, ...], steps: tuple, target: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred cross products of the rows that have the target: partial sums by partition, added up."""
    width = len(starts)
    origin = np.array(starts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 1))
        for frame in frames:
            x = frame.to_numpy(float)
            full = _filled(x, starts, steps)[~np.isnan(x[:, target])] - origin
            one = np.column_stack([np.ones(len(full)), full])
            total += one.T @ one
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    sums = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((width + 1) ** 2)
    total[sums["i"].to_numpy()] = sums["v"].to_numpy()
    total = total.reshape(width + 1, width + 1)
    n = total[0, 0]
    mean = total[0, 1:] / max(n, 1)
    return int(n), mean + origin, total[1:, 1:] - n * np.outer(mean, mean)


def _moments(df: DataFrame, cols: list[str], where) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred cross products of the columns: one aggregation of fixed size."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    base = df.where(where).select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)))
    row = base.agg(
        F.count("*").alias("n"), *(F.avg(f"c{i}").alias(f"m{i}") for i in range(len(cols))),
        *(F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i, j in pairs),
    ).first()
    n = row["n"]
    s = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        s[i, j] = s[j, i] = (row[f"s{i}_{j}"] or 0.0) * n
    return n, np.array([row[f"m{i}"] or 0.0 for i in range(len(cols))]), s


@dataclass(frozen=True)
class MissingHandler:
    """Drops columns with more than `threshold` per cent missing; fills binary ones with their mode as whole numbers and
    the others by `strategy`. Output order: roles, binary columns, others.

    `knn` takes the mean of the nearest `neighbours` fitted rows that have the value, by Euclidean distance over the
    features both rows have, scaled up to all of them; ties go to the smaller id. `mice` runs `rounds` of Bayesian ridge
    regressions of each column on the others, in ascending order of missing values, starting from the means.
    """

    threshold: float = 40.0
    strategy: str = "mean"
    neighbours: int = 5
    rounds: int = 10
    roles: Roles = Roles()
    deactivate: bool = False
    dropped: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    other: tuple[str, ...] = ()
    fills: dict[str, float] = field(default_factory=dict)
    regressions: tuple = ()
    donors: DataFrame | None = None

    def fit(self, df: DataFrame) -> MissingHandler:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
        if self.deactivate:
            return self
        df = missing_as_null(df)
        cols = self.roles.features(df)
        stats = collect_stats(df, cols)
        dropped = tuple(c for c in cols if stats[c]["missing_pct"] > self.threshold)
        kept = [c for c in cols if c not in dropped]
        binary = tuple(c for c in kept if stats[c]["is_binary"])
        other = tuple(c for c in kept if c not in binary)
        how = self.strategy if self.strategy in ("mean", "median", "mode") else "mean"
        fills = {c: stats[c]["mode" if c in binary else how] for c in kept}
        fitted = replace(self, dropped=dropped, binary=binary, other=other, fills=fills)
        if self.strategy == "knn":
            fitted = replace(fitted, donors=df.select(F.col(self.roles.id).alias("donor"), F.array(*(F.col(c).cast("double") for c in other)).alias("x")))
        if self.strategy == "mice" and len(other) > 1:
            fitted = replace(fitted, regressions=fitted._chain(df, stats))
        return fitted

    def _chain(self, df: DataFrame, stats: dict[str, dict]) -> tuple:
        """Each step is one pass over the gapped columns: batches are filled by all steps so far, and only sums return."""
        order = [c for c in sorted(self.other, key=lambda c: (stats[c]["n_missing"], c)) if stats[c]["n_missing"]]
        steps: list[tuple[int, tuple[float, ...], float]] = []
        rows = Scratch(df.sparkSession).save(df.select(*(F.col(c).cast("double") for c in self.other)))
        for _ in range(self.rounds):
            for target in order:
                t = self.other.index(target)
                n, mean, s = _centred_sums(rows, self._starts(), tuple(steps), t)
                inputs = [i for i in range(len(self.other)) if i != t]
                coef = bayesian_ridge(s[np.ix_(inputs, inputs)], s[inputs, t], float(s[t, t]), max(n, 1))
                steps.append((t, tuple(float(w) for w in coef), float(mean[t] - coef @ mean[inputs])))
        return tuple(steps)

    def _starts(self) -> tuple[float, ...]:
        return tuple(float(self.fills[c] or 0.0) for c in self.other)

    def _regressed(self, df: DataFrame) -> DataFrame:
        starts, steps = self._starts(), self.regressions

        @F.pandas_udf(ArrayType(DoubleType()))
        def fill(*xs: pd.Series) -> pd.Series:
            return pd.Series(list(_filled(np.column_stack([x.to_numpy(float) for x in xs]), starts, steps)))

        out = df.withColumn("__filled", fill(*(F.col(c).cast("double") for c in self.other)))
        return out.withColumns({c: F.col("__filled")[i] for i, c in enumerate(self.other)}).drop("__filled")

    def _nearest(self, df: DataFrame) -> DataFrame:
        """(`__query`, `__filled`): the other columns of each row with a gap."""
        k, width = self.neighbours, len(self.other)
        queries = df.select(F.col(self.roles.id).alias("query"), F.array(*(F.col(c).cast("double") for c in self.other)).alias("x")).where(F.exists("x", lambda v: v.isNull()))

        def part(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            a = np.array(q["x"].tolist(), float).reshape(len(q), width)
            b = np.array(t["x"].tolist(), float).reshape(len(t), width)
            here, there = ~np.isnan(a), ~np.isnan(b)
            a0, b0 = np.where(here, a, 0), np.where(there, b, 0)
            common = here.astype(float) @ there.T
            d2 = (a0**2) @ there.T + here @ (b0**2).T - 2 * a0 @ b0.T
            with np.errstate(divide="ignore", invalid="ignore"):
                d2 = np.where(common > 0, np.maximum(d2, 0) * width / common, np.nan)
            ids, out = t["donor"].to_numpy(), []
            for i, query in enumerate(q["query"]):
                for f in np.flatnonzero(~here[i]):
                    ok = np.flatnonzero(there[:, f] & ~np.isnan(d2[i]))
                    best = ok[np.lexsort((ids[ok], d2[i][ok]))[:k]]
                    out += [(query, int(f), float(d2[i][j]), ids[j], float(b[j, f])) for j in best]
            return pd.DataFrame(out, columns=["query", "f", "d", "donor", "v"])

        found = chunked_pairs(queries, self.donors, "query", "donor", part, "query long, f int, d double, donor long, v double")
        nearest = (
            found.groupBy("query", "f").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "donor", "v"))), 1, k).alias("near"))
            .select("query", "f", (F.aggregate("near", F.lit(0.0), lambda s, x: s + x["v"]) / F.size("near")).alias("v"))
        )
        return nearest.groupBy(F.col("query").alias("__query")).agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("__filled"))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.deactivate:
            return df
        roles = [c for c in df.columns if c in self.roles.names]
        df = missing_as_null(df)
        if self.strategy == "mice":
            out = self._regressed(df) if self.other else df
        elif self.strategy == "knn" and self.other:
            near = self._nearest(df)
            out = df.join(near, df[self.roles.id] == near["__query"], "left").withColumns(
                {c: F.coalesce(F.col(c).cast("double"), F.try_element_at("__filled", F.lit(i)), F.lit(self.fills[c])) for i, c in enumerate(self.other)}
            )
        else:
            out = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c])) for c in self.other})
        whole = {c: F.coalesce(F.col(c).cast("long"), F.lit(self.fills[c]).cast("long")) for c in self.binary}
        return out.withColumns(whole).select(*roles, *self.binary, *self.other)
