"""Outliers of single features and of whole rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.functions import kernels
from lodewright.functions.special import probit
from lodewright.operators.missing import MissingHandler, _moments
from lodewright.operators.neighbours import local_outlier_factor
from lodewright.operators.profile import Roles, collect_stats, feature_stats, long_form, missing_as_null
from lodewright.operators.running import even_quantile_row, quantile_row


def fences(stats: DataFrame) -> DataFrame:
    """(`feature`, `lower`, `upper`): 1.5 interquartile ranges beyond the quartiles."""
    iqr = F.col("q3") - F.col("q1")
    return stats.select("feature", "is_binary", (F.col("q1") - 1.5 * iqr).alias("lower"), (F.col("q3") + 1.5 * iqr).alias("upper"))


def outlier_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(`feature`, `lower`, `upper`, `n_outliers`) of the features that are not binary; missing values count."""
    bounds = fences(feature_stats(df, cols)).where(~F.col("is_binary"))
    inside = F.coalesce(F.col("x").between(F.col("lower"), F.col("upper")), F.lit(False))
    return (
        long_form(df, cols).join(F.broadcast(bounds), "feature")  # one row per column
        .groupBy("feature", "lower", "upper").agg(F.count_if(~inside).alias("n_outliers"))
    )


def yeo_johnson(x: Column, lam: float) -> Column:
    """The power transform for one exponent."""
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _transformed(x: np.ndarray, lam: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        up = np.log1p(x) if abs(lam) < 1e-12 else ((x + 1) ** lam - 1) / lam
        down = -np.log1p(-x) if abs(lam - 2) < 1e-12 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, up, down)


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], passes: int = 4, points: int = 17) -> dict[str, tuple[float, float, float]]:
    """Exponent of greatest likelihood, mean and deviation by column.

    Each pass tries a finer grid for all columns at once: batches return count, mean and squares about it, which are
    merged exactly.
    """
    low, high = {c: -3.0 for c in cols}, {c: 5.0 for c in cols}
    best: dict[str, tuple[float, float, float]] = {}
    values = df.select(*(F.col(c).cast("double") for c in cols))
    for _ in range(passes if cols else 0):
        grids = [np.linspace(low[c], high[c], points) for c in cols]

        def run(frames: Iterator[pd.DataFrame], grids: list = grids) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for i, grid in enumerate(grids):
                    x = frame.iloc[:, i].to_numpy(float)
                    x = x[~np.isnan(x)]
                    logs = float((np.sign(x) * np.log1p(np.abs(x))).sum())
                    for j, lam in enumerate(grid):
                        y = _transformed(x, float(lam))
                        rows.append((i, j, len(x), logs, float(y.mean()) if len(y) else 0.0, float(y.var() * len(y)) if len(y) else 0.0))
                yield pd.DataFrame(rows, columns=["i", "j", "n", "logs", "m", "s"])

        parts = values.mapInPandas(run, "i int, j int, n long, logs double, m double, s double")
        each = parts.groupBy("i", "j").agg(
            F.sum("n").alias("n"), F.sum("logs").alias("logs"), F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("s").alias("s"),
            F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"),
        ).toPandas()
        for i, c in enumerate(cols):
            scored = []
            for r in each[(each["i"] == i) & (each["n"] > 0)].itertuples():
                mean = r.total / r.n
                v = (r.s + r.squares - r.n * mean * mean) / r.n
                likelihood = -math.inf if not v > 0 else -r.n / 2 * math.log(v) + (grids[i][r.j] - 1) * r.logs
                scored.append((likelihood, -r.j, mean, v))
            _, j, mean, v = max(scored, default=(0.0, -(points // 2), 0.0, 1.0))
            best[c] = float(grids[i][-j]), mean, max(v, 0.0) ** 0.5 or 1.0
            step = grids[i][1] - grids[i][0]
            low[c], high[c] = grids[i][-j] - step, grids[i][-j] + step
    return best


def quantile_map(x: Column, grid: Sequence[float]) -> Column:
    """Place of a value among fitted quantiles, from 0 to 1: interpolated from both sides, so that ties get the middle."""
    q = np.asarray(grid, float)
    p = np.linspace(0, 1, len(q))
    keys = np.unique(q)
    lo = np.array([p[np.searchsorted(q, v, "left")] for v in keys])
    hi = np.array([p[np.searchsorted(q, v, "right") - 1] for v in keys])

    @F.pandas_udf("double")
    def place(values: pd.Series) -> pd.Series:
        v = values.to_numpy(float)
        up, down = np.interp(v, keys, hi), np.interp(v, keys, lo)
        return pd.Series(np.where(np.isnan(v), np.nan, (up + down) / 2)).where(~np.isnan(v), None)

    return F.when(x.isNotNull(), place(x))


METHODS = ("iqr", "winsorization", "imputation", "power", "normal", "uniform")


@dataclass(frozen=True)
class UnivariateOutliersHandler:
    """Treats features that have outliers by the interquartile rule.

    `iqr` empties the row's treated features (`iqr_mode="null"`) or drops the row (`"drop"`); `winsorization` caps;
    `imputation` empties and refills with a `MissingHandler`; `power` is Yeo-Johnson, standardised; `uniform` and
    `normal` map to the quantiles of those distributions over at most 1000 fitted quantiles.
    """

    method: str = "uniform"
    strategy: str = "mean"
    threshold: float = 40.0
    neighbours: int = 5
    iqr_mode: str = "null"
    roles: Roles = Roles()
    deactivate: bool = False
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    state: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> UnivariateOutliersHandler:
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")
        if self.deactivate:
            return self
        df = missing_as_null(df)
        bad = [r for r in outlier_counts(df, self.roles.features(df)).where("n_outliers > 0").collect() if r["lower"] is not None]
        place = {c: i for i, c in enumerate(df.columns)}
        bounds = {r["feature"]: (r["lower"], r["upper"]) for r in sorted(bad, key=lambda r: place[r["feature"]])}
        cols, state = list(bounds), {}
        if self.method == "power":
            state = fit_yeo_johnson(df, cols)
        elif self.method in ("uniform", "normal") and cols:
            n = min(1000, df.count())
            found = even_quantile_row(df, {c: F.col(c) for c in cols}, n)
            state = {c: tuple(found[c]) for c in cols if c in found}
        fitted = replace(self, bounds=bounds, state=state)
        if self.method == "imputation":
            filler = MissingHandler(100.0, self.strategy, self.neighbours, roles=self.roles)
            fitted = replace(fitted, state={"filler": filler.fit(fitted._emptied(df))})
        return fitted

    def _outside(self, c: str) -> Column:
        low, high = self.bounds[c]
        return (F.col(c) < low) | (F.col(c) > high)

    def _emptied(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(~self._outside(c), F.col(c).cast("double")) for c in self.bounds})

    def transform(self, df: DataFrame) -> DataFrame:
        if self.deactivate:
            return df
        df, cols = missing_as_null(df), [c for c in self.bounds if c in df.columns]
        if not cols:
            return df
        if self.method == "iqr":
            inside = F.lit(True)
            for c in cols:
                inside = inside & F.coalesce(F.col(c).between(*self.bounds[c]), F.lit(False))
            if self.iqr_mode == "drop":
                return df.where(inside)
            marked = df.withColumn("__inside", inside)
            return marked.withColumns({c: F.when(F.col("__inside"), F.col(c).cast("double")) for c in cols}).drop("__inside")
        if self.method == "winsorization":
            low, high = (lambda c: F.lit(self.bounds[c][0])), (lambda c: F.lit(self.bounds[c][1]))
            return df.withColumns({c: F.when(F.col(c) < low(c), low(c)).when(F.col(c) > high(c), high(c)).otherwise(F.col(c).cast("double")) for c in cols})
        if self.method == "imputation":
            return self.state["filler"].transform(self._emptied(df)).select(*df.columns)
        if self.method == "power":
            return df.withColumns({c: (yeo_johnson(F.col(c).cast("double"), self.state[c][0]) - self.state[c][1]) / self.state[c][2] for c in cols})
        mapped = {c: quantile_map(F.col(c).cast("double"), self.state[c]) for c in cols}
        return df.withColumns({c: probit(m) if self.method == "normal" else m for c, m in mapped.items()})


def _isolation_tree(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> dict | tuple[int]:
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
    if depth >= limit or not len(spread):
        return (len(x),)
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    below = x[:, f] < cut
    return {"f": f, "cut": cut, "lo": _isolation_tree(x[below], rng, depth + 1, limit), "hi": _isolation_tree(x[~below], rng, depth + 1, limit)}


def _mean_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _depths(tree, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if isinstance(tree, tuple):
        return np.full(len(x), depth + _mean_path(tree[0]))
    out, below = np.empty(len(x)), x[:, tree["f"]] < tree["cut"]
    out[below], out[~below] = _depths(tree["lo"], x[below], depth + 1), _depths(tree["hi"], x[~below], depth + 1)
    return out


def grow_isolation(df: DataFrame, cols: Sequence[str], id_col: str, trees: int = 100, sample: int = 256, seed: int = 42) -> tuple[list, int]:
    """Isolation trees, each on `sample` rows as the method defines it, and how many rows a tree was grown on.

    A row is offered to as many trees as a hash of its id says (few), so the table is read once and a row is not
    copied for every tree; each tree takes the first of its rows by hash.
    """
    kept = df.count()
    rate = 4.0 * sample / max(kept, 1)
    if rate >= 1:
        offered = df.select(*cols, F.col(id_col).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    else:
        # Gaps between a row's trees are geometric with the rate, by inversion of hashes: about trees * rate copies a row.
        @F.pandas_udf("array<int>")
        def chosen(h: pd.Series) -> pd.Series:
            out = []
            for value in h.to_numpy(np.int64):
                rng = np.random.default_rng([seed, int(value) & 0xFFFFFFFF, (int(value) >> 32) & 0xFFFFFFFF])
                out.append(np.flatnonzero(rng.random(trees) < rate).astype(np.int32))
            return pd.Series(out)

        offered = df.select(*cols, F.col(id_col).alias("i"), F.explode(chosen(F.xxhash64(F.lit(seed), F.col(id_col)))).alias("tree"))
    small = offered.withColumn("h", F.xxhash64(F.lit(seed), "tree", "i"))
    grown = small.groupBy("tree").applyInPandas(
        lambda g: pd.DataFrame({"tree": [int(g["tree"].iloc[0])], "model": [repr(_grow(g.nsmallest(sample, "h")[list(cols)].to_numpy(float), seed + int(g["tree"].iloc[0])))]}), "tree long, model string"
    )
    import ast

    return [ast.literal_eval(r["model"]) for r in grown.orderBy("tree").collect()], min(sample, kept)


def isolation_scores(df: DataFrame, cols: Sequence[str], models: list, size: int) -> DataFrame:
    """The rows with `score`, from 0 to 1 (isolated): every row is scored by all trees in Arrow batches."""

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in xs])
        mean = np.mean([_depths(m, x) for m in models], axis=0)
        return pd.Series(2.0 ** (-mean / max(_mean_path(size), 1e-9)))

    return df.withColumn("score", score(*(F.col(c).cast("double") for c in cols)))


def _grow(x: np.ndarray, seed: int):
    return _isolation_tree(x, np.random.default_rng(seed), 0, max(1, math.ceil(math.log2(max(2, len(x))))))


MULTIVARIATE = ("LocalOutlierFactor", "IsolationForest", "OneClassSVM", "RobustCovariance", "EmpiricalCovariance")


def inverted(s: np.ndarray) -> np.ndarray:
    """The inverse on the directions that vary; repeated columns leave some that do not."""
    return np.linalg.pinv(s, rcond=1e-9, hermitian=True)


def mahalanobis_of(df: DataFrame, cols: Sequence[str], mean: np.ndarray, inverse: np.ndarray) -> DataFrame:
    """The rows with `d2`, in Arrow batches: one product of matrices for each."""

    @F.pandas_udf("double")
    def run(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in xs]) - mean
        return pd.Series(np.einsum("ij,jk,ik->i", x, inverse, x))

    return df.withColumn("d2", run(*(F.col(c).cast("double") for c in cols)))


def _concentrate(df: DataFrame, cols: list[str], mean: np.ndarray, inverse: np.ndarray, steps: int, share: float = 0.5) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentration steps: moments of the share of rows nearest to the moments before. Gives the log determinant, too."""
    log_det = np.inf
    for _ in range(steps):
        scored = mahalanobis_of(df, cols, mean, inverse)
        half = quantile_row(scored, {"d2": F.col("d2")}, [share]).get("d2", [0.0])[0]
        n, new, s = _moments(scored.where(F.col("d2") <= half), cols, F.lit(True))
        s = s / max(n, 1)
        before, log_det, inverse = log_det, float(np.linalg.slogdet(s + 1e-12 * np.eye(len(cols)))[1]), inverted(s)
        still = np.allclose(new, mean, rtol=1e-9, atol=1e-12) or abs(before - log_det) <= 1e-4
        mean = new
        if still:
            break
    return log_det, mean, inverse


#: Rows of the first stage of the covariance of least determinant, as the published algorithm has them.
FIRST_ROWS = 1500


def _small_steps(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentration steps on rows in memory."""
    log_det, half = np.inf, max(2, (len(x) + 1) // 2)
    for _ in range(steps):
        v = x - mean
        near = x[np.argsort(np.einsum("ij,jk,ik->i", v, inverse, v), kind="stable")[:half]]
        new, s = near.mean(0), np.atleast_2d(np.cov(near.T, bias=True))
        log_det, inverse = float(np.linalg.slogdet(s + 1e-12 * np.eye(x.shape[1]))[1]), inverted(s)
        still = np.allclose(new, mean, rtol=1e-9, atol=1e-12)
        mean = new
        if still:
            break
    return log_det, mean, inverse


def robust_moments(df: DataFrame, cols: list[str], starts: int = 500, kept: int = 2, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse covariance of the half of all rows with the least determinant (Rousseeuw and Van Driessen, 1999).

    `starts` random small sets take two concentration steps on the first stage's rows (`FIRST_ROWS` by order of a hash),
    the ten best are concentrated there, and the best `kept` of them on all rows, which alone decide.
    """
    from lodewright.session import Scratch

    rows = Scratch(df.sparkSession).save(df.select(*(F.col(c).cast("double").alias(c) for c in cols)))
    first = rows.orderBy(F.xxhash64(F.lit(seed), *cols), *cols).limit(FIRST_ROWS).toPandas().to_numpy(float)
    if len(first) < 2:
        return (first.mean(0) if len(first) else np.zeros(len(cols))), np.zeros((len(cols), len(cols)))
    rng, tried = np.random.default_rng(seed), []
    for _ in range(starts):
        part = first[rng.choice(len(first), min(len(cols) + 1, len(first)), replace=False)]
        inverse = inverted(np.atleast_2d(np.cov(part.T, bias=True)) + 1e-9 * np.eye(len(cols)))
        tried.append(_small_steps(first, part.mean(0), inverse, 2))
    best = sorted((_small_steps(first, m, v, 50) for _, m, v in sorted(tried, key=lambda t: t[0])[:10]), key=lambda t: t[0])
    _, mean, inverse = min((_concentrate(rows, cols, m, v, 6) for _, m, v in best[:kept]), key=lambda t: t[0])
    return mean, inverse


@dataclass(frozen=True)
class MultivariateOutliersHandler:
    """Drops rows that are outliers as a whole; rows with a missing feature must be filled before.

    `LocalOutlierFactor`: factor above 1.5 with 20 neighbours, new rows against the fitted ones (rows whose id is among
    the fitted ones count as those); `IsolationForest`: score above 0.5 on the trees grown at fitting; `OneClassSVM`:
    negative margin; the covariance methods: the tenth of fitted rows with the greatest Mahalanobis distance, from the
    moments of all rows (`EmpiricalCovariance`) or of the tightest half (`RobustCovariance`).
    """

    method: str = "LocalOutlierFactor"
    seed: int = 42
    nu: float = 0.5
    roles: Roles = Roles()
    deactivate: bool = False
    fitted: DataFrame | None = None
    state: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> MultivariateOutliersHandler:
        if self.method not in MULTIVARIATE:
            raise ValueError(f"method must be one of {', '.join(MULTIVARIATE)}")
        if self.deactivate:
            return self
        cols = self.roles.features(df)
        if not cols:
            return self
        if self.method == "LocalOutlierFactor":
            return replace(self, fitted=df, state={"cols": cols})
        if self.method == "IsolationForest":
            models, size = grow_isolation(df, cols, self.roles.id, seed=self.seed)
            return replace(self, state={"cols": cols, "models": models, "size": size})
        if self.method == "OneClassSVM":
            m = kernels.one_class(df, cols, self.nu)
            return replace(self, state={"cols": cols, "gamma": m.features.gamma, "half": m.features.half, "shift": m.shift.tolist(), "weights": m.weights.tolist()})
        if self.method == "RobustCovariance":
            mean, inverse = robust_moments(df, cols, seed=self.seed)
        else:
            n, mean, s = _moments(df, cols, F.lit(True))
            inverse = inverted(s / max(n, 1))
        cut = quantile_row(mahalanobis_of(df, cols, mean, inverse), {"d2": F.col("d2")}, [0.9]).get("d2", [0.0])[0]
        return replace(self, state={"cols": cols, "mean": mean.tolist(), "inverse": inverse.tolist(), "cut": cut})

    def transform(self, df: DataFrame) -> DataFrame:
        if self.deactivate or not self.state:
            return df
        cols, state = self.state["cols"], self.state
        if self.method == "LocalOutlierFactor":
            vectors = lambda t: t.select(F.col(self.roles.id).alias("id"), F.array(*(F.col(c).cast("double") for c in cols)).alias("x"))
            own = vectors(self.fitted)
            new = df.join(self.fitted.select(self.roles.id), self.roles.id, "left_anti")
            good = local_outlier_factor(own, 20).where("lof <= 1.5").select("id")
            if not new.isEmpty():
                good = good.unionByName(local_outlier_factor(own, 20, vectors(new)).where("lof <= 1.5").select("id"))
            return df.join(good.withColumnRenamed("id", self.roles.id), self.roles.id, "left_semi")
        if self.method == "IsolationForest":
            return isolation_scores(df, cols, state["models"], state["size"]).where("score <= 0.5").drop("score")
        if self.method == "OneClassSVM":
            machine = kernels.Machine(kernels.RandomFeatures(len(cols), state["gamma"], state["half"]), np.array(state["shift"]), np.array(state["weights"]))
            return df.withColumn("__m", kernels.margin_column(machine, cols)).where("__m >= 0").drop("__m")
        return mahalanobis_of(df, cols, np.array(state["mean"]), np.array(state["inverse"])).where(F.col("d2") <= state["cut"]).drop("d2")


def compare_removal(df: DataFrame, handlers: dict[str, object], others: dict[str, DataFrame] | None = None) -> DataFrame:
    """(`data`, `method`, `n_rows`, `n_left`, `n_removed`, `removed_pct`): what each handler, fitted on `df`, leaves of it and of
    other tables."""
    rows = []
    for name, handler in handlers.items():
        fitted = handler.fit(df)
        for data, table in ({"train": df} | (others or {})).items():
            n, left = table.count(), fitted.transform(table).count()
            rows.append((data, name, n, left, n - left, round(100.0 * (n - left) / max(n, 1), 6)))
    return df.sparkSession.createDataFrame(rows, "data string, method string, n_rows long, n_left long, n_removed long, removed_pct double")
