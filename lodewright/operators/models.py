"""Models by name over `pyspark.ml`, with a common way to fit, score and inspect them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.functions import kernels
from lodewright.operators import boosting, forest
from lodewright.operators.neighbours import vote


def target_type(df: DataFrame, y: str) -> str:
    """`C` for exactly two distinct values (missing counts as one), `R` for more."""
    n = df.select(F.col(y).cast("double").alias("y")).distinct().limit(3).count()
    if n < 2:
        raise ValueError("the target needs at least two distinct values")
    return "C" if n == 2 else "R"


@dataclass
class Fitted:
    """A fitted model: `score(df)` adds `predicted` and, for classes, `probability` of class 1.

    `kind` and `state` (numbers, Spark models, tables or a function of arrays) are what it is saved by and made from.
    """

    name: str
    cols: list[str]
    classification: bool
    score_fn: Callable[[DataFrame], DataFrame]
    kind: str = "own"
    state: dict = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        return self.score_fn(df)


def _assembled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="__x", handleInvalid="error").transform(df)


def _spark(name: str, estimator, df: DataFrame, cols: list[str], y: str, classification: bool) -> Fitted:
    model = estimator.setFeaturesCol("__x").setLabelCol("__y").fit(_assembled(df, cols).withColumn("__y", F.col(y).cast("double")))
    return _of_spark(name, cols, classification, {"models": [model]})


def _of_spark(name: str, cols: list[str], classification: bool, state: dict) -> Fitted:
    model = state["models"][0]

    def score(rows: DataFrame) -> DataFrame:
        out = model.transform(_assembled(rows, cols))
        extra = {"predicted": F.col("prediction")}
        if "probability" in out.columns:
            extra["probability"] = vector_to_array("probability")[1]
        elif classification:
            extra["probability"] = F.col("prediction")
        return out.withColumns({f"__{k}": v for k, v in extra.items()}).select(*rows.columns, *(F.col(f"__{k}").alias(k) for k in extra))

    return Fitted(name, cols, classification, score, "spark", state)


def _dummy(df: DataFrame, cols: list[str], y: str, classification: bool) -> Fitted:
    counts = df.groupBy(F.col(y).cast("double").alias("v")).agg(F.count("*").alias("n")).where("v is not null")
    row = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))), F.sum(F.col("v") * F.col("n")) / F.sum("n")).first()
    return _of_dummy("Dummy", cols, classification, {"mode": row[0], "mean": row[1]})


def _of_dummy(name: str, cols: list[str], classification: bool, state: dict) -> Fitted:
    def score(rows: DataFrame) -> DataFrame:
        value = F.lit(state["mode"] if classification else state["mean"])
        return rows.withColumns({"predicted": value, **({"probability": F.lit(state["mean"])} if classification else {})})

    return Fitted(name, cols, classification, score, "dummy", state)


def _neighbours(df: DataFrame, cols: list[str], y: str, classification: bool, k: int = 5, id_col: str = "rec_id") -> Fitted:
    fitted = df.select(F.col(id_col).alias("id"), F.array(*(F.col(c).cast("double") for c in cols)).alias("x"), F.col(y).cast("double").alias("y"))
    return _of_neighbours("KNeighbors", cols, classification, {"table": fitted, "k": k, "id_col": id_col})


def _of_neighbours(name: str, cols: list[str], classification: bool, state: dict) -> Fitted:
    fitted, k, id_col = state["table"], state["k"], state["id_col"]

    def score(t: DataFrame) -> DataFrame:
        rows = t.select(F.col(id_col).alias("id"), F.array(*(F.col(c).cast("double") for c in cols)).alias("x"))
        found = vote(rows, fitted, "y", k, classification, "probability" if classification else None)
        return t.join(found.withColumnRenamed("id", id_col), id_col)

    return Fitted(name, cols, classification, score, "neighbours", state)


def _boosted(df: DataFrame, cols: list[str], y: str, classification: bool, rounds: int = 50) -> Fitted:
    """Adaptive boosting of weighted trees: stumps for classes, depth 3 with the linear loss of the second kind for numbers."""
    from lodewright.session import Scratch

    scratch = Scratch(df.sparkSession)
    rows = scratch.save(_assembled(df, cols).select("__x", F.col(y).cast("double").alias("__y"), F.lit(1.0).alias("__w")))
    trees, betas = [], []
    for _ in range(rounds):
        tree = (DecisionTreeClassifier(maxDepth=1) if classification else DecisionTreeRegressor(maxDepth=3)).setFeaturesCol("__x").setLabelCol("__y").setWeightCol("__w").fit(rows)
        scored = tree.transform(rows).select("__x", "__y", "__w", "prediction")
        miss = F.abs(F.col("prediction") - F.col("__y"))
        top = scored.agg(F.max(miss)).first()[0] or 0.0
        if classification:
            error = scored.agg(F.sum(F.when(miss > 0, F.col("__w")).otherwise(0.0)) / F.sum("__w")).first()[0]
        else:
            error = scored.agg(F.sum(F.col("__w") * miss / F.lit(top or 1.0)) / F.sum("__w")).first()[0]
        if top == 0 or error >= 0.5:
            if not trees:
                trees, betas = [tree], [1.0]
            break
        weight = float(np.log((1 - error) / max(error, 1e-10)))
        trees.append(tree)
        betas.append(weight)
        factor = F.when(miss > 0, F.lit(np.exp(weight))).otherwise(1.0) if classification else F.pow(F.lit(np.exp(-weight)), 1 - miss / F.lit(top))
        following = scratch.save(scored.select("__x", "__y", (F.col("__w") * factor).alias("__w")))
        scratch.drop(rows)
        rows = following
        if error <= 1e-10:
            break

    weights = dict.fromkeys(cols, 0.0)
    for b, tree in zip(betas, trees, strict=True):
        for c, w in zip(cols, tree.featureImportances.toArray(), strict=True):
            weights[c] += b * float(w) / (sum(betas) or 1.0)
    return _of_boosted("AdaBoost", cols, classification, {"models": trees, "betas": betas, "weights": weights})


def _of_boosted(name: str, cols: list[str], classification: bool, state: dict) -> Fitted:
    trees, betas = state["models"], state["betas"]

    def score(t: DataFrame) -> DataFrame:
        out = _assembled(t, cols)
        names = []
        for i, tree in enumerate(trees):
            out = tree.transform(out).select(*t.columns, "__x", *names, F.col("prediction").alias(f"__t{i}"))
            names.append(f"__t{i}")
        total = sum(betas) or 1.0
        if classification:
            p = sum((F.lit(b / total) * F.col(n) for b, n in zip(betas, names, strict=True)), F.lit(0.0))
            return out.select(*t.columns, F.when(p > 0.5, 1.0).otherwise(0.0).alias("predicted"), p.alias("probability"))
        votes = F.array_sort(F.array(*(F.struct(F.col(n).alias("v"), F.lit(b).alias("b")) for b, n in zip(betas, names, strict=True))))
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("v"))
        median = F.aggregate(votes, start, lambda a, x: F.struct((a["s"] + x["b"]).alias("s"), F.when(a["v"].isNull() & (a["s"] + x["b"] >= total / 2), x["v"]).otherwise(a["v"]).alias("v")))
        return out.select(*t.columns, median["v"].alias("predicted"))

    return Fitted(name, cols, classification, score, "boosted", state, state["weights"])


def _numpy(name: str, cols: list[str], classification: bool, predict: Callable[[np.ndarray], np.ndarray], weights: dict | None = None) -> Fitted:
    """A model that scores rows in Arrow batches."""

    @F.pandas_udf("double")
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series(predict(np.column_stack([x.to_numpy(float) for x in xs])))

    def score(rows: DataFrame) -> DataFrame:
        value: Column = run(*(F.col(c).cast("double") for c in cols))
        if not classification:
            return rows.withColumn("predicted", value)
        return rows.withColumn("probability", value).withColumn("predicted", F.when(F.col("probability") > 0.5, 1.0).otherwise(0.0))

    return Fitted(name, cols, classification, score, "arrays", {"function": predict, "weights": weights or {}}, weights or {})


def _kernel_machine(df: DataFrame, cols: list[str], y: str, classification: bool, c: float = 1.0, epsilon: float = 0.1, gamma: float | None = None) -> Fitted:
    """Radial-basis machine over random features, on all rows."""
    if not classification:
        machine = kernels.support_regressor(df, cols, y, c, epsilon, gamma)
        return _numpy("SVM", cols, False, machine.margins)
    machine, slope, offset = kernels.support_classifier(df, cols, y, c, gamma)
    return _numpy("SVM", cols, True, lambda x: 1 / (1 + np.exp(-np.clip(slope * machine.margins(x) + offset, -30, 30))))


def _second_order(name: str, df: DataFrame, cols: list[str], y: str, classification: bool, **params) -> Fitted:
    """`XGB`: depth-wise trees, rate 0.3; `CatBoost`: symmetric trees, rate 0.1 and stronger shrinkage of leaves."""
    settings = {"XGB": {"rate": 0.3, "depth": 6, "l2": 1.0}, "CatBoost": {"rate": 0.1, "depth": 6, "l2": 3.0, "symmetric": True}}[name] | params
    model = boosting.boost(df, cols, y, classification, **settings)
    total = float(model.gains.sum()) or 1.0
    return _numpy(name, cols, classification, model.predict, {c: float(g) / total for c, g in zip(cols, model.gains, strict=True)})


def _extra_trees(df: DataFrame, cols: list[str], y: str, classification: bool, trees: int = 100, groups: int = 10, cuts: int = 10, maxDepth: int = 20) -> Fitted:
    """Trees on all rows without resampling whose cuts are random: each group of trees knows `cuts` random places in
    the range of every feature and chooses among those only."""
    low_high = df.agg(*(f(F.col(c).cast("double")) for c in cols for f in (F.min, F.max))).first()
    groups, parts = min(groups, trees), []
    for g in range(groups):
        rng = np.random.default_rng(42 + g)
        places = []
        for i in range(len(cols)):
            low, high = low_high[2 * i] or 0.0, low_high[2 * i + 1] or 0.0
            inner = np.unique(rng.uniform(low, high, cuts)) if high > low else np.array([low + 0.5])
            places.append([float(v) for v in inner])
        n = trees // groups + (g < trees % groups)
        settings = dict(numTrees=n, maxDepth=maxDepth, bootstrap=False, seed=42 + g, maxBins=max(32, cuts + 2), featureSubsetStrategy="sqrt" if classification else "all")
        maker = RandomForestClassifier if classification else RandomForestRegressor
        prepared = _cut(df, cols, places).withColumn("__y", F.col(y).cast("double"))
        parts.append((n, places, maker(**settings).setFeaturesCol("__x").setLabelCol("__y").fit(prepared)))
    weights = np.sum([n / trees * model.featureImportances.toArray() for n, _, model in parts], axis=0)
    return _of_extra_trees(
        "ExtraTrees", cols, classification,
        {"models": [m for *_, m in parts], "sizes": [n for n, *_ in parts], "places": [p for _, p, _ in parts], "weights": dict(zip(cols, map(float, weights), strict=True))},
    )


def _cut(df: DataFrame, cols: Sequence[str], places: list[list[float]]) -> DataFrame:
    """The rows with `__x`, the number of the interval each feature is in."""
    from pyspark.ml.feature import Bucketizer

    names = [(f"__f{i}", f"__b{i}") for i in range(len(cols))]
    ends = [[-float("inf"), *p, float("inf")] for p in places]
    cutter = Bucketizer(splitsArray=ends, inputCols=[a for a, _ in names], outputCols=[b for _, b in names])
    return _assembled(cutter.transform(df.withColumns({a: F.col(c).cast("double") for (a, _), c in zip(names, cols, strict=True)})), [b for _, b in names])


def _of_extra_trees(name: str, cols: list[str], classification: bool, state: dict) -> Fitted:
    total = sum(state["sizes"])

    def score(rows: DataFrame) -> DataFrame:
        out, names = rows, []
        for g, (places, model) in enumerate(zip(state["places"], state["models"], strict=True)):
            value = vector_to_array("probability")[1] if classification else F.col("prediction")
            out = model.transform(_cut(out, cols, places)).select(*rows.columns, *names, value.alias(f"__g{g}"))
            names.append(f"__g{g}")
        mean = sum((F.col(f"__g{g}") * F.lit(n / total) for g, n in enumerate(state["sizes"])), F.lit(0.0))
        if not classification:
            return out.select(*rows.columns, mean.alias("predicted"))
        return out.select(*rows.columns, F.when(mean > 0.5, 1.0).otherwise(0.0).alias("predicted"), mean.alias("probability"))

    return Fitted(name, cols, classification, score, "extra_trees", state, state["weights"])


def _forest(df: DataFrame, cols: list[str], y: str, classification: bool, **params) -> Fitted:
    """A forest of 100 trees of at most 30 levels; its trees are a table (`forest`)."""
    settings = {"numTrees": 100, "maxDepth": 30, "featureSubsetStrategy": "sqrt" if classification else "all", "seed": 42} | params
    return _of_forest("RandomForest", cols, classification, forest.fit(df, cols, y, **settings))


def _of_forest(name: str, cols: list[str], classification: bool, state: dict) -> Fitted:
    def score(rows: DataFrame) -> DataFrame:
        if not classification:
            return forest.means(rows, cols, state, "predicted")
        return forest.means(rows, cols, state, "probability").withColumn("predicted", F.when(F.col("probability") > 0.5, 1.0).otherwise(0.0))

    return Fitted(name, cols, classification, score, "forest", state, state["weights"])


#: How a model is made again from what was saved of it.
REBUILD: dict[str, Callable[[str, list[str], bool, dict], Fitted]] = {
    "spark": _of_spark, "dummy": _of_dummy, "neighbours": _of_neighbours, "boosted": _of_boosted, "extra_trees": _of_extra_trees, "forest": _of_forest,
    "arrays": lambda name, cols, classification, state: _numpy(name, cols, classification, state["function"], state["weights"]),
}


def _covariances(sums: np.ndarray) -> np.ndarray:
    """Covariances of the columns after the first, from sums of products of which the first column is 1."""
    n = max(sums[0, 0], 1.0)
    return sums[1:, 1:] / n - np.outer(sums[0, 1:], sums[0, 1:]) / (n * n)


def _elastic(cov: np.ndarray, alpha: float, elastic: float, start: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Coefficients of the linear model that Spark's `LinearRegression` fits without standardisation, by coordinate descent
    on covariances (the target's last). Spark scales the target first, so its squared penalty is over the target's deviation."""
    d = len(start)
    g, c, sigma = cov[:d, :d], cov[:d, d], max(cov[d, d], 0.0) ** 0.5 or 1.0
    lasso, ridge, coef = alpha * elastic, alpha * (1 - elastic) / sigma, start.copy()
    width = np.sqrt(np.maximum(np.diag(g), 0.0))
    open_ = np.flatnonzero(width > 1e-12)
    coef[width <= 1e-12] = 0.0
    gradient = c - g @ coef
    for _ in range(rounds):
        most = 0.0
        for j in open_:
            z = gradient[j] + g[j, j] * coef[j]
            new = np.sign(z) * max(abs(z) - lasso, 0.0) / (g[j, j] + ridge)
            if new != coef[j]:
                gradient -= g[:, j] * (new - coef[j])
                most = max(most, abs(new - coef[j]) * width[j])
                coef[j] = new
        if most <= 1e-9 * sigma:
            break
    return coef


def path_cv(name: str, df: DataFrame, cols: list[str], y: str, elastic: float, n_alphas: int = 20, folds: int = 5, eps: float = 1e-3, id_cols: Sequence[str] | None = None) -> Fitted:
    """Linear model with the penalty of least mean squared error over `folds` folds, from a path of penalties that falls
    from the least one that empties the model to `eps` times it.

    Fits and errors need sums of products by fold only: one pass over the rows serves all folds and penalties.
    """
    from lodewright.session import Scratch

    scratch = Scratch(df.sparkSession)
    fold = F.pmod(F.xxhash64(F.lit(42), *(id_cols or [*cols, y])), F.lit(folds))
    rows = scratch.save(df.select(*cols, F.col(y).cast("double").alias(y), fold.alias("__fold")))
    d, means = len(cols), rows.agg(*(F.avg(F.col(c).cast("double")) for c in cols), F.avg(y)).first()
    shift = np.array([v or 0.0 for v in means])

    def moments(x: np.ndarray) -> np.ndarray:
        v = np.column_stack([np.ones(len(x)), x[:, :-1] - shift])
        return np.concatenate([(v[at].T @ v[at]).ravel() for at in (x[:, -1] == k for k in range(folds))])

    numbers = rows.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)), F.col(y).alias("y"), F.col("__fold").cast("double").alias("f"))
    by_fold = kernels.summed(numbers, moments).reshape(-1, d + 2, d + 2)
    center = _covariances(by_fold.sum(0))[:d, d] if len(by_fold) else []
    top = max((abs(v) for v in center), default=0.0) / max(elastic, 1e-3) or 1.0
    path = top * np.logspace(0, np.log10(eps), n_alphas)
    errors = np.zeros(n_alphas)
    for test in by_fold:
        train = by_fold.sum(0) - test
        if train[0, 0] < 0.5 or test[0, 0] < 0.5:
            continue
        cov, coef = _covariances(train), np.zeros(d)
        for i, alpha in enumerate(path):
            coef = _elastic(cov, float(alpha), elastic, coef)
            offset = (train[0, d + 1] - train[0, 1 : d + 1] @ coef) / train[0, 0]
            u = np.concatenate([[offset], coef, [-1.0]])
            errors[i] += float(u @ test @ u)
    best = float(path[int(np.argmin(errors))])
    return _spark(name, LinearRegression(regParam=best, elasticNetParam=elastic, standardization=False), df, cols, y, False)


#: Names of models for classes and for numbers.
CLASSIFIERS = ("Dummy", "Logistic", "KNeighbors", "SVM", "RandomForest", "ExtraTrees", "AdaBoost", "GradientBoosting", "XGB", "CatBoost", "MLP")
REGRESSORS = ("Dummy", "Linear", "KNeighbors", "SVM", "RandomForest", "ExtraTrees", "AdaBoost", "GradientBoosting", "XGB", "CatBoost", "MLP", "Ridge", "ElasticNetCV", "ElasticNet", "Lasso", "LassoCV")
REGISTRY: dict[str, Callable] = {}


def add_model(name: str, fit: Callable[[DataFrame, list[str], str, bool], Fitted]) -> None:
    """Register a model of the user's own."""
    REGISTRY[name] = fit


def fit_model(name: str, df: DataFrame, cols: Sequence[str], y: str, classification: bool, **params) -> Fitted:
    """Fit a model by name, on all rows of `df`. `XGB` and `CatBoost` are second-order boosting (`boosting`)."""
    cols = list(cols)
    if name in REGISTRY:
        return REGISTRY[name](df, cols, y, classification, **params)
    if name == "Dummy":
        return _dummy(df, cols, y, classification)
    if name == "KNeighbors":
        return _neighbours(df, cols, y, classification, **params)
    if name == "AdaBoost":
        return _boosted(df, cols, y, classification, **params)
    if name == "SVM" and params.get("kernel") != "linear":
        return _kernel_machine(df, cols, y, classification, **params)
    if name == "RandomForest":
        return _forest(df, cols, y, classification, **params)
    if name == "ExtraTrees":
        return _extra_trees(df, cols, y, classification, **params)
    if name == "MLP" and not classification:
        return _numpy("MLP", cols, False, kernels.perceptron(df, cols, y, **params))
    if name in ("XGB", "CatBoost"):
        return _second_order(name, df, cols, y, classification, **params)
    if name in ("ElasticNetCV", "LassoCV"):
        return path_cv(name, df, cols, y, **({"elastic": 1.0 if name == "LassoCV" else 0.5} | params))
    n = None
    if name in ("Logistic", "Ridge"):
        n, sigma = df.agg(F.count("*"), F.stddev_pop(F.col(y).cast("double"))).first()
    if name == "GradientBoosting":
        settings = dict(maxIter=100, stepSize=0.1, maxDepth=3, seed=42) | params
        return _spark(name, GBTClassifier(**settings) if classification else GBTRegressor(**settings), df, cols, y, classification)
    if classification:
        makers = {
            "Logistic": lambda C=1.0, **k: LogisticRegression(regParam=1 / (C * max(n, 1)), standardization=False, **k),
            "SVM": lambda kernel="linear", C=1.0, **k: LinearSVC(regParam=1 / C / 100, **k),
            "MLP": lambda hidden=150, **k: MultilayerPerceptronClassifier(layers=[len(cols), hidden, 2], seed=42, **k),
        }
    else:
        makers = {
            "Linear": lambda **k: LinearRegression(solver="normal", **k),
            "Ridge": lambda alpha=1.0, **k: LinearRegression(regParam=alpha * sigma / max(n, 1), elasticNetParam=0.0, standardization=False, solver="normal", **k),
            "ElasticNet": lambda **k: LinearRegression(**({"regParam": 0.1, "elasticNetParam": 0.5, "standardization": False} | k)),
            "Lasso": lambda **k: LinearRegression(**({"regParam": 0.01, "elasticNetParam": 1.0, "standardization": False} | k)),
        }
    if name not in makers:
        raise ValueError(f"unknown model {name}")
    return _spark(name, makers[name](**params), df, cols, y, classification)


def importances(model: Fitted, cols: Sequence[str]) -> dict[str, float]:
    """Weight of each feature: tree importance or coefficient."""
    if model.weights:
        return model.weights
    inner = model.state["models"][0]
    values = inner.featureImportances if hasattr(inner, "featureImportances") else inner.coefficients
    return dict(zip(cols, (float(v) for v in values.toArray()), strict=True))
