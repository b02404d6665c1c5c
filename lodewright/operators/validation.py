"""Cross-validation, external validation, search over models and settings."""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.operators.metrics import probability_metrics, ranking_metrics, regression_metrics, threshold_metrics
from lodewright.operators.models import Fitted, fit_model
from lodewright.operators.profile import Roles
from lodewright.operators.splits import repeated_folds
from lodewright.session import Scratch


def scores_of(scored: DataFrame, by: Sequence[str], y: str, classification: bool) -> DataFrame:
    """(*by, `scoring`, `value`): all metrics in long form."""
    if classification:
        parts = [threshold_metrics(scored, by, y, "predicted"), probability_metrics(scored, by, y, "probability"), ranking_metrics(scored, by, y, "probability")]
    else:
        parts = [regression_metrics(scored, by, y, "predicted")]
    out = None
    for p in parts:
        cols = [c for c in p.columns if c not in by]
        part = p.unpivot(list(by), cols, "scoring", "value")
        out = part if out is None else out.unionByName(part)
    return out


def _scored(model: Fitted, test: DataFrame, y: str, classification: bool, **marks: str) -> DataFrame:
    part = model.score(test).select(F.col(y).cast("double").alias("y"), "predicted", *(["probability"] if classification else []))
    return part.withColumns({k: F.lit(v) for k, v in marks.items()})


def cross_validate(df: DataFrame, models: dict[str, Callable[[DataFrame], Fitted]], roles: Roles, classification: bool, n_splits: int = 5, n_repeats: int = 5, seed: int = 42, parallel: int = 4) -> DataFrame:
    """(`scoring`, `cv_cycle`, `method`, `value`) over all repeats and folds.

    The table with its folds is written once. `parallel` fits run at a time, each a chain of Spark jobs; every fit's
    scored rows are written once, so metrics read them and score nothing again.
    """
    scratch = Scratch(df.sparkSession)
    folds = repeated_folds(df, roles.id, n_splits, n_repeats, roles.activity if classification else None, seed)
    wide = folds.groupBy(F.col(roles.id).alias("__id")).pivot("repeat", list(range(n_repeats))).agg(F.first("fold"))
    rows = scratch.save(df.join(wide.select("__id", *(F.col(str(r)).alias(f"__r{r}") for r in range(n_repeats))), df[roles.id] == F.col("__id")).drop("__id"))
    names = [f"__r{r}" for r in range(n_repeats)]

    def one(task: tuple[int, int, str]) -> DataFrame:
        r, f, name = task
        train, test = rows.where(F.col(f"__r{r}") != f).drop(*names), rows.where(F.col(f"__r{r}") == f).drop(*names)
        return Scratch(df.sparkSession).save(_scored(models[name](train), test, roles.activity, classification, method=name, cv_cycle=str(r * n_splits + f + 1)))

    tasks = [(r, f, name) for r in range(n_repeats) for f in range(n_splits) for name in models]
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        parts = list(pool.map(one, tasks))
    scored = scratch.save(reduce(DataFrame.unionByName, parts))
    return scores_of(scored, ["cv_cycle", "method"], "y", classification).select("scoring", "cv_cycle", "method", "value")


def external_validation(train: DataFrame, test: DataFrame, names: Sequence[str], roles: Roles, classification: bool) -> DataFrame:
    """(`scoring`, `method`, `value`) of models fitted on `train` and scored on `test`."""
    cols, scratch = roles.features(train), Scratch(train.sparkSession)
    parts = [_scored(fit_model(n, train, cols, roles.activity, classification, **own_id(n, roles)), test, roles.activity, classification, method=n) for n in names]
    scored = scratch.save(reduce(DataFrame.unionByName, parts))
    return scores_of(scored, ["method"], "y", classification).select("scoring", "method", "value")


def own_id(name: str, roles: Roles) -> dict:
    """The parameter by which a model that looks rows up knows their id."""
    return {"id_col": roles.id} if name == "KNeighbors" else {}


#: Scores where less is better: fixed values.
LESS_IS_BETTER = ("mse", "rmse", "mae", "median_ae", "mape", "max_error", "log_loss", "brier")

#: Ranges searched by model: (low, high, kind) or a list of choices; fixed values.
SPACE = {
    "Logistic": {"C": (0.01, 10.0, "float")},
    "KNeighbors": {"k": (1, 20, "int")},
    "RandomForest": {"numTrees": (10, 250, "int"), "maxDepth": (2, 30, "int")},
    "ExtraTrees": {"trees": (10, 250, "int")},
    "AdaBoost": {"rounds": (10, 250, "int")},
    "GradientBoosting": {"maxIter": (10, 250, "int"), "stepSize": (0.01, 1.0, "float"), "maxDepth": (2, 30, "int")},
    "XGB": {"rounds": (10, 250, "int"), "rate": (0.01, 1.0, "float"), "depth": (2, 12, "int")},
    "CatBoost": {"rounds": (50, 200, "int"), "rate": (0.01, 1.0, "float"), "depth": (2, 10, "int")},
    "MLP": {"hidden": (50, 200, "int")},
    "SVM": {"c": (0.1, 10.0, "float")},
    "Ridge": {"alpha": (0.1, 10.0, "float")},
    "ElasticNet": {"elasticNetParam": (0.1, 1.0, "float")},
    "ElasticNetCV": {"elastic": (0.1, 1.0, "float")},
    "Linear": {},
    "Dummy": {},
}


def _kernel_mean(x: np.ndarray, centres: np.ndarray, widths: np.ndarray, low: float, high: float) -> np.ndarray:
    """Density of a mixture of normal kernels and one flat part, on a range."""
    z = (x[:, None] - centres) / widths
    dense = np.exp(-0.5 * z * z) / (widths * np.sqrt(2 * np.pi))
    return (dense.sum(1) + 1 / (high - low)) / (len(centres) + 1)


def suggest(space: dict, past: list[tuple[dict, float]], rng: np.random.Generator, start: int = 10, candidates: int = 24) -> dict:
    """The next settings by a tree-structured Parzen estimator: random for the first `start` trials, then, for each
    setting, the one of `candidates` draws from the density of the good trials (the best quarter) for which that density
    is greatest against the density of the others."""
    ranked = sorted(past, key=lambda t: -t[1])
    n_good = max(1, min(25, -(-len(past) // 4)))
    good, rest = ranked[:n_good], ranked[n_good:]
    out = {}
    for name, spec in space.items():
        if isinstance(spec, list):
            if len(past) < start:
                out[name] = spec[int(rng.integers(len(spec)))]
                continue
            share = lambda trials: np.array([1.0 + sum(t[0].get(name) == v for t in trials) for v in spec])
            a, b = share(good), share(rest)
            drawn = rng.choice(len(spec), candidates, p=a / a.sum())
            out[name] = spec[int(drawn[np.argmax((a / a.sum())[drawn] / (b / b.sum())[drawn])])]
            continue
        low, high, kind = spec
        if len(past) < start:
            value = rng.uniform(low, high)
        else:
            at = lambda trials: np.array([float(t[0][name]) for t in trials if name in t[0]])
            width = lambda c: np.full(len(c), max((high - low) / min(100.0, 1.0 + len(c)), 1e-9))
            g, b = at(good), at(rest)
            pick = rng.integers(0, len(g) + 1, candidates)
            drawn = np.where(pick < len(g), rng.normal(g[np.minimum(pick, len(g) - 1)], width(g)[0]), rng.uniform(low, high, candidates))
            drawn = np.clip(drawn, low, high)
            value = drawn[np.argmax(_kernel_mean(drawn, g, width(g), low, high) / _kernel_mean(drawn, b, width(b), low, high))]
        value = float(np.clip(value, low, high))
        out[name] = int(round(value)) if kind == "int" else value
    return out


def _past_trials(spark, store: str | None) -> list:
    """Trials of an earlier study under the same name, in order."""
    if not store:
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return []
    return sorted(spark.read.parquet(store).collect(), key=lambda r: r["trial"])


def optimise(df: DataFrame, names: Sequence[str], roles: Roles, classification: bool, scoring: str, n_trials: int = 50, n_splits: int = 5, n_repeats: int = 2, seed: int = 42, space: dict | None = None, store: str | None = None) -> tuple[dict, float, DataFrame]:
    """Best settings (with `model`), their mean score, and the table of trials.

    `store` keeps the trials as Parquet: a study that exists is continued, its trials count for what is tried next.
    Scores where less is better count negatively. Trials follow one another; the fits of one run side by side.
    """
    space, cols, spark = SPACE | (space or {}), roles.features(df), df.sparkSession
    sign = -1 if scoring in LESS_IS_BETTER else 1
    past: dict[str, list] = {n: [] for n in names}
    before = _past_trials(spark, store)
    for r in before:
        if r["model"] in past and r["value"] is not None:
            past[r["model"]].append((ast.literal_eval(r["params"]), sign * r["value"]))
    rows = []
    for trial in range(len(before), len(before) + n_trials):
        rng = np.random.default_rng([seed, trial])
        if trial < 3 * len(names):
            name = names[trial % len(names)]
        else:
            tried = [({"model": n}, s) for n in names for _, s in past[n]]
            name = suggest({"model": list(names)}, tried, rng)["model"]
        params = suggest(space.get(name, {}), past[name], rng)
        fit = {name: lambda t, n=name, p=params: fit_model(n, t, cols, roles.activity, classification, **own_id(n, roles), **p)}
        value = cross_validate(df, fit, roles, classification, n_splits, n_repeats, seed).where(F.col("scoring") == scoring).agg(F.avg("value")).first()[0]
        if value is not None and value == value:
            past[name].append((params, sign * value))
        rows.append((trial, name, repr(params), None if value is None else float(value)))
    table = spark.createDataFrame(rows, "trial int, model string, params string, value double")
    if store and rows:
        table.write.mode("append").parquet(store)
    done = [(n, t) for n in names for t in past[n]]
    if not done:
        raise ValueError("no trial has a score")
    name, (params, value) = max(done, key=lambda x: x[1][1])
    return {"model": name, **params}, sign * value, table
