"""From records to predictions: settings, selection of features and models by cross-validation, and inference.

Every step is a fitted dataclass of `operators`; this module decides which of them to use, in the order records →
features → split → preprocessing → selection → model → calibration and domain, and keeps the ledger of shapes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.operators import neighbours, splits, statistics
from lodewright.operators.conformal import ConformalPredictor
from lodewright.operators.inference import summary, write_back
from lodewright.operators.models import CLASSIFIERS, REGISTRY, REGRESSORS, Fitted, fit_model, target_type
from lodewright.operators.preprocess import STEPS, DataPreprocessor
from lodewright.operators.profile import Roles
from lodewright.operators.selection import FeatureSelector, MODEL_SELECTORS
from lodewright.operators.validation import LESS_IS_BETTER, cross_validate, external_validation, optimise, own_id
from lodewright.session import Scratch
from lodewright.sources.files import from_records


def target_score(classification: bool) -> str:
    """The score that decides where none is named."""
    return "f1" if classification else "r2"


def component(default: type, given: Any, **more: Any) -> Any:
    """A component from what a user may give: nothing, an instance, a class, settings, or (class, settings)."""
    if given is None:
        return default(**more)
    if isinstance(given, type):
        return given(**more)
    if isinstance(given, dict):
        return default(**(more | given))
    if isinstance(given, tuple):
        return given[0](**(more | given[1]))
    return given


def best_of(scores: DataFrame, scoring: str) -> str:
    """The method with the best mean of a score; scores where less is better are turned."""
    rows = scores.where(F.col("scoring") == scoring.lower())
    found = statistics.best_method(rows, ["scoring"], higher=scoring.lower() not in LESS_IS_BETTER).first()
    if found is None:
        raise ValueError(f"no method has a score {scoring}")
    return found["method"]


@dataclass(frozen=True)
class ModelDeveloper:
    """Chooses a model by cross-validation (`select` a list, or None for all) or takes the one named, and fits it on all rows.

    `report` holds the scores in long form where there was a cross-validation. `params` are settings of a named model.
    """

    select: str | tuple[str, ...] | None = None
    scoring: str | None = None
    cross_validation: bool = True
    n_splits: int = 5
    n_repeats: int = 5
    seed: int = 42
    roles: Roles = Roles()
    params: dict = field(default_factory=dict)
    deactivate: bool = False
    classification: bool | None = None
    chosen: str | None = None
    model: Fitted | None = None
    report: DataFrame | None = None

    def maker(self, name: str, cols: Sequence[str], classification: bool) -> Callable[[DataFrame], Fitted]:
        return lambda t: fit_model(name, t, list(cols), self.roles.activity, classification, **own_id(name, self.roles), **self.params)

    def fit(self, df: DataFrame) -> ModelDeveloper:
        if self.deactivate:
            return self
        classes = target_type(df, self.roles.activity) == "C"
        known = (*(CLASSIFIERS if classes else REGRESSORS), *REGISTRY)
        named = isinstance(self.select, str)
        names = [self.select] if named else list(self.select or known)
        if unknown := [n for n in names if n not in known]:
            raise ValueError(f"unknown model {', '.join(unknown)}")
        if not named and not self.cross_validation:
            raise ValueError("to choose among several models, cross_validation must be on")
        cols, report = self.roles.features(df), None
        if self.cross_validation:
            report = cross_validate(df, {n: self.maker(n, cols, classes) for n in names}, self.roles, classes, self.n_splits, self.n_repeats, self.seed)
            report = Scratch(df.sparkSession).save(report)
        chosen = names[0] if named else best_of(report, self.scoring or target_score(classes))
        return replace(self, classification=classes, chosen=chosen, model=self.maker(chosen, cols, classes)(df), report=report)

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, [activity], `Predicted value`, and for classes `Probability for class 0` and `1`)."""
        i, y = self.roles.id, self.roles.activity
        scored = self.model.score(df)
        own = [i, *([y] if y in df.columns else [])]
        more = [(1 - F.col("probability")).alias("Probability for class 0"), F.col("probability").alias("Probability for class 1")] if self.classification else []
        return scored.select(*own, F.col("predicted").alias("Predicted value"), *more)

    def wide_report(self) -> DataFrame:
        """The report with one column per model and the summary cycles."""
        names = sorted(r["method"] for r in self.report.select("method").distinct().collect())
        return statistics.cross_validation_report(self.report, ["scoring"], names)


SELECTORS = ("NoFS", "Anova", "MutualInformation", *MODEL_SELECTORS)


def evaluate_selectors(df: DataFrame, roles: Roles, classification: bool, names: Sequence[str] | None = None, scorer: str = "RandomForest", n_splits: int = 5, n_repeats: int = 5, seed: int = 42, registry: dict | None = None) -> DataFrame:
    """(`scoring`, `cv_cycle`, `method`, `value`): a model's cross-validation on the features each selector keeps.

    Selectors are fitted on all rows once, as a preselection; their scores are therefore optimistic alike.
    """
    names = list(names or (*SELECTORS, "Logistic" if classification else "Lasso", *(registry or {})))
    fits = {}
    for name in names:
        chosen = FeatureSelector(name, classification, roles=roles, registry=registry or {}).fit(df).selected
        cols = roles.features(df) if chosen is None else list(chosen)
        if cols:
            fits[name] = lambda t, cols=cols: fit_model(scorer, t, cols, roles.activity, classification)
    return cross_validate(df, fits, roles, classification, n_splits, n_repeats, seed)


def select_automatically(df: DataFrame, roles: Roles, classification: bool, scoring: str | None = None, **more: Any) -> tuple[FeatureSelector, DataFrame]:
    """The selector of best mean score, fitted (doing nothing where no selection is best), and the scores."""
    report = Scratch(df.sparkSession).save(evaluate_selectors(df, roles, classification, **more))
    best = best_of(report, scoring or target_score(classification))
    return FeatureSelector(best, classification, roles=roles, deactivate=best == "NoFS", registry=more.get("registry") or {}).fit(df), report


@dataclass(frozen=True)
class ApplicabilityDomain:
    """Whether rows are near the fitted ones: `lof`, `knn` or `ocsvm`; ids `in` or `out` under `Applicability domain`."""

    method: str = "lof"
    rate: float = 0.05
    nu: float = 0.5
    roles: Roles = Roles()
    deactivate: bool = False
    fitted: DataFrame | None = None
    cols: tuple[str, ...] = ()

    def _vectors(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.roles.id).alias("id"), F.array(*(F.col(c).cast("double") for c in self.cols)).alias("x"))

    def fit(self, df: DataFrame) -> ApplicabilityDomain:
        if self.method not in ("lof", "knn", "ocsvm"):
            raise ValueError("method must be lof, knn or ocsvm")
        if self.deactivate:
            return self
        own = replace(self, cols=tuple(self.roles.features(df)))
        return replace(own, fitted=Scratch(df.sparkSession).save(own._vectors(df)))

    def predict(self, df: DataFrame) -> DataFrame:
        judge = {
            "lof": lambda q: neighbours.lof_domain(self.fitted, q, rate=self.rate), "knn": lambda q: neighbours.knn_domain(self.fitted, q, rate=self.rate),
            "ocsvm": lambda q: neighbours.machine_domain(self.fitted, q, self.nu, self.rate),
        }[self.method]
        return judge(self._vectors(df)).select(F.col("id").alias(self.roles.id), F.col("domain").alias("Applicability domain"))


@dataclass(frozen=True)
class Settings:
    """Components of a workflow; each may be given as nothing, an instance, a class, settings, or (class, settings)."""

    split: dict = field(default_factory=lambda: {"option": "random"})
    preprocessor: Any = None
    selector: Any = None
    developer: Any = None
    optimiser: dict | None = None
    conformal: Any = None
    domain: Any = None

    def made(self, roles: Roles) -> dict[str, Any]:
        steps = DataPreprocessor()
        steps = replace(steps, **{n: replace(getattr(steps, n), roles=roles) for n in STEPS})
        if isinstance(self.preprocessor, dict):
            own = {n: component(type(getattr(steps, n)), v, roles=roles) for n, v in self.preprocessor.items()}
            steps = replace(steps, **own)
        elif self.preprocessor is not None:
            steps = component(DataPreprocessor, self.preprocessor)
        return {
            "preprocessor": steps, "selector": component(FeatureSelector, self.selector, roles=roles), "developer": component(ModelDeveloper, self.developer, roles=roles),
            "conformal": component(ConformalPredictor, self.conformal, roles=roles), "domain": component(ApplicabilityDomain, self.domain, roles=roles),
        }


def shape(stage: str, data: str, df: DataFrame) -> tuple[str, str, int, int]:
    return data, stage, df.count(), len(df.columns)


LEDGER = "data string, stage string, n_rows long, n_cols int"


@dataclass(frozen=True)
class OptimalDataset:
    """Which of several feature tables predicts best: each is split, preprocessed, reduced to the features a forest finds
    important and cross-validated with that forest."""

    settings: Settings = field(default_factory=Settings)
    roles: Roles = Roles()
    scoring: str | None = None
    n_splits: int = 5
    n_repeats: int = 5
    seed: int = 42
    keep_rows: bool = False

    def run(self, tables: dict[str, DataFrame]) -> tuple[str, DataFrame, DataFrame]:
        """The name of the best table, all scores in long form with tables as methods, and the ledger of shapes
        (`feature_set`, `data`, `stage`, `n_rows`, `n_cols`)."""
        if not tables:
            raise ValueError("no feature tables")
        report, ledger, classes = None, [], None
        for name, table in tables.items():
            spark = table.sparkSession
            if classes is None:
                classes = target_type(table, self.roles.activity) == "C"
            train, _ = split_tables(table, self.settings.split, self.roles)
            steps = self.settings.made(self.roles)["preprocessor"]
            if self.keep_rows:
                steps = replace(steps, duplicate=replace(steps.duplicate, rows=False), multiv_outlier=replace(steps.multiv_outlier, deactivate=True))
            ledger.append((name, *shape("original", "train", train)))
            fitted, done = steps.fit_transform(train)
            ledger += [(name, "train", r["stage"], r["n_rows"], r["n_cols"]) for r in fitted.shapes(train).collect() if r["stage"] != "original"]
            selector = FeatureSelector("RandomForest", classes, roles=self.roles).fit(done)
            kept = Scratch(spark).save(selector.transform(done))
            ledger.append((name, *shape("selector", "train", kept)))
            cols = self.roles.features(kept)
            scores = cross_validate(kept, {name: lambda t, cols=cols: fit_model("RandomForest", t, cols, self.roles.activity, classes)}, self.roles, classes, self.n_splits, self.n_repeats, self.seed)
            report = scores if report is None else report.unionByName(scores)
        report = Scratch(spark).save(report)
        return best_of(report, self.scoring or target_score(classes)), report, spark.createDataFrame(ledger, "feature_set string, " + LEDGER)


def split_tables(df: DataFrame, options: dict, roles: Roles) -> tuple[DataFrame, DataFrame | None]:
    """Training and test rows by the options of `splits.split`; a deactivated split leaves all rows for training."""
    options = dict(options)
    if options.pop("deactivate", False):
        return df, None
    out = Scratch(df.sparkSession).save(splits.split(df, options.pop("option", "random"), roles.id, roles.activity, **options))
    drop = [c for c in ("split", options.get("group_col")) if c]
    return out.where("split = 'train'").drop(*drop), out.where("split = 'test'").drop(*drop)


@dataclass(frozen=True)
class Workflow:
    """A whole run over one feature table: `fit` gives a workflow that predicts, judges its domain and can be saved.

    An optimiser's settings are taken only where they score better than the model chosen before.
    """

    settings: Settings = field(default_factory=Settings)
    roles: Roles = Roles()
    name: str = "workflow"
    preprocessor: DataPreprocessor | None = None
    selector: FeatureSelector | None = None
    developer: ModelDeveloper | None = None
    conformal: ConformalPredictor | None = None
    domain: ApplicabilityDomain | None = None
    train: DataFrame | None = None
    test: DataFrame | None = None
    ledger: DataFrame | None = None
    best_params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Workflow:
        spark, parts = df.sparkSession, self.settings.made(self.roles)
        classes = target_type(df, self.roles.activity) == "C"
        train, test = split_tables(df, self.settings.split, self.roles)
        rows = [shape("original", "train", train)]
        steps, done = parts["preprocessor"].fit_transform(train)
        rows.append(shape("preprocessed", "train", done))
        selector = parts["selector"]
        if selector.method == "auto":
            selector, _ = select_automatically(done, self.roles, classes)
        else:
            selector = replace(selector, classification=classes).fit(done)
        kept = Scratch(spark).save(selector.transform(done))
        rows.append(shape("selected", "train", kept))
        developer, params = parts["developer"].fit(kept), {}
        if self.settings.optimiser is not None:
            options = {"scoring": developer.scoring or target_score(classes)} | self.settings.optimiser
            found, value, _ = optimise(kept, options.pop("names", [developer.chosen]), self.roles, classes, **options)
            scoring, base = options["scoring"], None
            if developer.report is not None:
                base = developer.report.where((F.col("scoring") == scoring) & (F.col("method") == developer.chosen)).agg(F.avg("value")).first()[0]
            better = base is None or (value < base if scoring in LESS_IS_BETTER else value > base)
            if better:
                params = dict(found)
                developer = replace(developer, select=params.pop("model"), params=params).fit(kept)
        ready = None if test is None else Scratch(spark).save(selector.transform(steps.transform(test)))
        if ready is not None:
            rows.append(shape("selected", "test", ready))
        make = developer.maker(developer.chosen, self.roles.features(kept), classes)
        conformal = parts["conformal"].fit(kept, make, classes)
        domain = parts["domain"].fit(kept)
        return replace(
            self, preprocessor=steps, selector=selector, developer=developer, conformal=conformal, domain=domain, train=kept, test=ready,
            ledger=spark.createDataFrame(rows, LEDGER), best_params=params,
        )

    def prepared(self, df: DataFrame) -> DataFrame:
        """New rows through the fitted steps that do not drop rows: a prediction is due for every row."""
        steps = self.preprocessor
        steps = replace(steps, duplicate=replace(steps.duplicate, rows=False), univ_outlier=replace(steps.univ_outlier, iqr_mode="null"), multiv_outlier=replace(steps.multiv_outlier, deactivate=True))
        filled = steps.transform(df)
        return self.selector.transform(filled)

    def predict(self, df: DataFrame, alpha: float | Sequence[float] | None = None) -> DataFrame:
        """(id, [activity], `Predicted value`, probabilities, sets or intervals, `Applicability domain`) for every row."""
        ready = Scratch(df.sparkSession).save(self.prepared(df))
        out = self.developer.predict(ready)
        if alpha is not None:
            out = out.join(self.conformal.predict(ready, alpha).drop("Predicted value"), self.roles.id)
        if not self.domain.deactivate:
            out = out.join(self.domain.predict(ready), self.roles.id)
        return out

    def validate(self, names: Sequence[str] | None = None) -> DataFrame:
        """(`scoring`, `method`, `value`) on the test rows, of the chosen model or of those named, fitted on the training rows."""
        return external_validation(self.train, self.test, list(names or [self.developer.chosen]), self.roles, bool(self.developer.classification))

    def compare(self, method: str = "all") -> dict[str, DataFrame]:
        """Tests between the models of the developer's report."""
        return statistics.analysis(self.developer.report, ["scoring"], method)


@dataclass
class InferenceRunner:
    """Runs anything with `predict(df, alpha)` and `roles` on a user's records and writes the predictions beside them.

    `run` accepts a frame, rows or columns; `last` keeps what it did: rows, seconds, time and settings.
    """

    pipeline: Any
    alpha: float | None = None
    last: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not callable(getattr(self.pipeline, "predict", None)) or not hasattr(self.pipeline, "roles"):
            raise TypeError("a pipeline needs predict() and roles")

    def run(self, data: Any, spark: SparkSession, id_key: str | None = None, truth: str | None = None, alpha: float | None = None) -> DataFrame:
        """The records with all columns of the predictions. Without `id_key`, or where it names no column of unique
        values, rows are numbered; without `truth` the activity is missing."""
        began, roles, scratch = time.time(), self.pipeline.roles, Scratch(spark)
        df = from_records(spark, data)
        for key in (id_key, truth):
            if key is not None and key not in df.columns:
                raise KeyError(f"column {key} is missing")
        activity = F.expr(f"try_cast(`{truth}` as double)") if truth else F.lit(None).cast("double")
        own = F.monotonically_increasing_id() if id_key is None else F.col(id_key)
        df = scratch.save(df.withColumns({roles.id: own, roles.activity: activity}).withColumn("__row", F.monotonically_increasing_id()))
        if id_key is not None and df.groupBy(roles.id).count().where("count > 1").limit(1).count():
            raise ValueError(f"ids in {id_key} are not unique")
        used = self.alpha if alpha is None else alpha
        # Steps that look rows up need whole numbers as ids, whatever the user's ids are.
        asked = df.withColumn(roles.id, F.col("__row")).drop("__row")
        predictions = scratch.save(self.pipeline.predict(asked, used).withColumnRenamed(roles.id, "__row"))
        cols = [c for c in predictions.columns if c not in ("__row", roles.activity)]
        out = scratch.save(write_back(df, predictions, "__row", cols).drop("__row"))
        self.last = {
            "rows": out.count(), "predicted": predictions.count(), "seconds": round(time.time() - began, 3), "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
            "alpha": used, "name": getattr(self.pipeline, "name", None), "columns": cols,
        }
        return out

    def summary(self, out: DataFrame) -> DataFrame:
        domain = "Applicability domain" if "Applicability domain" in out.columns else None
        return summary(out, "Predicted value", domain)

    def __repr__(self) -> str:
        return f"InferenceRunner({getattr(self.pipeline, 'name', type(self.pipeline).__name__)}, alpha={self.alpha}, last rows={self.last.get('rows')})"
