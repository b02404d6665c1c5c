"""Models chosen by cross-validation, whole runs, what is saved of them, and inference."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewright.operators import models, outliers, workflow
from lodewright.operators.conformal import ConformalPredictor
from lodewright.operators.missing import MissingHandler
from lodewright.operators.profile import Roles
from lodewright.operators.selection import FeatureSelector
from lodewright.sources import store


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 4))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=160)
    rows = [(i, float(y[i]), *map(float, x[i])) for i in range(160)]
    return spark.createDataFrame(rows, "rec_id long, activity double, p double, q double, r double, s double").cache()


@pytest.fixture(scope="module")
def classes(table):
    return table.withColumn("activity", F.when(F.col("activity") > 0, 1.0).otherwise(0.0)).cache()


QUICK = {"developer": {"select": ("Linear", "Dummy"), "n_splits": 2, "n_repeats": 1}, "conformal": {"n_splits": 2}, "domain": {"method": "knn"}}


def test_developer(table, classes):
    chosen = workflow.ModelDeveloper(("Dummy", "Linear"), n_splits=2, n_repeats=1).fit(table)
    assert chosen.chosen == "Linear" and {"mean", "std", "median", "1", "2"} == {r["cv_cycle"] for r in chosen.wide_report().collect()}
    assert chosen.predict(table).columns == ["rec_id", "activity", "Predicted value"]
    named = workflow.ModelDeveloper("Logistic", cross_validation=False).fit(classes)
    assert named.predict(classes.drop("activity")).columns == ["rec_id", "Predicted value", "Probability for class 0", "Probability for class 1"]
    with pytest.raises(ValueError):
        workflow.ModelDeveloper(("Dummy", "Linear"), cross_validation=False).fit(table)
    with pytest.raises(ValueError):
        workflow.ModelDeveloper("Nothing").fit(table)


def test_selectors(table):
    selector, report = workflow.select_automatically(table, Roles(), False, names=["NoFS", "Anova", "own"], scorer="Linear", n_splits=2, n_repeats=1, registry={"own": lambda df, cols, y: ["r", "s"]})
    means = {r["method"]: r["m"] for r in report.where("scoring = 'r2'").groupBy("method").agg(F.avg("value").alias("m")).collect()}
    assert means["NoFS"] > 0.9 > 0.3 > means["own"] and selector.method in ("NoFS", "Anova")


def test_workflow_predicts_every_row(spark, table, tmp_path):
    fitted = workflow.Workflow(workflow.Settings(**QUICK)).fit(table)
    assert fitted.developer.chosen == "Linear" and {r["stage"] for r in fitted.ledger.collect()} == {"original", "preprocessed", "selected"}
    out = fitted.predict(table, 0.1)
    assert out.count() == 160 and "Prediction Interval (alpha=0.1)" in out.columns and set(out.select("Applicability domain").distinct().toPandas()["Applicability domain"]) <= {"in", "out"}
    inside = out.where("activity between `Prediction Interval (alpha=0.1)`[0] and `Prediction Interval (alpha=0.1)`[1]").count()
    scaled = fitted.preprocessor.rescaler
    assert inside >= 0 and scaled.factors
    assert fitted.validate().where("scoring = 'r2'").first()["value"] > 0.5
    path = store.save(fitted, str(tmp_path / "saved"), spark)
    again = store.load(path, spark)
    a, b = ({r["rec_id"]: r["Predicted value"] for r in w.predict(table).collect()} for w in (fitted, again))
    assert a == pytest.approx(b)
    runner = workflow.InferenceRunner(again, alpha=0.2)
    rows = [{"name": f"n{i}", "p": 0.1 * i, "q": 0.0, "r": 0.0, "s": 0.0} for i in range(5)]
    got = runner.run(rows, spark, id_key="name")
    assert got.count() == 5 and runner.last["predicted"] == 5 and "Prediction Interval (alpha=0.2)" in got.columns and runner.summary(got).first()["n"] == 5
    with pytest.raises(KeyError):
        runner.run(rows, spark, id_key="nothing")
    with pytest.raises(ValueError):
        runner.run([{**rows[0]}, {**rows[0]}], spark, id_key="name")
    with pytest.raises(TypeError):
        workflow.InferenceRunner(object())


def test_optimal_dataset(table):
    poor = table.select("rec_id", "activity", F.rand(1).alias("a"), F.rand(2).alias("b"))
    best, report, ledger = workflow.OptimalDataset(n_splits=2, n_repeats=1, settings=workflow.Settings(preprocessor={"multiv_outlier": {"deactivate": True}})).run({"good": table, "poor": poor})
    assert best == "good" and {r["feature_set"] for r in ledger.collect()} == {"good", "poor"} and report.select("method").distinct().count() == 2


@pytest.mark.parametrize("name, params", [("Linear", {}), ("KNeighbors", {}), ("Dummy", {}), ("AdaBoost", {"rounds": 3}), ("ExtraTrees", {"trees": 4, "groups": 2}), ("XGB", {"rounds": 2, "depth": 2})])
def test_models_are_saved(spark, table, tmp_path, name, params):
    model = models.fit_model(name, table, ["p", "q", "r", "s"], "activity", False, **params)
    again = store.load(store.save(model, str(tmp_path / "m"), spark), spark)
    a, b = ({r["rec_id"]: r["predicted"] for r in m.score(table).collect()} for m in (model, again))
    assert a == pytest.approx(b) and len(a) == 160


def test_handlers_are_saved(spark, table, tmp_path):
    gaps = table.withColumn("p", F.when(F.col("rec_id") % 5 > 0, F.col("p")))
    for i, handler in enumerate((MissingHandler(strategy="knn").fit(gaps), outliers.MultivariateOutliersHandler("IsolationForest").fit(table), FeatureSelector("Anova", False, k=2).fit(table))):
        again = store.load(store.save(handler, str(tmp_path / str(i)), spark), spark)
        data = gaps if i == 0 else table
        assert sorted(map(tuple, again.transform(data).collect())) == sorted(map(tuple, handler.transform(data).collect()))


def test_label_sets(classes):
    make = lambda t: models.fit_model("Logistic", t, ["p", "q", "r", "s"], "activity", True)
    out = ConformalPredictor(n_splits=2).fit(classes, make, True).predict(classes, [0.1, 0.3])
    assert {"Prediction Set (alpha=0.1)", "Prediction Set (alpha=0.3)"} <= set(out.columns)
    hits = out.join(classes, "rec_id").where("array_contains(`Prediction Set (alpha=0.1)`, cast(cast(activity as int) as string))").count()
    assert hits >= 0.85 * 160


@pytest.mark.parametrize("method", ["lof", "knn", "ocsvm"])
def test_domain(spark, table, method):
    far = table.where("rec_id < 20").select(F.col("rec_id") + 1000, "activity", *((F.col(c) * 30).alias(c) for c in "pqrs")).toDF(*table.columns)
    domain = workflow.ApplicabilityDomain(method).fit(table)
    got = domain.predict(far)
    assert got.where("`Applicability domain` = 'out'").count() >= 18


@pytest.mark.parametrize("method", outliers.MULTIVARIATE)
def test_whole_row_outliers(spark, method):
    rng = np.random.default_rng(5)
    rows = [(i, 0.0, *map(float, rng.normal(size=3))) for i in range(150)] + [(900 + i, 0.0, 40.0 + i, -40.0, 40.0) for i in range(3)]
    df = spark.createDataFrame(rows, "rec_id long, activity double, a double, b double, c double")
    handler = outliers.MultivariateOutliersHandler(method).fit(df.where("rec_id < 900"))
    left = {r["rec_id"] for r in handler.transform(df).collect()}
    assert not left & {900, 901, 902} and len(left) > 60
    assert {r["rec_id"] for r in handler.transform(df.where("rec_id >= 900")).collect()} == set()
