"""Forests whose trees are a table, and penalties chosen from sums."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.operators import forest, models
from lodewright.sources import store

COLS = ["p", "q", "r", "s"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4))
    x[:, 3] = rng.integers(0, 2, 600)
    y = 3 * (x[:, 0] > 0) - 2 * (x[:, 1] > 0.5) + x[:, 3] + 0.05 * rng.normal(size=600)
    rows = [(i, float(y[i]), *map(float, x[i])) for i in range(600)]
    return spark.createDataFrame(rows, "rec_id long, activity double, p double, q double, r double, s double").cache()


def values(df: DataFrame, name: str = "predicted") -> dict:
    return {r["rec_id"]: r[name] for r in df.collect()}


def test_trees_are_a_table(spark, table, tmp_path, monkeypatch):
    train, test = table.where("rec_id < 450"), table.where("rec_id >= 450")
    model = models.fit_model("RandomForest", train, COLS, "activity", False, numTrees=30)
    assert isinstance(model.state["trees"], DataFrame) and model.state["trees"].count() == 30 and "models" not in model.state
    got, true = values(model.score(test)), values(test, "activity")
    assert len(got) == 150 and np.mean([(got[i] - true[i]) ** 2 for i in got]) < 0.1 * np.var(list(true.values()))
    assert sum(model.weights.values()) == pytest.approx(1) and model.weights["p"] > model.weights["q"] > model.weights["r"]
    again = store.load(store.save(model, str(tmp_path / "m"), spark), spark)
    assert values(again.score(test)) == pytest.approx(got)
    other = models.fit_model("RandomForest", train.repartition(7, "q"), COLS, "activity", False, numTrees=30)
    assert values(other.score(test)) == pytest.approx(got)
    monkeypatch.setattr(forest, "SENT", 0)
    monkeypatch.setattr(forest, "BLOCK", 40)
    assert values(model.score(test.repartition(5))) == pytest.approx(got)
    with pytest.raises(Exception, match="missing"):
        models.fit_model("RandomForest", train.withColumn("p", F.when(F.col("rec_id") > 9, F.col("p"))), COLS, "activity", False, numTrees=2)


def test_forest_of_classes(table):
    rows = table.withColumn("activity", F.when(F.col("activity") > 0.5, 1.0).otherwise(0.0))
    out = models.fit_model("RandomForest", rows.where("rec_id < 450"), COLS, "activity", True, numTrees=40).score(rows.where("rec_id >= 450"))
    assert out.where("predicted = activity").count() >= 0.93 * 150 and out.where("probability between 0 and 1 and (probability > 0.5) = (predicted = 1)").count() == 150


def test_grown_tree():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 32, (3, 500)).astype(np.uint8)
    y, w = rng.normal(size=500), rng.integers(1, 4, 500).astype(float)
    feature, cut, value, gains = forest.grow(bins, y, w, 1, 3, rng, 32)
    def left_over(f, c):
        sides = [bins[f] >= c, bins[f] < c]
        return sum(float((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum()) if s.any() else 0.0 for s in sides)
    least = min((left_over(f, c), f, c) for f in range(3) for c in range(1, 32))
    assert (feature[0], cut[0]) == least[1:] and len(value) == 2
    total = float((w * (y - np.average(y, weights=w)) ** 2).sum())
    assert gains.sum() == pytest.approx(total - least[0])
    deep = forest.Tree(*forest.grow(bins, y, w, 30, 3, rng, 32)[:3])
    same = {}
    for i, key in enumerate(map(bytes, bins.T)):
        same.setdefault(key, []).append(i)
    assert deep.scores(bins) == pytest.approx([np.average(y[same[k]], weights=w[same[k]]) for k in map(bytes, bins.T)])


def test_places():
    assert forest.places([0.0] * 999 + [1.0], 32).tolist() == [0.5]
    many = forest.places(np.concatenate([np.zeros(900), np.arange(1, 200)]), 32)
    assert len(many) == 31 and (np.diff(many) > 0).all()


@pytest.mark.parametrize("elastic", [1.0, 0.5])
def test_penalty_from_sums(spark, table, elastic):
    spark.sparkContext.setJobGroup("path", "path")
    models.path_cv("LassoCV", table, COLS, "activity", elastic)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("path"))
    spark.sparkContext.setJobGroup("none", "none")
    assert 0 < jobs < 20  # a fit for each fold and penalty before: hundreds
    x = VectorAssembler(inputCols=COLS, outputCol="x").transform(table)
    data = np.array(table.select(*COLS, "activity").collect())
    for alpha in (0.01, 0.3):
        theirs = LinearRegression(featuresCol="x", labelCol="activity", regParam=alpha, elasticNetParam=elastic, standardization=False, maxIter=500, tol=1e-10).fit(x).coefficients.toArray()
        assert models._elastic(np.cov(data.T, bias=True), alpha, elastic, np.zeros(4)) == pytest.approx(theirs, abs=2e-4)
