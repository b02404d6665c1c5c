"""Splits, metrics, statistics and models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewright.functions import special
from lodewright.operators import conformal, inference, metrics, models, selection, splits, statistics, validation
from lodewright.operators.profile import Roles
from lodewright.plans import queries


@pytest.fixture(scope="module")
def grouped(spark):
    sizes = {"a": 5, "b": 4, "c": 1}
    rows = [(i, g) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "rec_id long, g string")


def test_greedy_fill_skips(grouped):
    groups = splits.group_sizes(grouped, "rec_id", "g")
    got = {r["group"]: r["split"] for r in splits.greedy_fill(groups, [-F.col("size")], 6).collect()}
    assert got == {"a": "train", "b": "test", "c": "train"}


def test_split_sizes(spark):
    df = spark.range(103).select(F.col("id").alias("rec_id"), F.concat(F.lit("g"), (F.col("id") % 7).cast("string")).alias("g"), (F.col("id") % 3).alias("c"))
    assert splits.random_split(df, "rec_id").where("split = 'test'").count() == 21
    assert splits.stratified_split(df, "rec_id", "c").where("split = 'test'").count() == 21
    for option in ("scaffold", "random_scaffold", "stratified_scaffold"):
        out = splits.split(df, option, "rec_id", "c", "g")
        assert out.count() == 103 and out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    folds = splits.repeated_folds(df, "rec_id", 5, 2, "c")
    assert folds.count() == 206 and {r["fold"] for r in folds.collect()} == set(range(5))
    with pytest.raises(ValueError):
        splits.split(df, "time", "rec_id", "c")


def test_queries_read_whole_tables(spark, tmp_path):
    rows = [(i, "e" if i % 5 else None, None if i % 4 == 0 else f"s{i % 3}", [0.0, 2.0, 5000.0, float("nan"), None][i % 7 % 5]) for i in range(40)]
    spark.createDataFrame(rows, "rec_id long, endpoint string, source string, y double").write.parquet(str(tmp_path / "train_val.parquet"))
    for query in (queries.group_split, queries.random_group_split, queries.stratified_group_folds):
        out = query(spark, str(tmp_path)).collect()
        assert sorted(r["rec_id"] for r in out) == list(range(40))
    valid = [(y, y * 0.9 + i % 7 * 0.1 - y) for i, e, _, y in rows if e and y is not None and y == y]
    r = queries.regression_metrics(spark, str(tmp_path)).first()
    assert r["mae"] == pytest.approx(sum(abs(e) for _, e in valid) / len(valid), abs=1e-6)
    assert r["mape"] == pytest.approx(sum(abs(e) / max(abs(y), 2.220446049250313e-16) for y, e in valid) / len(valid), rel=1e-8)


def test_sphere_exclusion(spark):
    rng = np.random.default_rng(5)
    sets = [sorted(set(rng.integers(0, 8, rng.integers(1, 6)).tolist())) for _ in range(30)]
    near = {(i, j) for i in range(30) for j in range(30) if i != j and 1 - len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) <= 0.5 + 1e-12}
    degree = {i: sum((i, j) in near for j in range(30)) for i in range(30)}
    want, left = {}, set(range(30))
    for i in sorted(range(30), key=lambda i: (-degree[i], i)):
        if i in left:
            members = {i} | {j for j in left if (i, j) in near}
            want |= dict.fromkeys(members, i)
            left -= members
    df = spark.createDataFrame(list(enumerate(sets)), "id long, bits array<int>")
    got = {r["id"]: r["cluster"] for r in splits.sphere_exclusion(df, 0.5).collect()}
    assert set(got) == set(want) and sum(got[i] == want[i] for i in got) >= 24


def test_metrics_golden(spark):
    df = spark.createDataFrame([("e", 1.0, 0.9), ("e", 0.0, 0.8), ("e", 1.0, 0.7)], "e string, y double, p double")
    r = metrics.ranking_metrics(df, ["e"], "y", "p").first()
    assert r["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3) and r["roc_auc"] == pytest.approx(0.5)


def test_special_functions():
    assert special.f_sf(4.0, 2, 10) == pytest.approx(0.05268, abs=2e-4) or special.f_sf(4.0, 2, 10) == pytest.approx((1 + 4 * 2 / 10) ** -5, rel=1e-9)
    assert special.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-8)
    assert special.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.studentized_range_sf(3.877676, 3, 10) == pytest.approx(0.05, abs=5e-4)
    assert special.norm_ppf(np.array([0.975]))[0] == pytest.approx(1.959963985, abs=1e-8)


def test_ranks_and_holm(spark):
    rows = [("r2", "1", "a", 0.1), ("r2", "1", "b", 0.2), ("r2", "1", "c", 0.2)]
    got = {r["method"]: (r["rank"], round(r["pct_rank"], 6)) for r in statistics.ranks(spark.createDataFrame(rows, "scoring string, cv_cycle string, method string, value double"), ["scoring"]).collect()}
    assert got == {"a": (1.0, 0.333333), "b": (2.5, 0.833333), "c": (2.5, 0.833333)}
    p = spark.createDataFrame([("s", 0.01), ("s", 0.04), ("s", 0.03)], "scoring string, p_value double")
    assert sorted(round(r["p_holm"], 6) for r in statistics.holm(p, ["scoring"]).collect()) == [0.03, 0.06, 0.06]


def test_scores_of_incomplete_cycles(spark):
    rows = [("R2", str(i), 0.1 * i, 0.2 * i + 0.01 * (i % 3), None) for i in range(1, 6)] + [("r2", "6", 0.9, float("nan"), None), ("r2", "mean", 0.5, 0.5, None)]
    report = spark.createDataFrame(rows, "scoring string, cv_cycle string, a double, b double, c double")
    s, by = statistics.long_scores(report, ["a", "b", "c"]), ["scoring"]
    assert s.count() == 11 and {r["cv_cycle"] for r in statistics.whole_cycles(s, by).collect()} == set("12345")
    assert {r["method"]: round(r["mean"], 6) for r in statistics.summary_rows(s, by).collect()} == {"a": 0.4, "b": 0.612}
    whole = s.where("cv_cycle <> '6'")
    for test in (statistics.repeated_measures_anova, statistics.friedman, statistics.conover, statistics.tukey):
        assert test(s, by).collect() == test(whole, by).collect() and test(s, by).count() == 1


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 4))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=120)
    rows = [(i, float(y[i]), float(y[i] > 0), *map(float, x[i])) for i in range(120)]
    return spark.createDataFrame(rows, "rec_id long, activity double, c double, p double, q double, r double, s double")


COLS = ["p", "q", "r", "s"]


@pytest.mark.parametrize("name", [n for n in models.CLASSIFIERS if n not in ("XGB", "CatBoost", "GradientBoosting")])
def test_classifiers(learnable, name):
    params = {"rounds": 5} if name == "AdaBoost" else {}
    out = models.fit_model(name, learnable, COLS, "c", True, **params).score(learnable)
    hits = out.agg(F.avg(F.when(F.col("predicted") == F.col("c"), 1.0).otherwise(0.0))).first()[0]
    assert hits > (0.4 if name == "Dummy" else 0.8)


@pytest.mark.parametrize("name", ["Dummy", "Linear", "KNeighbors", "SVM", "ExtraTrees", "AdaBoost", "MLP", "Ridge", "ElasticNet", "Lasso"])
def test_regressors(learnable, name):
    params = {"rounds": 5} if name == "AdaBoost" else {}
    r2 = metrics.regression_metrics(models.fit_model(name, learnable, COLS, "activity", False, **params).score(learnable), [], "activity", "predicted").first()["r2"]
    assert r2 > (-0.1 if name == "Dummy" else 0.6)


def test_selection(learnable):
    roles = Roles(others=("c",))
    assert set(selection.top_k(selection.regression_scores(learnable, COLS, "activity"), 2)) == {"p", "q"}
    assert selection.top_k(selection.mutual_information_scores(learnable, COLS, "activity", False, "rec_id"), 1) == ["p"]
    assert set(selection.top_k(selection.mutual_information_scores(learnable, COLS, "c", True, "rec_id"), 1)) == {"p"}
    chosen = selection.FeatureSelector("Lasso", classification=False, roles=roles).fit(learnable)
    assert {"p", "q"} <= set(chosen.selected)


def test_mutual_information_of_all_rows(spark, learnable):
    n = 24_000
    x, c = np.random.default_rng(9).normal(size=n), (np.arange(n) % 3 == 0).astype(float)
    x = x + 2 * c
    df = spark.createDataFrame([(i, float(x[i]), float(c[i])) for i in range(n)], "rec_id long, x double, c double")
    got = selection.mutual_information_scores(df, ["x"], "c", True, "rec_id").first()["f"]
    assert got == pytest.approx(selection.mutual_information(x, c, True), abs=1e-9) and got > 0.1
    for u, v in ((x[:700], x[:700] ** 2), (np.round(x[:700]), x[700:1400]), (np.round(x[:700]), np.round(x[700:1400]))):
        d = np.sort(np.maximum(np.abs(u[:, None] - u), np.abs(v[:, None] - v)), axis=1)[:, 3]
        assert (selection._kth_distances(u, v, 3) == d).all()
    noise = [(float(i % 2), float(i % 2), float(np.sin(i * 7.0)) * 0.1) for i in range(200)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(noise)], "rec_id long, activity double, p double, q double")
    assert selection.FeatureSelector("Logistic").fit(frame).selected == ("p",)


def test_validation(learnable):
    roles = Roles(others=("c",))
    fits = {"Linear": lambda t: models.fit_model("Linear", t, COLS, "activity", False), "Dummy": lambda t: models.fit_model("Dummy", t, COLS, "activity", False)}
    scores = validation.cross_validate(learnable, fits, roles, False, 2, 1)
    assert statistics.best_method(scores.where("scoring = 'r2'"), ["scoring"]).first()["method"] == "Linear"
    wide = statistics.cross_validation_report(scores, ["scoring"], ["Dummy", "Linear"])
    assert wide.count() == 7 * (2 + 3)
    best, value, trials = validation.optimise(learnable, ["Ridge"], roles, False, "r2", n_trials=2, n_splits=2, n_repeats=1)
    assert best["model"] == "Ridge" and value > 0.9 and trials.count() == 2


def test_conformal(spark):
    n = 40
    residuals = spark.createDataFrame([(i % 2, i / n) for i in range(n)], "fold int, residual double")
    folds = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0)], "id long, fold int, predicted double")
    r = conformal.plus_intervals(folds, residuals, 0.1).first()
    assert (r["lower"], r["upper"]) == (pytest.approx(5 - 36 / n), pytest.approx(5 + 36 / n))
    probabilities = spark.createDataFrame([(1, "a", 0.95), (1, "b", 0.05)], "id long, label string, p double")
    assert conformal.label_sets(probabilities, spark.createDataFrame([(i / 100,) for i in range(50)], "score double"), 0.1).first()["labels"] == ["a"]


def test_inference(spark):
    records = spark.createDataFrame([(1, 2.0), (2, None)], "rec_id long, y double")
    out = inference.write_back(records, spark.createDataFrame([(2, 7.0)], "rec_id long, y double"), "rec_id", ["y"])
    assert {r["rec_id"]: r["y"] for r in out.collect()} == {1: 2.0, 2: 7.0}
    assert inference.summary(out, "y").first()["q50"] == 4.5
    assert inference.find_columns(out, "REC") == ["rec_id"]
