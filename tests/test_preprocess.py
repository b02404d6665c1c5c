"""Preprocessing steps on small tables with known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewright.operators import binning, duplicates, missing, neighbours, outliers, preprocess, profile, scaling, variance

ROLES = profile.Roles()


@pytest.fixture(scope="module")
def quartet(spark):
    return spark.createDataFrame([(1, 0.0, 1.0, 0, 5.0), (2, 1.0, 2.0, 1, 5.0), (3, 0.0, 4.0, 0, 5.0), (4, 1.0, 10.0, None, 5.0)], "rec_id long, activity double, x double, b int, c double")


def test_stats(quartet):
    s = profile.collect_stats(quartet, ["x", "b", "c"])
    assert (s["x"]["q1"], s["x"]["median"], s["x"]["q3"], s["x"]["variance"]) == (1.75, 3.0, 5.5, pytest.approx(12.1875))
    assert s["b"]["is_binary"] and s["b"]["missing_pct"] == 25.0 and s["b"]["mode"] == 0.0


def test_duplicate_columns_and_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0.5, 1, 1, nan), (2, 0.8, 1, 1, None), (3, None, 0, 0, 2.0), (4, 0.1, 0, 0, 2.0), (5, 9.0, 2, 2, 1.0)], "rec_id long, activity double, f int, g int, h double")
    handler = duplicates.DuplicateHandler().fit(df)
    assert handler.dropped == ("g",)
    got = {r["rec_id"]: r["activity"] for r in handler.transform(df).collect()}
    assert got == {1: pytest.approx(0.65), 3: 0.1, 5: 9.0}
    keep = lambda k: {r["rec_id"]: r["activity"] for r in duplicates.DuplicateHandler(keep=k).fit(df).transform(df).collect()}
    assert keep("first") == {1: 0.5, 3: None, 5: 9.0}
    assert keep("last") == {2: 0.8, 4: 0.1, 5: 9.0}
    assert keep("max") == {2: 0.8, 4: 0.1, 5: 9.0}
    assert keep("min") == {1: 0.5, 4: 0.1, 5: 9.0}
    assert len(keep("random")) == 3
    with pytest.raises(ValueError):
        keep("none")


def _gaps(spark, n=20):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 4))
    rows = [(i, float(i % 2), i % 2 if i % 5 else None, *(None if (i + j) % 7 == 0 else float(v) for j, v in enumerate(x[i])), None if i % 2 else 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "rec_id long, activity double, b int, p double, q double, r double, s double, gone double")


@pytest.mark.parametrize("strategy", missing.STRATEGIES)
def test_missing(spark, strategy):
    df = _gaps(spark)
    handler = missing.MissingHandler(strategy=strategy, rounds=2).fit(df)
    out = handler.transform(df)
    assert handler.dropped == ("gone",) and out.columns == ["rec_id", "activity", "b", "p", "q", "r", "s"]
    assert out.count() == 20 and not any(v is None for r in out.collect() for v in r)


def test_knn_fill_is_exact(spark):
    df = _gaps(spark)
    out = {r["rec_id"]: r for r in missing.MissingHandler(strategy="knn", neighbours=3).fit(df).transform(df).collect()}
    rows = {r["rec_id"]: np.array([np.nan if v is None else v for v in r[3:7]]) for r in df.collect()}
    for i, x in rows.items():
        for f in np.flatnonzero(np.isnan(x)):
            near = []
            for j, y in rows.items():
                both = ~np.isnan(x) & ~np.isnan(y)
                if not np.isnan(y[f]) and both.any():
                    near.append((math.sqrt(4 / both.sum() * ((x - y)[both] ** 2).sum()), j, y[f]))
            want = np.mean([v for *_, v in sorted(near)[:3]])
            assert out[i]["pqrs"[f]] == pytest.approx(want)


def test_variance(spark, quartet):
    handler = variance.LowVarianceHandler().fit(quartet)
    assert handler.selected == ("b", "x")
    curve = {r["threshold"]: r["n_features"] for r in variance.variance_curve(quartet, ["x", "b", "c"]).collect()}
    assert curve[0.0] == 2 and len(curve) == 20


def _spiked(spark):
    rows = [(i, float(i), i % 2, 100.0 if i == 9 else float(i % 3), -50.0 if i == 4 else float(i % 4), float(i)) for i in range(10)]
    return spark.createDataFrame(rows, "rec_id long, activity double, b int, u double, v double, w double")


@pytest.mark.parametrize("method", outliers.METHODS)
def test_univariate(spark, method):
    df = _spiked(spark)
    handler = outliers.UnivariateOutliersHandler(method).fit(df)
    assert list(handler.bounds) == ["u", "v"]
    out = handler.transform(df).orderBy("rec_id").collect()
    assert len(out) == 10 and [r["w"] for r in out] == [float(i) for i in range(10)]
    if method in ("winsorization", "imputation"):
        assert max(r["u"] for r in out) < 100 and min(r["v"] for r in out) > -50
    if method == "uniform":
        assert max(r["u"] for r in out) == 1.0
    if method == "iqr":
        assert out[9]["u"] is None and out[9]["v"] is None
        assert outliers.UnivariateOutliersHandler(method, iqr_mode="drop").fit(df).transform(df).count() == 8


def test_binning_and_scaling(spark):
    df = _spiked(spark)
    out = binning.KBinHandler().fit(df).transform(df)
    assert out.columns == ["rec_id", "activity", "b", "w", "Kbin1", "Kbin2"]
    assert {r["Kbin1"] for r in out.collect()} <= {0.0, 1.0, 2.0}
    dense = binning.KBinHandler(encode="onehot-dense", strategy="uniform").fit(df).transform(df)
    assert "Kbin1_2" in dense.columns
    same = spark.createDataFrame([(1, 0.0, 3.0, 1), (2, 1.0, 3.0, 0)], "rec_id long, activity double, x double, b int")
    for m in scaling.METHODS:
        assert [r["x"] for r in scaling.Rescaler(m).fit(same).transform(same).collect()] == [0.0, 0.0]
    with pytest.raises(KeyError):
        scaling.Rescaler().setting(wrong=1)


@pytest.mark.parametrize("method", outliers.MULTIVARIATE)
def test_multivariate(spark, method):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    x[:3] += 50 + 10 * rng.normal(size=(3, 3))
    df = spark.createDataFrame([(i, 0.0, *map(float, v)) for i, v in enumerate(x)], "rec_id long, activity double, p double, q double, r double")
    kept = {r["rec_id"] for r in outliers.MultivariateOutliersHandler(method).fit(df).transform(df).collect()}
    assert (25 if method == "OneClassSVM" else 40) <= len(kept) < 60  # the one-class machine sets half of the rows outside
    if method != "LocalOutlierFactor":
        assert not kept & {0, 1, 2} or method == "EmpiricalCovariance"


def test_pipeline(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(i % 2), i % 2, *(None if (i + j) % 11 == 0 else float(v) for j, v in enumerate(rng.normal(size=3)))) for i in range(40)]
    df = spark.createDataFrame(rows, "rec_id long, activity double, b int, p double, q double, r double")
    fitted, out = preprocess.DataPreprocessor().fit_transform(df)
    assert out.count() <= 40 and fitted.transform(df).columns == out.columns
    assert fitted.params()["missing__strategy"] == "mean"


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 7)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (40, 3)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = {(r["query"], r["rank"]): r["other"] for r in neighbours.knn(df, df, 4, exclude_self=True).collect()}
    for i in range(40):
        want = sorted((math.dist(x[i], x[j]), j) for j in range(40) if j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in want]


def test_tanimoto(spark):
    rng = np.random.default_rng(4)
    sets = [sorted(set(rng.integers(0, 12, rng.integers(0, 9)).tolist())) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, bits array<int>")
    got = {(r["a"], r["b"]) for r in neighbours.tanimoto_links(df, 0.4).collect()}
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if sets[i] and sets[j] and 1 - len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) <= 0.4 + 1e-12}
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "rec_id long, activity double, x double")
    assert profile.feature_stats(df, ["x"]).count() == 0
    assert duplicates.DuplicateHandler().fit(df).transform(df).count() == 0
    assert df.where(F.lit(True)).count() == 0


def test_neighbours_tied_beyond_the_block_cap(spark):
    rows = [(i, [1.0, 2.0, 0.1]) for i in range(1000, 900, -1)] + [(i, [float(i), 2.0, 0.1]) for i in range(2, 30)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = neighbours.knn(df.where("id in (2, 1000)"), df, 5, exclude_self=True).orderBy("query", "rank").collect()
    assert [(r["query"], r["other"]) for r in got] == [(2, i) for i in (3, 901, 902, 903, 904)] + [(1000, i) for i in range(901, 906)]
    assert [r["d"] for r in got] == [1.0] * 5 + [0.0] * 5
