"""Neighbours cut by place against brute force, and how many pairs of rows are looked at."""

from __future__ import annotations

import numpy as np
import pytest

from lodewright.operators import models, neighbours


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 40)
    monkeypatch.setattr(neighbours, "FEW", 1)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id long, x array<double>")


@pytest.mark.parametrize("same", [False, True])
def test_places_find_all(spark, small_blocks, same):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 2, 500), rng.normal(size=500).round(1), rng.exponential(size=500)])
    x[200:320] = [1.0, 0.5, 0.25]  # more equal rows than a block has
    fitted = frame(spark, range(500), x)
    q = x if same else np.concatenate([rng.normal(size=(60, 3)), x[190:240], [[90.0, -90.0, 5.0]]])
    queries = fitted if same else frame(spark, range(1000, 1000 + len(q)), q)
    got = {}
    for r in neighbours.knn(queries, fitted, 6, exclude_self=same).collect():
        got[r["query"], r["rank"]] = (r["other"], r["d"])
    for i, row in enumerate(q):
        d = np.sqrt(((x - row) ** 2).sum(1))
        if same:
            d[i] = np.inf
        name = i if same else 1000 + i
        order = np.lexsort((np.arange(500), d))[:6]
        assert [got[name, r + 1][0] for r in range(6)] == order.tolist()
        assert [got[name, r + 1][1] for r in range(6)] == pytest.approx(d[order])
    assert len(got) == 6 * len(q)


def test_few_rows_meet(spark, small_blocks, monkeypatch):
    met = spark.sparkContext.accumulator(0)
    inner = neighbours._best

    def counted(a, qi, b, ti, k, exclude_self):
        met.add(len(a) * len(b))
        return inner(a, qi, b, ti, k, exclude_self)

    monkeypatch.setattr(neighbours, "_best", counted)
    fitted = frame(spark, range(2000), np.random.default_rng(3).uniform(size=(2000, 2)))
    neighbours.knn(fitted, fitted, 3, exclude_self=True).collect()
    assert 0 < met.value < 2000 * 2000 / 4  # all pairs before


def test_classes_are_looked_up_once(spark, monkeypatch):
    calls = []
    inner = neighbours.knn
    monkeypatch.setattr(neighbours, "knn", lambda *a, **k: calls.append(1) or inner(*a, **k))
    rows = spark.createDataFrame([(i, float(i % 4 == 0), float(i % 4), 0.0) for i in range(40)], "rec_id long, activity double, p double, q double")
    out = models.fit_model("KNeighbors", rows, ["p", "q"], "activity", True).score(rows)
    assert out.where("predicted = activity and probability = activity").count() == 40 and len(calls) == 1
