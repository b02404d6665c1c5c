"""Problems 7, 8 and 9 against brute force on small tables."""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewright.llm import leakage, packing, reading_level

# ---- p7


def test_token_count(spark):
    cases = {"": 0, "a_b1 c": 2, "a.b": 3, "é--x y": 3, " \t\r\n\f\v": 0, "x" * 100_000: 1}
    pattern = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f\v]+")
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "text string").select("text", packing.token_count(F.col("text")).alias("n"))
    for r in df.collect():
        assert r["n"] == (None if r["text"] is None else len(pattern.findall(r["text"])))


def test_public_tokenizer(spark):
    name = Path("/opt/tokenizers/byte_bpe_50k.json")
    if not name.exists():
        pytest.skip("no vocabulary file")
    df = spark.createDataFrame([("Hello world",), (None,), ("",)], "text string").select(packing.public_token_count(str(name))("text").alias("n"))
    assert [r["n"] for r in df.collect()] == [2, None, 0]


@pytest.mark.parametrize("seed, capacity", [(0, 50), (1, 1000), (2, 7)])
def test_plan_uses_every_document_once(seed, capacity):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(np.log(capacity / 4), 0.8, 3000).astype(int), 1, capacity)
    counts = np.bincount(sizes, minlength=capacity + 1)
    recipes = packing.plan(counts, capacity)
    used = np.zeros(capacity + 1, int)
    for r in recipes:
        assert r.total <= capacity and r.repeats > 0
        for s, n in r.uses.items():
            used[s] += n * r.repeats
    assert (used == counts).all()
    containers = sum(r.repeats for r in recipes)
    assert sizes.sum() / (containers * capacity) > (0.95 if capacity > 7 else 0.85)


def test_nnls():
    rng = np.random.default_rng(1)
    a = rng.uniform(size=(8, 20))
    b = a @ np.maximum(rng.normal(size=20), 0)
    x = packing.nnls(a, b)
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) < 1e-6


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    rng = np.random.default_rng(2)
    sizes = [*map(int, rng.integers(1, 90, 200)), *[30] * 100, 0, 64, 128, 129]
    rows = [(i, n, "clash") for i, n in enumerate(sizes)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, size string")
    specs = spark.createDataFrame([(1, 64), (2, 100), (3, None), (4, 0)], "spec_id long, capacity_tokens long")
    out = packing.pack(df, specs).collect()
    for spec, capacity in ((1, 64), (2, 100)):
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in out:
            if r["spec_id"] == spec:
                fill[r["container"]] += r["tokens"]
                pieces[r["doc_id"]].append(r)
        assert max(fill.values()) <= capacity and fill[0] == 0
        for i, n in enumerate(sizes):
            assert sum(r["tokens"] for r in pieces[i]) == n
            assert len(pieces[i]) == max(1, -(-n // capacity)) == pieces[i][0]["n_pieces"]
            assert sorted(r["piece"] for r in pieces[i]) == list(range(1, len(pieces[i]) + 1))
        assert 999 not in pieces
    assert {r["spec_id"] for r in out} == {1, 2}
    assert packing.pack(df.limit(0), specs).count() == 0


def test_pack_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    rows = [(1, 25), (1, 25), (1, 20), (2, 9), (2, 9), *[(7, 31)] * 20]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    out = packing.pack(df, spark.createDataFrame([(1, 10)], "spec_id long, capacity_tokens long")).collect()
    fill = defaultdict(int)
    for r in out:
        fill[r["container"]] += r["tokens"]
    assert max(fill.values()) <= 10 and sum(fill.values()) == sum(n for _, n in rows)
    assert sum(r["tokens"] == 10 and r["n_pieces"] > 1 for r in out) == 2 + 2 + 2 + 60
    assert set(fill) == set(range(1, len(fill) + 1))


# ---- p8


def _corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words, rng.integers(5, 40)))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        text = list(rng.choice(words, 60))
        source = (items[int(rng.integers(30))][1] or "").split()
        k = int(rng.integers(0, len(source)))
        docs.append((d, (", " if d % 2 else "\n").join([*text[:20], *source[k : k + 14], *text[20:]]).upper()))
    return items, docs + [(100, None), (101, ""), (102, "İ" * 5 + " " + (items[3][1] or "") + " K"), (102, "x")]


@pytest.mark.parametrize("block", [400_000, 50])
def test_leaks(spark, block):
    items, docs = _corpus()
    documents = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    out = leakage.leaks(documents, spark.createDataFrame(items, "item_id long, item_text string"), 6, block_words=block).collect()
    runs = {i: {tuple(w[k : k + 6]) for k in range(len(w) - 5)} for i, t in items for w in [leakage.words(t or "")]}
    want = {(i, d) for d, t in docs for w in [leakage.words(t or "")] for k in range(len(w) - 5) for i in runs if tuple(w[k : k + 6]) in runs[i]}
    assert {(r["item_id"], r["doc_id"]) for r in out} == want and want
    texts = dict(docs[:-1])
    for r in out:
        piece = leakage.words(texts[r["doc_id"]][r["start"] : r["stop"]])
        assert len(piece) == r["n_words"] >= 6 and tuple(piece[:6]) in runs[r["item_id"]] and tuple(piece[-6:]) in runs[r["item_id"]]
    assert leakage.leaks(documents.limit(0), spark.createDataFrame(items, "item_id long, item_text string")).count() == 0
    assert leakage.leaks(documents, spark.createDataFrame([], "item_id long, item_text string")).count() == 0


# ---- p9


def test_text_counts():
    assert reading_level.text_counts("One two. Three?! a1b")[:3] == (5, 13, 2)
    assert reading_level.text_counts("v1.2 end.")[:3] == (2, 4, 1)
    assert reading_level.text_counts("")[:3] == (0, 0, 1)


def test_levels_on_held_out_grades(spark):
    rng = np.random.default_rng(4)
    easy, hard, common = ([f"{p}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] for p in ("e", "h", "c"))
    docs, truth = [], {}
    for d in range(400):
        level = rng.uniform(1, 5)
        share = (level - 1) / 4
        text = [str(rng.choice(hard if rng.random() < share else easy)) if rng.random() < 0.6 else str(rng.choice(common)) for _ in range(120)]
        docs.append((d, "text", " ".join(text) + "."))
        truth[d] = level
    docs += [(900, None, None), (901, "text", ""), (902, "text", "...")]
    grades = [(d, int(round(truth[d]))) for d in range(60)] + [(0, 1), (1, None), (7777, 3)]
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    out = {r["doc_id"]: r for r in reading_level.reading_levels(frame, spark.createDataFrame(grades, "doc_id long, level_no int")).collect()}
    held = [d for d in range(60, 400)]
    assert np.corrcoef([truth[d] for d in held], [out[d]["level"] for d in held])[0, 1] > 0.9
    assert len(out) == 403 and out[900]["level"] == out[901]["level"] == out[902]["level"] is not None
    kept = reading_level.held_out(frame, spark.createDataFrame([(d, int(round(truth[d]))) for d in range(200)], "doc_id long, level_no int")).first()
    assert kept["n"] > 20 and kept["error"] < 0.7 * kept["error_of_mean"] and kept["correlation"] > 0.8
    assert out[5]["grade"] is not None and out[100]["grade"] is None
    bare = reading_level.reading_levels(frame, spark.createDataFrame([], "doc_id long, level_no int"))
    assert bare.count() == 403 and bare.where("level is not null").count() == 0
    assert reading_level.reading_levels(frame.limit(0), spark.createDataFrame(grades, "doc_id long, level_no int")).count() == 0
