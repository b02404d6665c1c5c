"""Problems 1, 2, 4, 5 and 6 against brute force on small tables."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewright.llm import calibrated_sample, cross_split, density_clusters, edits, format_duplicates, related_splits
from lodewright.llm.cleanform import clean_form, clean_pieces, fold
from lodewright.llm.components import connected_components
from lodewright.session import Scratch


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def closed(ids, links) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- clean form


def test_clean_form(spark):
    cases = [
        ("C C(=O)", "cc(=o)"), ("ＣＣ＝Ｏ", "cc=o"), ("[O–]C", "[o-]c"), ("b..a.B", "a.b.b"), ("", None), (None, None), ("...", None), ("!?", None), ("²", "2"), ("K", "k"), ("É", None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").select("i", clean_form(F.col("x")).alias("c"))
    assert {r["i"]: r["c"] for r in df.collect()} == {i: c for i, (_, c) in enumerate(cases)}
    assert fold("−A") == "-a"


# ---- p1


def _records(spark, rows):
    df = spark.createDataFrame(rows, "id long, s string, v double, pairs string")
    fields = {"s": clean_pieces(F.col("s")), "v": F.when(F.col("v").isNotNull(), F.array(F.col("v").cast("string")))}
    return df.select("id", F.when(F.size(clean_pieces(F.col("s"))) > 0, format_duplicates.as_pairs(fields)).alias("pairs"), F.lit("x").alias("h1"), F.lit("y").alias("first_id"))


def test_format_duplicates(spark):
    rows = [
        (9, "CC.N", 1.0, "z"), (2, "n . cc", 1.0, None), (3, "N.CC", None, None), (4, "cc.n", None, None), (5, "CC.N.N", 1.0, None),
        (6, None, 1.0, None), (7, "", 1.0, None), (8, "?", 1.0, None), (2, "n.cc", 1.0, None),
    ]
    got = Counter((r["first_id"], r["id"]) for r in format_duplicates.collapse(_records(spark, rows), "id", "pairs").collect())
    assert got == Counter({(2, 9): 1, (2, 2): 2, (3, 3): 1, (3, 4): 1, (5, 5): 1})
    assert format_duplicates.collapse(_records(spark, rows[5:6]), "id", "pairs").count() == 0
    long_text = "c" * 200_000
    assert format_duplicates.collapsed(_records(spark, [(1, long_text, 1.0, ""), (2, long_text.upper(), 1.0, "")]), "id", "pairs").first()["n_copies"] == 2


def test_records_of_many_equal_pieces(spark):
    many = "Cl." * 600 + "N." * 2000
    rows = [(1, many + "CC", 1.0, ""), (2, "cc." + many, 1.0, ""), (3, many + "CC.N", 1.0, "")]
    got = {(r["first_id"], r["id"]) for r in format_duplicates.collapse(_records(spark, rows), "id", "pairs").collect()}
    assert got == {(1, 1), (1, 2), (3, 3)}


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(format_duplicates, "multiset_hash", lambda pairs, seed: F.lit(1).cast("long"))
    rows = [(1, "a", 1.0, ""), (2, "b", 1.0, ""), (3, "A", 1.0, ""), (4, "B", 1.0, "")]
    got = {(r["first_id"], r["id"]) for r in format_duplicates.collapse(_records(spark, rows), "id", "pairs").collect()}
    assert got == {(1, 1), (1, 3), (2, 2), (2, 4)}


def test_hot_group_is_split(spark):
    rows = [(i, "CC.N" if i % 2 else f"C{'c' * (i % 50)}", 1.0, "") for i in range(400)]
    df = _records(spark, rows)
    want = {(r["first_id"], r["id"]) for r in format_duplicates.collapse(df, "id", "pairs").collect()}
    out = format_duplicates.collapse(df, "id", "pairs", hot_rows=20)
    assert {(r["first_id"], r["id"]) for r in out.collect()} == want and len(want) == 400


# ---- p2


def test_tilting_meets_targets_of_crossed_categories():
    counts = np.array([100.0, 300.0, 50.0, 550.0])
    design = np.array([[1, 0, 1], [1, 0, 0], [0, 1, 1], [0, 1, 0]], float)
    p = calibrated_sample.tilted_rates(counts, design, np.array([60.0, 40.0, 30.0]), 0.1)
    assert design.T @ (counts * p) == pytest.approx([60, 40, 30], abs=1e-6)
    full = calibrated_sample.tilted_rates(np.array([5.0, 100.0]), np.eye(2), np.array([5.0, 20.0]), 0.1)
    assert full == pytest.approx([1.0, 0.2])


def test_pivotal_keeps_expectations():
    rng = np.random.default_rng(0)
    hits = np.zeros(10)
    p = rng.uniform(0.1, 0.9, 10)
    for _ in range(4000):
        taken, rest = calibrated_sample.pivotal(np.arange(10), p, rng.uniform(size=10))
        hits[taken] += 1
        for i, w in rest:
            hits[i] += w
        assert abs(len(taken) + sum(w for _, w in rest) - p.sum()) < 1e-9
    assert hits / 4000 == pytest.approx(p, abs=0.04)


def test_sample(spark):
    rows = [(i, "e" if i % 4 else None, None if i % 10 == 0 else float(i % 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, stratum string, value double")
    bands = spark.createDataFrame([(1, "e", 0.0, 2.0, 50, 3), (2, "e", 2.0, 4.0, 30, None), (3, "e", 4.0, 4.5, 20, 400), (4, "none", 0.0, 1.0, 100, 7)], "band_id long, stratum string, low double, below double, target_pct long, min_rows long")
    strata = spark.createDataFrame([("e", 30), ("none", 10)], "stratum string, sample_pct long")
    plan = {r["band_id"]: r for r in calibrated_sample.band_plan(df, bands, strata).collect()}
    valued = [v for i, s, v in rows if s == "e" and v is not None]
    size = 30 * len(valued) // 100
    want = {1: max(3, -(-50 * size // 100)), 2: -(-30 * size // 100), 3: 400, 4: 7}
    have = {1: sum(v < 2 for v in valued), 2: sum(2 <= v < 4 for v in valued), 3: sum(4 <= v < 4.5 for v in valued), 4: 0}
    assert {b: (r["wanted"], r["shortfall"]) for b, r in plan.items()} == {b: (want[b], max(0, want[b] - have[b])) for b in want}
    drawn = calibrated_sample.draw(df, bands, calibrated_sample.band_plan(df, bands, strata)).collect()
    assert Counter(r["band_id"] for r in drawn) == {b: n for b in want if (n := min(want[b], have[b]))}
    assert len({r["id"] for r in drawn}) == len(drawn)
    again = calibrated_sample.draw(df, bands, calibrated_sample.band_plan(df, bands, strata)).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in drawn}
    none = df.limit(0)
    assert calibrated_sample.draw(none, bands, calibrated_sample.band_plan(none, bands, strata)).count() == 0


def test_crossed_sample_meets_both_sets_of_shares(spark):
    rows = [(i, "e", float(i % 4), None if i % 9 == 0 else "ab"[i % 3 == 0]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, stratum string, value double, category string")
    bands = spark.createDataFrame([(1, "e", 0.0, 1.0, 60, 0), (2, "e", 1.0, 4.0, 40, 0)], "band_id long, stratum string, low double, below double, target_pct long, min_rows long")
    strata = spark.createDataFrame([("e", 20)], "stratum string, sample_pct long")
    plan = calibrated_sample.crossed_plan(df, bands, strata)
    by = lambda c: {r[0]: r[1] for r in plan.groupBy(c).agg(F.sum("expected")).collect()}
    assert by("band_id") == pytest.approx({1: 480, 2: 320}, abs=1e-3)
    share = Counter(c or "" for _, _, _, c in rows)
    assert by("category") == pytest.approx({c: 800 * n / 4000 for c, n in share.items()}, abs=1e-3)
    drawn = calibrated_sample.draw(df, bands, plan).collect()
    assert len({r["id"] for r in drawn}) == len(drawn) and abs(len(drawn) - 800) <= 6
    got = Counter(rows[r["id"]][3] or "" for r in drawn)
    assert all(abs(got[c] - 800 * n / 4000) <= 3 for c, n in share.items())
    report = {r["band_id"]: r for r in calibrated_sample.sample_report(df.drop("category"), bands, strata).collect()}
    assert {b: (r["n_drawn"], r["missed"]) for b, r in report.items()} == {1: (480, 0), 2: (320, 0)}


# ---- p4


def _mutated(rng, base: str, n: int) -> str:
    for _ in range(n):
        i = int(rng.integers(0, len(base) + 1))
        kind = rng.integers(3)
        c = "abcd"[int(rng.integers(4))]
        base = base[:i] + c + base[i:] if kind == 0 else base[:i] + base[i + 1 :] if kind == 1 else base[:i] + c + base[i + 1 :]
    return base


def _texts(seed: int, n: int, low: int, high: int, most: int):
    rng = np.random.default_rng(seed)
    bases = ["".join(rng.choice(list("abcd"), int(rng.integers(low, high)))) for _ in range(n // 5)]
    return [_mutated(rng, bases[int(rng.integers(len(bases)))], int(rng.integers(0, most))) for _ in range(n)]


@pytest.mark.parametrize("low, high", [(0, 8), (20, 40)])
def test_cross_split(spark, low, high):
    a, b = _texts(1, 60, low, high, 4), _texts(1, 50, low, high, 5)
    train = [(i, t) for i, t in enumerate(a)] + [(900, None), (901, ""), (902, a[0])]
    evals = [(1000 + i, t) for i, t in enumerate(b)] + [(1900, None), (1901, "")]
    make = lambda rows: spark.createDataFrame([(i, t, "clash") for i, t in rows], "id long, text string, key string")
    got = Counter((r["train_id"], r["eval_id"]) for r in cross_split.cross_split_pairs(make(train), make(evals)).collect())
    want = Counter((i, j) for i, s in train for j, t in evals if s and t and edit_distance(s, t) <= 3)
    assert got == want and want
    assert cross_split.cross_split_pairs(make(train).limit(0), make(evals)).count() == 0


def test_overlap_counts_and_large_classes(spark, monkeypatch):
    monkeypatch.setattr(cross_split, "PART_ROWS", 3)
    texts = _texts(9, 40, 10, 20, 3)
    train = [(i, texts[i % 20]) for i in range(60)] + [(900, None)]
    evals = [(1000 + i, texts[20 + i % 10], "p") for i in range(30)] + [(1900, None, "p"), (1901, "", "p")]
    t, e = spark.createDataFrame(train, "id long, text string"), spark.createDataFrame(evals, "id long, text string, part string")
    want = Counter((i, j) for i, s in train for j, x, _ in evals if s and x and edit_distance(s, x) <= 3)
    got = Counter((r["train_id"], r["eval_id"]) for r in cross_split.cross_split_pairs(t, e).collect())
    assert got == want and want
    counts = {r["id"]: r["n_pairs"] for r in cross_split.overlap_counts(t, e).collect()}
    assert counts == Counter(j for _, j in want.elements())


def test_signatures_never_exceed_their_bounds(spark):
    rng = np.random.default_rng(2)
    pairs = [(s, _mutated(rng, s, 6)) for s in ["".join(rng.choice(list("cn(=)[1s"), 60)) for _ in range(200)]]
    df = spark.createDataFrame(pairs, "a string, b string")
    one = edits.signature_distance(edits.signature(F.col("a")), edits.signature(F.col("b")))
    side = lambda c: [F.col(c)[i] for i in range(4)]
    df = df.withColumns({"pa": edits.pair_signature("a"), "pb": edits.pair_signature("b")}).select("a", "b", one.alias("one"), edits.pair_distance(side("pa"), side("pb")).alias("two"))
    for r in df.collect():
        d = edit_distance(r["a"], r["b"])
        assert r["one"] <= 2 * d and r["two"] <= 4 * d


# ---- p5


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 480)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == closed({x for e in links for x in e}, links)
    assert connected_components(df.limit(0)).count() == 0


def _related(spark, n=200):
    rng = np.random.default_rng(4)
    rows = [(i, None if rng.random() < 0.3 else f"c{rng.integers(120)}", None if rng.random() < 0.5 else f"s{rng.integers(60)}", float(rng.normal())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "rec_id long, k0 string, study string, value double")


def test_groups(spark):
    rows, df = _related(spark)
    got = {r["id"]: r["group_id"] for r in related_splits.group_records(df, "rec_id", ["k0", "study"]).collect()}
    links = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if (a[1] and a[1] == b[1]) or (a[2] and a[2] == b[2])]
    assert got == closed([r[0] for r in rows], links)


def test_component_table_grows_by_batches(spark, tmp_path):
    rows, df = _related(spark, 240)
    store = related_splits.ComponentTable(spark, str(tmp_path / "table"))
    targets = related_splits.Targets(("train", "valid"), (0.7, 0.3))
    assert store.groups().count() == 0
    given = []
    for low, high in ((0, 120), (120, 120), (120, 200), (200, 240)):
        part = df.where(f"rec_id >= {low} and rec_id < {high}")
        given.append({r["component"]: r for r in store.extend(part, "rec_id", ["k0", "study"], targets, "value").collect()})
        seen = [r for r in rows if r[0] < high]
        links = [(a[0], b[0]) for a, b in itertools.combinations(seen, 2) if (a[1] and a[1] == b[1]) or (a[2] and a[2] == b[2])]
        assert {r["id"]: r["group_id"] for r in store.groups().collect()} == closed([r[0] for r in seen], links)
    assert given[1] == {} and {r["status"] for r in given[0].values()} == {"new"}
    state = {r["component"]: r for r in store.components().collect()}
    groups = closed([r[0] for r in rows], [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if (a[1] and a[1] == b[1]) or (a[2] and a[2] == b[2])])
    size = Counter(groups.values())
    assert {c: r["n_rows"] for c, r in state.items()} == size


def test_component_table_keeps_and_quarantines(spark, tmp_path):
    store = related_splits.ComponentTable(spark, str(tmp_path / "table"))
    targets = related_splits.Targets(("train", "valid"), (0.5, 0.5))
    first = spark.createDataFrame([(i, f"c{i}", None) for i in range(40)], "rec_id long, c string, s string")
    splits = {r["component"]: r["split_name"] for r in store.extend(first, "rec_id", ["c", "s"], targets).collect()}
    t = sorted(i for i, s in splits.items() if s == "train")
    v = sorted(i for i, s in splits.items() if s == "valid")
    assert t and v
    second = [(100, f"c{t[0]}", "x"), (101, f"c{t[1]}", "x"), (102, f"c{t[2]}", "y"), (103, f"c{v[0]}", "y"), (104, "new", None), (105, None, None), (-5, f"c{v[1]}", None)]
    got = {r["component"]: (r["n_rows"], r["split_name"], r["status"]) for r in store.extend(spark.createDataFrame(second, "rec_id long, c string, s string"), "rec_id", ["c", "s"], targets).collect()}
    assert got[min(t[0], t[1])] == (4, "train", "kept") and got[min(t[2], v[0])] == (4, "quarantine", "conflict")
    assert got[-5] == (2, "valid", "kept") and got[104][2] == got[105][2] == "new" and len(got) == 5
    assert {r["id"] for r in store.groups().where("group_id = -5").collect()} == {-5, v[1]}


def test_assignment_and_increment(spark):
    rows = [(i, i // 3, float(i % 7) if i % 11 else None) for i in range(6000)]
    records = spark.createDataFrame(rows, "id long, group_id long, value double")
    targets = related_splits.Targets(("train", "valid", "test"), (0.8, 0.1, 0.1))
    out = related_splits.assign(records, targets).collect()
    share = Counter()
    for r in out:
        share[r["split_name"]] += r["n_rows"]
    assert sum(share.values()) == 6000 and abs(share["train"] - 4800) < 150 and abs(share["valid"] - 600) < 150
    before = spark.createDataFrame([(0, "test"), (1, "test"), (3, "train"), (4, "valid"), (9, None)], "id long, split_name string")
    got = {r["group_id"]: (r["split_name"], r["status"]) for r in related_splits.assign(records, targets, before).collect()}
    assert got[0] == ("test", "kept") and got[1] == (related_splits.QUARANTINE, "conflict") and got[3][1] == "new"
    hot = spark.createDataFrame([(i, 0 if i < 400 else i, 1.0) for i in range(1000)], "id long, group_id long, value double")
    splits = {r["group_id"]: r["split_name"] for r in related_splits.assign(hot, targets).collect()}
    assert splits[0] == "train" and sum(1 for g, s in splits.items() if g and s == "train") < 500
    assert related_splits.assign(records.limit(0), targets).count() == 0


# ---- p6

SMALL = density_clusters.Settings(k=3, gram=5, window=2, min_size=2)


def test_linked_clusters(spark):
    texts = _texts(5, 120, 25, 45, 3) + ["ab", "abc", "zzzzzzzz", None, "", "ab"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, key string")
    got = {(r["cluster_id"], r["id"]) for r in density_clusters.linked_clusters(df, SMALL).collect()}
    real = [(i, t) for i, t in enumerate(texts) if t]
    roots = closed([i for i, _ in real], [(i, j) for (i, s), (j, t) in itertools.combinations(real, 2) if edit_distance(s, t) <= 3])
    size = Counter(roots.values())
    assert got == {(r, i) for i, r in roots.items() if size[r] > 1}
    assert density_clusters.linked_clusters(df.limit(0), SMALL).count() == 0


def test_neighbours_without_a_common_run(spark):
    """Edits spread evenly leave no run of 20 characters; also ones crowded at either end."""
    rng = np.random.default_rng(8)
    texts = []
    for n in (70, 90, 91, 140):
        base = "".join(rng.choice(list("cno(=)1"), n))
        for places in ([(i + 1) * n // 9 for i in range(8)], list(range(8)), list(range(n - 8, n)), [*range(4), *range(n - 4, n)]):
            for kind in range(3):
                out = list(base)
                for p in places:
                    out[p] = ("", "x", "x" + out[p])[kind]
                texts.append("".join(out))
        texts.append(base)
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = density_clusters.neighbours(density_clusters.distinct_texts(df), density_clusters.Settings(), Scratch(spark)).collect()
    want = {(i, j, d) for (i, s), (j, t) in itertools.combinations(enumerate(texts), 2) if abs(len(s) - len(t)) <= 8 and (d := edit_distance(s, t)) <= 8}
    assert sorted(tuple(r) for r in found) == sorted(want) and len(want) > 40


def test_neighbours_move_no_keys(spark):
    """Texts are looked up where they are read: what is shuffled is a few hundred bytes a text, however many keys it has."""
    rng = np.random.default_rng(9)
    pieces = ["".join(rng.choice(list("cno(=)1sf"), rng.integers(3, 8))) for _ in range(60)]
    texts = ["".join(rng.choice(pieces, 18)) for _ in range(1500)]
    texts = sorted({*texts, *(_mutated(rng, t, 6) for t in texts[:300])})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    scratch = Scratch(spark)
    distinct = scratch.save(density_clusters.distinct_texts(df))

    def written() -> int:
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).head().totalShuffleWrite()

    before = written()
    found = {(r["a"], r["b"]) for r in density_clusters.neighbours(distinct, density_clusters.Settings(), scratch).collect()}
    assert len(found) >= 250 and all(edit_distance(texts[a], texts[b]) <= 8 for a, b in found)
    assert written() - before < 500 * len(texts)


def test_neighbours_by_blocks(spark, monkeypatch):
    """Blocks of a few texts, several of them of one length, find what one block finds."""
    monkeypatch.setattr(density_clusters, "BLOCK_TEXTS", 40)
    rng = np.random.default_rng(10)
    bases = ["".join(rng.choice(list("cno(=)1é𝔸"), n)) for n in (40, 47, 60, 60, 90, 150, 200)]
    texts = sorted({*bases, *(_mutated(rng, b, 8) for b in bases for _ in range(20)), *("ab" * n for n in range(12, 24))})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = density_clusters.neighbours(density_clusters.distinct_texts(df), density_clusters.Settings(), Scratch(spark)).collect()
    want = {(i, j, d) for (i, s), (j, t) in itertools.combinations(enumerate(texts), 2) if abs(len(s) - len(t)) <= 8 and (d := edit_distance(s, t)) <= 8}
    assert sorted(tuple(r) for r in found) == sorted(want) and len(want) > 100


def test_spanning_forest_weight(spark):
    rng = np.random.default_rng(6)
    edges = {(min(a, b), max(a, b)): int(w) for a, b, w in rng.integers(0, 60, (150, 3)) if a != b}
    df = spark.createDataFrame([(int(a), int(b), w % 5 + 1) for (a, b), w in edges.items()], "a long, b long, w int")
    forest, labels = density_clusters.spanning_forest(df, Scratch(spark))
    root, total = {x: x for e in edges for x in e}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), w in sorted(edges.items(), key=lambda e: e[1] % 5):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w % 5 + 1
    assert forest.agg(F.sum("w")).first()[0] == total
    assert {r["node"]: r["root"] for r in labels.collect()} == closed(list(root), list(edges))


def test_density_clusters(spark):
    rng = np.random.default_rng(7)
    bases = ["".join(rng.choice(list("abcd"), 40)) for _ in range(3)]
    texts = [_mutated(rng, b, 1) for b in bases for _ in range(8)] + ["".join(rng.choice(list("abcd"), 40)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    summary, members = density_clusters.density_clusters(df, SMALL)
    by = defaultdict(set)
    for r in members.collect():
        by[r["cluster_id"]].add(r["id"] // 8)
    assert all(len(bases_) == 1 for bases_ in by.values()) and {b for s in by.values() for b in s} == {0, 1, 2}
    for r in summary.collect():
        assert 1 <= len(r["exemplar_ids"]) <= 3 and r["n_texts"] >= 2 and r["n_rows"] >= r["n_texts"] and r["stability"] > 0


def _hierarchy_by_hand(texts, k, need, least):
    """Members of the selected clusters, over whole-number levels, by brute force."""
    n = len(texts)
    d = {(i, j): edit_distance(texts[i], texts[j]) for i, j in itertools.combinations(range(n), 2)}
    core = {}
    for i in range(n):
        near = sorted(x for (a, b), x in d.items() if i in (a, b) and x <= k)
        core[i] = near[need - 2] if len(near) >= need - 1 else k + 1
    w = {(i, j): max(x, core[i], core[j]) for (i, j), x in d.items() if x <= k}
    parts = {level: closed(range(n), [e for e, x in w.items() if x <= level]) for level in range(k + 2)}
    big = {level: {r: frozenset(i for i in range(n) if parts[level][i] == r) for r in set(parts[level].values())} for level in parts}
    big = {level: {r: m for r, m in ms.items() if len(m) >= least} for level, ms in big.items()}

    def best(level, r):
        """(stability, selected) of the cluster that begins with this part."""
        total, own = 0.0, big[level][r]
        while True:
            total += len(big[level][r]) * (1 / level - 1 / (level + 1))
            below = [x for x in big[level - 1] if big[level - 1][x] <= big[level][r]] if level > 1 else []
            if len(below) != 1:
                break
            level, r = level - 1, below[0]
        parts_ = [best(level - 1, x) for x in below]
        inner = sum(x for x, _ in parts_)
        return (total, [own]) if total >= inner else (inner, [m for _, ms in parts_ for m in ms])

    return {m for r in big[k + 1] for m in best(k + 1, r)[1]}


def test_density_clusters_by_hand(spark):
    for seed in (1, 2):
        texts = sorted(set(_texts(20 + seed, 70, 20, 30, 4)))
        want = _hierarchy_by_hand(texts, 3, 4, 3)
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        _, members = density_clusters.density_clusters(df, density_clusters.Settings(k=3, gram=5, window=2, min_samples=4, min_size=3))
        by = defaultdict(set)
        for r in members.collect():
            by[r["cluster_id"]].add(r["id"])
        assert {frozenset(m) for m in by.values()} == want and want
