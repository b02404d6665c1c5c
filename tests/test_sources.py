"""Files, structures, streams and the command line."""

from __future__ import annotations

import gzip
import json
import uuid

import pytest
from pyspark.sql import functions as F

from lodewright import __main__ as cli
from lodewright.functions import chem, patterns, standardise
from lodewright.operators.missing import MissingHandler
from lodewright.operators.scaling import Rescaler
from lodewright.sources import files
from lodewright.streaming import score


def test_files(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    (tmp_path / "t.json").write_text(json.dumps(rows))
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "t.csv.gz").write_bytes(gzip.compress(b'a,b\n1,"x"\n2,y\n'))
    for name in ("t.json", "t.jsonl", "t.csv.gz"):
        assert {(r["a"], r["b"]) for r in files.read_data(spark, str(tmp_path / name)).collect()} == {(1, "x"), (2, "y")}
    with pytest.raises(ValueError):
        files.read_data(spark, "t.xls")
    df = files.from_records(spark, {"a": [1, 2], "b": ["x", "y"]})
    out = str(tmp_path / "out")
    assert files.write_table(df, out, numbered=True) == out and files.write_table(df, out, "csv", numbered=True) == f"{out} (1)"


def test_parse():
    m = chem.parse("c1ccccc1C(=O)[O-].[Na+]")
    assert len(m) == 10 and m.n_rings() == 1 and sum(m.charges) == 0 and len(m.components()) == 2
    assert all(chem.parse(t) is None for t in ("C(", "C1CC", "C)", "", None, "C!", "[C"))
    assert chem.parse("CC").hydrogens == [3, 3]


def test_structure_columns(spark):
    df = spark.createDataFrame([(1, "OCc1ccccc1"), (2, "c1ccccc1CO"), (3, "CCC"), (4, "bad("), (5, None)], "id long, s string")
    got = {r["id"]: r for r in df.select("id", chem.scaffold(F.col("s")).alias("k"), chem.features(F.col("s"), "ECFP4").alias("e"), chem.features(F.col("s"), "RDK5").alias("p"), chem.features(F.col("s"), "RDKdes").alias("d")).collect()}
    assert got[1]["k"] == got[2]["k"] != got[3]["k"] == "" and got[4]["k"] is None and got[5]["e"] is None
    assert got[1]["e"] == got[2]["e"] and got[1]["p"] == got[2]["p"] and len(got[1]["d"]) == len(chem.DESCRIPTORS)
    with pytest.raises(chem.MissingBackend):
        chem.featurizer("MACCS")
    with pytest.raises(ValueError):
        chem.featurizer("nothing")
    assert chem.generate(df, "s", ["ECFP2"])["ECFP2"].count() == 3


@pytest.mark.parametrize("one, other", [("OCC", "CCO"), ("c1ccccc1C", "Cc1ccccc1"), ("C1CC1C(=O)N", "NC(=O)C1CC1"), ("c1ccc2ccccc2c1", "c1cccc2c1cccc2"), ("[NH3+]CC([O-])=O", "O=C([O-])C[NH3+]"), ("c1ccccc1c1ccncc1", "n1ccc(cc1)-c1ccccc1")])
def test_canonical_lines(one, other):
    a, b = (chem.write(chem.parse(t)) for t in (one, other))
    assert a == b == chem.write(chem.parse(a))
    assert chem.parse(a).hydrogens and sum(chem.parse(a).hydrogens) == sum(chem.parse(one).hydrogens)


@pytest.mark.parametrize(
    "text, settings, want",
    [
        ("CN(=O)=O", {}, "C[N+]([O-])=O"), ("[H]C([H])([H])O", {}, "CO"), ("OC=C", {}, "O=CC"), ("NC(O)=N", {}, "NC(=O)N"), ("C[C@H](N)O", {}, "C[C@H](N)O"), ("C[C@H](C)O", {}, "CC(C)O"),
        ("C/C=C(C)C", {}, "CC=C(C)C"), ("F/C=C/F", {}, "F/C=C/F"), ("C/C=C/C.[Na+]", {"salts": True, "largest": True, "drop_stereo": True}, "CC=CC"), ("CC(=O)[O-].[Na+]", {"salts": True, "uncharge": True}, "CC(=O)O"),
        ("C[NH3+]", {"uncharge": True}, "CN"), ("C[N+](C)(C)C.[O-]C", {"uncharge": True}, "C[N+](C)(C)C.[O-]C"), ("[O-]c1ccccc1C(=O)O", {"reionise": True}, "Oc1ccccc1C(=O)[O-]"), ("bad(", {}, None), (None, {}, None),
    ],
)
def test_standardise(text, settings, want):
    assert standardise.Standardizer(**settings).one(text) == want


def test_patterns_and_keys(tmp_path):
    m = chem.parse("c1ccc2ccccc2c1CC1CCCCC1C(=O)N")
    view = patterns.View(m)
    assert sorted(map(len, view.rings)) == [6, 6, 6] and sorted(map(len, patterns.rings_of(chem.parse("C12C3C4C1C5C2C3C45")))) == [4] * 5
    found = {p: patterns.compile_pattern(p).count(view, 9) for p in ("C(=O)[NH2]", "c1ccccc1", "[$(C=O)]", "[#7;!R]", "C-!@C", "[r6]~[CH2;R]", "N#N", "[D3]")}
    assert found == {"C(=O)[NH2]": 1, "c1ccccc1": 2, "[$(C=O)]": 1, "[#7;!R]": 1, "C-!@C": 2, "[r6]~[CH2;R]": 5, "N#N": 0, "[D3]": 6}
    bits = chem.featurizer("PubChem")(m)
    assert {9, 10, 11, 12, 0, 1, 2, 14, 18, 178, 185, 192, 255, 257} <= set(bits) and max(bits) < 327
    (tmp_path / "keys").write_text("# bit, pattern, matches\n327\tC(=O)N\n330\tc:c\t12\n")
    chem.register_keys("PubChem", str(tmp_path / "keys"))
    chem.register_keys("MACCS", str(tmp_path / "keys"))
    try:
        assert set(chem.featurizer("PubChem")(m)) - set(bits) == {327} and chem.featurizer("MACCS")(m) == [327]
    finally:
        chem._KEYS.clear()
    with pytest.raises(ValueError):
        patterns.compile_pattern("C(")


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 1.0, 1), (2, 1.0, None, 0), (3, 0.0, 3.0, 1)], "rec_id long, activity double, x double, b int")
    df.write.parquet(str(tmp_path / "in"))
    missing = MissingHandler().fit(df)
    steps = [missing, Rescaler().fit(missing.transform(df))]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    score.write_stream(score.transform_stream(stream, steps), str(tmp_path / "out"), f"test-{uuid.uuid4().hex}").awaitTermination()
    assert {(r["rec_id"], r["x"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 0.0), (2, 0.5), (3, 1.0)}


def test_command_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text("rec_id,activity,x\n" + "\n".join(f"{i},{i % 2},{i * 0.5}" for i in range(20)))
    cli.main(["validate", str(tmp_path / "t.csv"), str(tmp_path / "report"), "--models", "Dummy", "--splits", "2", "--repeats", "1"])
    assert spark.read.csv(str(tmp_path / "report"), header=True).columns == ["scoring", "cv_cycle", "Dummy"]
    rows = "\n".join(f"{i},{0.5 * i + i % 3},{i * 0.5},{i % 5}" for i in range(40))
    (tmp_path / "fit.csv").write_text("rec_id,activity,x,z\n" + rows)
    quick = ["--models", "Linear", "--splits", "2", "--repeats", "1", "--conformal", "n_splits=2", "--domain", '{"method": "knn"}', "--kbin", "deactivate=true"]
    cli.main(["fit", str(tmp_path / "fit.csv"), str(tmp_path / "saved"), *quick])
    cli.main(["predict", str(tmp_path / "fit.csv"), str(tmp_path / "predicted"), "--model-path", str(tmp_path / "saved"), "--alpha", "0.2"])
    out = spark.read.parquet(str(tmp_path / "predicted"))
    assert out.count() == 40 and {"Predicted value", "Applicability domain", "Prediction Interval (alpha=0.2)"} <= set(out.columns)
    with pytest.raises(SystemExit):
        cli.main(["predict", str(tmp_path / "fit.csv"), str(tmp_path / "p2")])


def test_named_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, None)], "a long, split string")
    paths = files.write_split(df, str(tmp_path), name="_x")
    assert set(paths) == {"train", "test"} and spark.read.parquet(paths["train"]).collect()[0]["a"] == 1
    assert files.write_split(df, str(tmp_path), name="_x")["train"].endswith("train_x (1)")
    assert files.write_features({"ECFP4": df}, str(tmp_path), "d")["ECFP4"].endswith("d_ECFP4")
    assert spark.read.csv(files.write_reports({"cv": df}, str(tmp_path))["cv"], header=True).count() == 3
