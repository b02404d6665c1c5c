"""Records that fail to parse, against a character-by-character reader."""

from __future__ import annotations

import pytest

from lodewright.sources.rejects import parse_records

SCHEMA = "raw_id long, record_kind string, raw_line string, structure string, note string"

CASES = [
    # kind, line, reason (None: it loads)
    ("train_val", "a,CC,1.5", None),
    ("train_val", "a,CC,1.5\r", None),
    ("train_val", '"a,b",CC,', None),
    ("train_val", '"a ""q"" b",CC,-1e-3', None),
    ("train_val", '"a\nb"," C(C) ", .5 ', None),
    ("train_val", "a,C1CC1,5.", None),
    ("train_val", "a,[nH]1cc1,+2E+5", None),
    ("train_val", "a,CC", "field count 2"),
    ("train_val", "a,b,CC,1", "field count 4"),
    ("train_val", "", "field count 1"),
    ("train_val", 'a"b,CC,1', "unclosed quote"),
    ("train_val", 'a"b"c,CC,1', "misplaced quote"),
    ("train_val", ' "a",CC,1', "misplaced quote"),
    ("train_val", '"a" ,CC,1', "misplaced quote"),
    ("train_val", "a,,1", "empty structure"),
    ("train_val", "a,C C,1", "invalid character in structure"),
    ("train_val", "a,C[N,1", "unbalanced square bracket"),
    ("train_val", "a,C[N[O]],1", "unbalanced square bracket"),
    ("train_val", "a,C[N(O)],1", "unbalanced square bracket"),
    ("train_val", "a,C(C,1", "unbalanced round bracket"),
    ("train_val", "a,C)C(,1", "unbalanced round bracket"),
    ("train_val", "a,C1CC,1", "unpaired ring digit"),
    ("train_val", "a,CC,1,5", "field count 4"),
    ("train_val", "a,CC,1e", "invalid number"),
    ("train_val", "a,CC,NaN", "invalid number"),
    ("train_val", "a,CC,١", "invalid number"),
    ("train_val", None, "no line"),
    ("testcase", "CC,7", None),
    ("testcase", "a,CC,7", "field count 3"),
    ("other", "CC,7", "unknown record kind"),
    (None, "CC,7", "unknown record kind"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, k, line, "clash", "kept") for i, (k, line, _) in enumerate(CASES)]
    return {r["raw_id"]: r for r in parse_records(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_reasons(parsed):
    assert {i: parsed[i]["reason"] for i in parsed} == {i: why for i, (*_, why) in enumerate(CASES)}


def test_values_and_clashing_columns(parsed):
    assert parsed[3]["drug_id"] == 'a "q" b' and parsed[3]["result"] == -0.001
    assert parsed[4]["structure"] == "C(C)" and parsed[4]["result"] == 0.5
    assert parsed[2]["result"] is None and parsed[0]["note"] == "kept"
    assert parsed[7]["structure"] is None


def test_empty_and_long(spark):
    assert parse_records(spark.createDataFrame([], SCHEMA)).count() == 0
    long_line = '"' + 'x""' * 50_000 + '",' + "(" * 20_000 + "C" + ")" * 20_000 + ",1"
    got = parse_records(spark.createDataFrame([(1, "train_val", long_line, None, None)] * 2, SCHEMA)).collect()
    assert [r["reason"] for r in got] == [None, None]


def test_control_characters_stay(spark):
    got = parse_records(spark.createDataFrame([(1, "train_val", "a\u0001b\u0002c,CC,1", None, None)], SCHEMA)).first()
    assert got["reason"] is None and got["drug_id"] == "a\u0001b\u0002c"
