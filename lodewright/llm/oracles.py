"""DuckDB statements equivalent to the training-data queries, where SQL can say them on whole tables.

p6_clusters and what p5, p7 and p9 choose freely are tested against brute force or by invariants instead.
"""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))
_DASHES = "".join(chr(c) for c in [*range(0x2010, 0x2016), 0x2212])


def clean(col: str) -> str:
    """Clean form; of NFKC only the full-width forms, which are what the tables hold."""
    plain = f"translate({col}, '{_WIDE}{_DASHES}', '{_PLAIN.replace(chr(39), chr(39) * 2)}{'-' * len(_DASHES)}')"
    kept = rf"regexp_replace(lower({plain}), '[^a-z0-9()\[\]=#@+\-/\\.]', '', 'g')"
    return f"nullif(array_to_string(list_sort(list_filter(string_split({kept}, '.'), lambda v: v <> '')), '.'), '')"


def value(col: str) -> str:
    return f"CASE WHEN CAST({col} AS VARCHAR) <> 'nan' THEN {col} + 0.0 END"


_COPIES = f"""WITH r AS (SELECT rec_id, 'train_val' AS t, {clean("drug")} AS s, endpoint AS e, {value("y")} AS v FROM train_val
  UNION ALL SELECT rec_id, 'testcase', {clean("smiles")}, NULL, {value("pchembl")} FROM testcase)"""
_PLAN = f"""WITH n AS (SELECT endpoint, count(*) AS n FROM train_val WHERE {value("y")} IS NOT NULL GROUP BY endpoint),
b AS (SELECT y_bands.*, floor(sample_pct * coalesce(n, 0) / 100) AS size FROM y_bands LEFT JOIN assay_endpoints USING (endpoint) LEFT JOIN n USING (endpoint)),
c AS (SELECT band_id, count(t.rec_id) AS n_rows FROM b LEFT JOIN (SELECT rec_id, endpoint, {value("y")} AS v FROM train_val) t ON t.endpoint = b.endpoint AND v >= y_from AND v < y_below GROUP BY band_id)"""
_TOKENS = r"len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f\v]+'))"

#: A text at most 3 edits away contains one of four parts somewhere; the parts only spare the distances of other pairs.
_PARTS = " OR ".join(f"contains(ts.s, substr(es.s, 1 + {i} * len(es.s) // 4, {i + 1} * len(es.s) // 4 - {i} * len(es.s) // 4))" for i in range(4))

#: The same for 8 edits: one of nine parts.
_NINTHS = " OR ".join(f"contains(b.s, substr(a.s, 1 + {i} * len(a.s) // 9, {i + 1} * len(a.s) // 9 - {i} * len(a.s) // 9))" for i in range(9))
_LINKED = f"""WITH t AS (SELECT rec_id, {clean("drug")} AS s FROM train_val WHERE split_name = 'train'),
e AS (SELECT rec_id, {clean("drug")} AS s, 'valid' AS part, source FROM train_val WHERE split_name = 'valid'
  UNION ALL SELECT rec_id, {clean("drug")}, 'test_set', source FROM test_set UNION ALL SELECT rec_id, {clean("smiles")}, 'testcase', source FROM testcase),
ts AS (SELECT DISTINCT s FROM t WHERE s IS NOT NULL), es AS (SELECT DISTINCT s FROM e WHERE s IS NOT NULL),
p AS (SELECT ts.s AS a, es.s AS b FROM ts JOIN es ON abs(len(ts.s) - len(es.s)) <= 3 AND ({_PARTS}) WHERE levenshtein(ts.s, es.s) <= 3)"""

SQL: dict[str, str] = {
    "p1_found": _COPIES + ", g AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY t, s, e, v) AS first_rec_id FROM r WHERE s IS NOT NULL) SELECT first_rec_id, rec_id FROM g WHERE rec_id <> first_rec_id",
    "p1_collapsed": _COPIES + " SELECT min(rec_id) AS first_rec_id, count(*) AS n_copies FROM r WHERE s IS NOT NULL GROUP BY t, s, e, v",
    "p2_found": _PLAN + " SELECT band_id FROM b JOIN c USING (band_id) WHERE n_rows < greatest(min_rows, ceil(target_pct * size / 100))",
    "p2_report": _PLAN + """ SELECT band_id, endpoint, n_rows, CAST(greatest(min_rows, ceil(target_pct * size / 100)) AS BIGINT) AS wanted,
  CAST(least(n_rows, greatest(min_rows, ceil(target_pct * size / 100))) AS BIGINT) AS n_drawn,
  CAST(greatest(0, greatest(min_rows, ceil(target_pct * size / 100)) - n_rows) AS BIGINT) AS shortfall FROM b JOIN c USING (band_id)""",
    "p4_found": _LINKED + " SELECT least(t.rec_id, e.rec_id) AS rec_id_a, greatest(t.rec_id, e.rec_id) AS rec_id_b FROM p JOIN t ON t.s = a JOIN e ON e.s = b",
    "p4_report": _LINKED + """, c AS (SELECT e.rec_id, any_value(part) AS part, any_value(source) AS source, count(*) AS n FROM p JOIN t ON t.s = a JOIN e ON e.s = b GROUP BY e.rec_id)
SELECT part, source, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_pairs FROM c GROUP BY part, source""",
    "p5_found": f"""WITH RECURSIVE n AS (SELECT rec_id, 'c' || {clean("drug")} AS k FROM train_val
  UNION ALL SELECT rec_id, 's' || regexp_replace(upper(study_id), '[^A-Z0-9]', '', 'g') FROM train_val),
h AS (SELECT k, min(rec_id) AS head FROM n WHERE k IS NOT NULL GROUP BY k),
e AS (SELECT DISTINCT rec_id AS a, head AS b FROM n JOIN h USING (k) WHERE rec_id <> head), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(id, root) USING KEY (id) AS (SELECT rec_id, rec_id FROM train_val
  UNION SELECT g.a, min(cc.root) FROM cc JOIN g ON g.b = cc.id JOIN recurring.cc AS r ON r.id = g.a WHERE cc.root < r.root GROUP BY g.a)
SELECT root AS group_rec_id, id AS rec_id FROM cc WHERE root IN (SELECT root FROM cc GROUP BY root HAVING count(*) > 1)""",
    "p6_found": f"""WITH RECURSIVE n AS (SELECT rec_id, {clean("drug")} AS s FROM train_val UNION ALL SELECT rec_id, {clean("smiles")} FROM testcase),
t AS (SELECT s, min(rec_id) AS id FROM n WHERE s IS NOT NULL GROUP BY s),
h AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id < b.id AND abs(len(a.s) - len(b.s)) <= 8 AND ({_NINTHS}) WHERE levenshtein(a.s, b.s) <= 8),
g AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
cc(id, root) USING KEY (id) AS (SELECT id, id FROM t
  UNION SELECT g.a, min(cc.root) FROM cc JOIN g ON g.b = cc.id JOIN recurring.cc AS r ON r.id = g.a WHERE cc.root < r.root GROUP BY g.a),
m AS (SELECT root, rec_id FROM n JOIN t USING (s) JOIN cc ON cc.id = t.id)
SELECT root AS cluster_rec_id, rec_id FROM m WHERE root IN (SELECT root FROM m GROUP BY root HAVING count(*) > 1)""",
    "p7_found": f"SELECT spec_id, doc_id FROM documents, container_specs WHERE {_TOKENS} > capacity_tokens",
    "p8_found": r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS ws FROM eval_items),
r AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 11], ' ') AS run FROM w, unnest(range(1, len(ws) - 10)) t(i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
x AS (SELECT doc_id, array_to_string(ws[i:i + 11], ' ') AS run FROM d, unnest(range(1, len(ws) - 10)) t(i))
SELECT DISTINCT item_id, doc_id FROM r JOIN x USING (run)""",
    "p9_found": r"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws, len(regexp_extract_all(text, '[.!?]+(?:[ \t\r\n\f\v]|\z)')) AS s
  FROM documents WHERE lang IN ('markdown', 'text')),
d AS (SELECT doc_id, len(ws) + 0.0::DOUBLE AS w, len(array_to_string(ws, '')) AS l, greatest(1, s) AS s FROM c)
SELECT doc_id FROM d WHERE w >= 50 AND 4.71::DOUBLE * l / w + 0.5::DOUBLE * w / s - 21.43::DOUBLE >= 18.0""",
}
