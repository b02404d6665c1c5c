"""DuckDB statements equivalent to the core queries."""

from __future__ import annotations

FEATURES = [f"feature{i}" for i in range(1, 11)]
METHODS = ("m_boost", "m_forest", "m_knn", "m_linear")
CUT = "[0.05, 0.1]"


def r(expr: str, places: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"round({expr}, {places}) + 0.0"


def clean(col: str) -> str:
    """NaN as null, one zero. Written as text, because isnan() is folded away where a file's statistics lack NaN."""
    return f"CASE WHEN CAST({col} AS VARCHAR) <> 'nan' THEN {col} + 0.0 END"


F = "f AS (SELECT rec_id, " + clean("activity") + " AS activity, feature1, feature2, " + ", ".join(f"{clean(c)} AS {c}" for c in FEATURES[2:]) + " FROM features)"
LONG = "l AS (" + " UNION ALL ".join(f"SELECT rec_id, activity, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM f" for c in FEATURES) + ")"
STATS = """st AS (SELECT feature, count(*) AS n, count(*) - count(x) AS n_missing, 100.0 * (count(*) - count(x)) / count(*) AS missing_pct,
  coalesce(bool_and(x IN (0, 1)), true) AS is_binary, avg(x) AS mean, median(x) AS median, var_pop(x) AS variance,
  quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, min(x) AS low, max(x) AS high FROM l GROUP BY feature),
 md AS (SELECT feature, arg_min(x, (-c, x)) AS mode FROM (SELECT feature, x, count(*) AS c FROM l WHERE x IS NOT NULL GROUP BY feature, x) GROUP BY feature)"""
BASE = f"WITH {F}, {LONG}, {STATS}"


def stat(feature: str, what: str) -> str:
    return f"(SELECT {what} FROM st WHERE feature = '{feature}')"


SQL: dict[str, str] = {}

# ---- records that fail to parse

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_PARSED = rf"""WITH a AS (
  SELECT *, regexp_replace(raw_line, '\r$', '') AS line FROM raw_records),
b AS (SELECT *, regexp_full_match(line, '{_FIELD}(,{_FIELD})*', 's') AS sound FROM a),
c AS (SELECT *, CASE WHEN sound THEN regexp_extract_all(',' || line, ',({_FIELD})', 1, 's') END AS raw_fields FROM b),
d AS (SELECT *, list_transform(raw_fields, lambda v: trim(CASE WHEN starts_with(v, '"') THEN replace(v[2:-2], '""', '"') ELSE v END, ' ')) AS fields FROM c),
e AS (SELECT *, CASE WHEN len(fields) = CASE record_kind WHEN 'train_val' THEN 3 WHEN 'testcase' THEN 2 END THEN fields END AS ok FROM d),
g AS (SELECT *, ok[-1] AS num, ok[-2] AS s, regexp_replace(ok[-2], '\[[^\[\]()]*\]', '', 'g') AS outside FROM e),
h AS (SELECT *, list_transform(string_split(regexp_replace(outside, '[^()]', '', 'g'), ''), lambda v: CASE v WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) AS steps FROM g),
p AS (SELECT *,
  CASE WHEN ok IS NULL THEN true
    WHEN s = '' OR NOT regexp_full_match(s, '[A-Za-z0-9()\[\]=#@+\-/\\.]*') OR regexp_matches(outside, '[\[\]]') THEN true
    WHEN list_sum(steps) <> 0 OR list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))) < 0 THEN true
    WHEN {" OR ".join(f"(len(outside) - len(replace(outside, '{k}', ''))) % 2 = 1" for k in range(10))} THEN true
    WHEN num <> '' AND NOT regexp_full_match(num, '{NUMBER.strip("^$")}') THEN true
    ELSE false END AS failed FROM h)
"""
SQL["p3_found"] = _PARSED + "SELECT raw_id FROM p WHERE failed"
SQL["p3_rejects"] = _PARSED + """SELECT raw_id, file_name, line_no, CASE WHEN raw_line IS NULL THEN 'no line'
  WHEN record_kind IS NULL OR record_kind NOT IN ('train_val', 'testcase') THEN 'unknown record kind'
  WHEN NOT sound THEN CASE WHEN (len(line) - len(replace(line, '"', ''))) % 2 = 1 THEN 'unclosed quote' ELSE 'misplaced quote' END
  WHEN ok IS NULL THEN 'field count ' || len(fields) WHEN s = '' THEN 'empty structure'
  WHEN NOT regexp_full_match(s, '[A-Za-z0-9()\\[\\]=#@+\\-/\\\\.]*') THEN 'invalid character in structure' WHEN regexp_matches(outside, '[\\[\\]]') THEN 'unbalanced square bracket'
  WHEN list_sum(steps) <> 0 OR list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))) < 0 THEN 'unbalanced round bracket'
  WHEN """ + " OR ".join(f"(len(outside) - len(replace(outside, '{k}', ''))) % 2 = 1" for k in range(10)) + """ THEN 'unpaired ring digit' ELSE 'invalid number' END AS reason FROM p WHERE failed"""
SQL["p3_loaded"] = _PARSED + "SELECT raw_id, record_kind, CASE WHEN record_kind = 'train_val' THEN ok[1] END AS drug_id, s AS structure, TRY_CAST(num AS DOUBLE) AS result FROM p WHERE NOT failed"

# ---- preprocessing

SQL["feature_statistics"] = BASE + ", ".join(["SELECT feature, n, n_missing", r("missing_pct") + " AS missing_pct", "is_binary", *(f"{r(c)} AS {c}" for c in ("mean", "median", "mode", "variance", "q1", "q3", "low", "high"))]) + " FROM st LEFT JOIN md USING (feature)"
SQL["duplicate_columns"] = f"WITH {F} " + " UNION ".join(
    f"SELECT '{b}' AS feature FROM f HAVING bool_and(CAST({a} AS DOUBLE) IS NOT DISTINCT FROM CAST({b} AS DOUBLE))" for j, b in enumerate(FEATURES) for a in FEATURES[:j]
)
_KEYS = ", ".join(FEATURES)
_ROW = "{'i': rec_id, 'a': activity}"
_PICK = {
    "first": f"arg_min({_ROW}, rec_id)", "last": f"arg_max({_ROW}, rec_id)", "mean": f"arg_min({_ROW}, rec_id)", "median": f"arg_min({_ROW}, rec_id)",
    "random": f"arg_min({_ROW}, md5('42:' || rec_id))", "min": f"arg_min({_ROW}, (activity IS NULL, activity, rec_id))",
    "max": f"arg_min({_ROW}, (activity IS NULL, -activity, rec_id))",
}
for _keep, _pick in _PICK.items():
    _value = {"mean": "CASE WHEN n > 1 THEN mean ELSE p.a END", "median": "CASE WHEN n > 1 THEN med ELSE p.a END"}.get(_keep, "p.a")
    SQL[f"duplicate_rows_{_keep}"] = f"""WITH {F}, g AS (SELECT {_pick} AS p, count(*) AS n, avg(activity) AS mean, median(activity) AS med FROM f GROUP BY {_KEYS})
SELECT p.i AS rec_id, {r(_value)} AS activity FROM g"""



def _wide(value: str, tables: str, group: str = "rid") -> str:
    """Back from (rid, feature, x) to one column per feature."""
    picks = ", ".join(f"max({value}) FILTER (feature = '{c}') AS {c}" for c in FEATURES)
    return f"SELECT any_value(rec_id) AS rec_id, any_value(activity) AS activity, {picks} FROM {tables} GROUP BY {group}"


_N = F.replace("SELECT rec_id", "SELECT row_number() OVER () AS rid, rec_id", 1)
_NLONG = "l AS (" + " UNION ALL ".join(f"SELECT rid, rec_id, activity, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM f" for c in FEATURES) + ")"
_NBASE = f"WITH {_N}, {_NLONG}, {STATS}, b AS (SELECT feature, NOT is_binary AS treated, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM st)"
_BAD = "bad AS (SELECT feature, any_value(lower) AS lower, any_value(upper) AS upper FROM l JOIN b USING (feature) WHERE treated GROUP BY feature HAVING count(*) FILTER (NOT coalesce(x BETWEEN lower AND upper, false)) > 0)"
_SHOW = ", ".join(["rec_id", r("activity") + " AS activity", "CAST(feature1 AS BIGINT) AS feature1", "CAST(feature2 AS BIGINT) AS feature2", *(f"{r(c)} AS {c}" for c in FEATURES[2:])])
SQL["outlier_counts"] = _NBASE + f" SELECT feature, {r('lower')} AS lower, {r('upper')} AS upper, count(*) FILTER (NOT coalesce(x BETWEEN lower AND upper, false)) AS n_outliers FROM l JOIN b USING (feature) WHERE treated GROUP BY feature, lower, upper"
SQL["variance_curve"] = BASE + " SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (is_binary OR coalesce(variance, 0) > t) AS n_features FROM st, (SELECT round(i * 0.05, 2) AS t FROM range(20) r(i)) GROUP BY t"
for _name, _shift, _scale in (("minmax", "low", "high - low"), ("standard", "mean", "sqrt(variance)"), ("robust", "median", "q3 - q1")):
    _x = f"CASE WHEN is_binary THEN x ELSE (x - {_shift}) / CASE WHEN {_scale} = 0 THEN 1 ELSE {_scale} END END"
    SQL[f"rescaled_{_name}"] = f"{_NBASE}, w AS ({_wide(_x, 'l JOIN st USING (feature)')}) SELECT {_SHOW} FROM w"
SQL["outliers_winsorized"] = f"{_NBASE}, {_BAD}, w AS ({_wide('CASE WHEN x < lower THEN lower WHEN x > upper THEN upper ELSE x END', 'l LEFT JOIN bad USING (feature)')}) SELECT {_SHOW} FROM w"
_INSIDE = "ok AS (SELECT rid, bool_and(coalesce(x BETWEEN lower AND upper, false)) AS inside FROM l JOIN bad USING (feature) GROUP BY rid)"
SQL["outliers_iqr_rows"] = f"{_NBASE}, {_BAD}, {_INSIDE}, w AS ({_wide('x', 'l JOIN ok USING (rid)', group='rid, inside')} HAVING inside) SELECT {_SHOW} FROM w"
SQL["outliers_iqr_null"] = f"{_NBASE}, {_BAD}, {_INSIDE}, w AS ({_wide('CASE WHEN inside OR lower IS NULL THEN x END', 'l JOIN ok USING (rid) LEFT JOIN bad USING (feature)')}) SELECT {_SHOW} FROM w"


# ---- splits


def _digest(*cols: str) -> str:
    return "md5('42:' || " + " || ':' || ".join(cols) + ")"


SQL["random_split"] = f"""WITH a AS (SELECT rec_id, row_number() OVER (ORDER BY {_digest("rec_id")}) AS k, count(*) OVER () AS n FROM train_val)
SELECT rec_id, CASE WHEN k <= ceil(0.2 * n - 1e-9) THEN 'test' ELSE 'train' END AS split FROM a"""
SQL["stratified_split"] = f"""WITH a AS (SELECT rec_id, endpoint, row_number() OVER (PARTITION BY endpoint ORDER BY {_digest("rec_id")}) AS k FROM train_val),
s AS (SELECT endpoint, count(*) AS n FROM train_val GROUP BY endpoint),
t AS (SELECT *, ceil(0.2 * sum(n) OVER () - 1e-9) AS n_test, sum(n) OVER () AS total FROM s),
q AS (SELECT *, n * n_test / total AS share, floor(n * n_test / total) AS low FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY share - low DESC, endpoint NULLS FIRST) AS place, n_test - sum(low) OVER () AS more FROM q)
SELECT rec_id, a.endpoint, CASE WHEN k <= low + CASE WHEN place <= more THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END AS split
FROM a JOIN o ON a.endpoint IS NOT DISTINCT FROM o.endpoint"""


def _fill(order: str, cutoff: str, first: str, second: str) -> str:
    return f"""WITH RECURSIVE k AS (SELECT rec_id, source, coalesce('s' || source, 'r' || rec_id) AS g FROM train_val),
g AS (SELECT g, count(*) AS size, min(rec_id) AS first_id FROM k GROUP BY g),
o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS k, sum(size) OVER () AS n FROM g),
w AS (SELECT 0 AS k, CAST(0 AS HUGEINT) AS total, CAST(NULL AS VARCHAR) AS g, false AS fits
  UNION ALL SELECT o.k, CASE WHEN w.total + o.size <= {cutoff} THEN w.total + o.size ELSE w.total END, o.g, w.total + o.size <= {cutoff} FROM w JOIN o ON o.k = w.k + 1)
SELECT rec_id, source, CASE WHEN fits THEN '{first}' ELSE '{second}' END AS split FROM k JOIN w USING (g)"""


SQL["group_split"] = _fill("size DESC, first_id DESC", "floor(0.8 * n + 1e-9)", "train", "test")
SQL["random_group_split"] = _fill(_digest("first_id"), "floor(0.2 * n + 1e-9)", "test", "train")
_FOLDS = "SELECT rec_id{c}, CAST(repeat AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY repeat{c} ORDER BY {d}) - 1) % 5 AS INTEGER) AS fold FROM test_set, range(5) t(repeat)"
SQL["repeated_folds"] = _FOLDS.format(c="", d=_digest("repeat", "rec_id"))
SQL["repeated_stratified_folds"] = _FOLDS.format(c=", endpoint", d=_digest("repeat", "rec_id"))

# ---- neighbours

_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS y FROM embeddings)"


def _near(name: str, queries: str, fitted: str, k: int, but_self: bool) -> str:
    other = " AND a.id <> b.id" if but_self else ""
    return f"""{name} AS (SELECT * FROM (SELECT a.id AS query, b.id AS other, list_distance(a.x, b.x) AS d, b.y,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank FROM v a JOIN v b ON true WHERE {queries} AND {fitted}{other}) WHERE rank <= {k})"""


SQL["nearest"] = f"WITH {_V}, {_near('n', 'a.id % 50 = 0', 'true', 5, True)} SELECT query, other, {r('d')} AS d, CAST(rank AS INTEGER) AS rank FROM n"
_LRD = """kd AS (SELECT query AS other, max(d) AS k_distance FROM {own} GROUP BY query),
own_lrd AS (SELECT query, 1 / (avg(greatest(d, k_distance)) + 1e-10) AS lrd FROM {own} JOIN kd USING (other) GROUP BY query),
own_lof AS (SELECT n.query AS id, avg(o.lrd) / any_value(q.lrd) AS lof FROM {own} n JOIN own_lrd o ON o.query = n.other JOIN own_lrd q ON q.query = n.query GROUP BY n.query)"""
SQL["outlier_factors"] = f"WITH {_V}, {_near('n', 'true', 'true', 20, True)}, {_LRD.format(own='n')} SELECT id, {r('lof')} AS lof FROM own_lof"
_IN, _OUT = "{0}.id % 50 <> 0", "{0}.id % 50 = 0"
SQL["domain_by_neighbours"] = f"""WITH {_V}, {_near("n", _IN.format("a"), _IN.format("b"), 10, True)}, {_near("q", _OUT.format("a"), _IN.format("b"), 10, False)},
cut AS (SELECT quantile_cont(s, 0.05) AS cut FROM (SELECT 1 / (avg(d) + 1) AS s FROM n GROUP BY query)),
sc AS (SELECT query AS id, 1 / (avg(d) + 1) AS score FROM q GROUP BY query)
SELECT id, {r("score")} AS score, CASE WHEN score - cut > 0 THEN 'in' ELSE 'out' END AS domain FROM sc, cut"""
SQL["domain_by_outlier_factor"] = f"""WITH {_V}, {_near("n", _IN.format("a"), _IN.format("b"), 20, True)}, {_near("q", _OUT.format("a"), _IN.format("b"), 20, False)},
{_LRD.format(own="n")}, q_lrd AS (SELECT query, 1 / (avg(greatest(d, k_distance)) + 1e-10) AS lrd FROM q JOIN kd USING (other) GROUP BY query),
sc AS (SELECT q.query AS id, -avg(o.lrd) / any_value(l.lrd) AS score FROM q JOIN own_lrd o ON o.query = q.other JOIN q_lrd l ON l.query = q.query GROUP BY q.query),
cut AS (SELECT quantile_cont(-lof, 0.05) AS cut FROM own_lof)
SELECT id, {r("score")} AS score, CASE WHEN score - cut > 0 THEN 'in' ELSE 'out' END AS domain FROM sc, cut"""
_Q = f"WITH {_V}, {_near('q', _OUT.format('a'), _IN.format('b'), 5, False)}"
SQL["neighbour_classes"] = _Q + ", c AS (SELECT query, y, count(*) AS n FROM q GROUP BY query, y) SELECT query AS id, arg_min(y, (-n, y)) AS predicted FROM c GROUP BY query"
SQL["neighbour_means"] = _Q + f" SELECT query AS id, {r('avg(y)')} AS predicted FROM q GROUP BY query"
SQL["tanimoto_neighbours"] = f"""WITH {_V}, b AS (SELECT id, list_filter(range(1, 65), lambda i: x[i] > 0.15) AS bits FROM v),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.bits, b.bits)) AS c, len(a.bits) AS na, len(b.bits) AS nb FROM b a JOIN b b ON a.id < b.id WHERE len(a.bits) > 0 AND len(b.bits) > 0)
SELECT a, b, {r("1.0 - c / (na + nb - c)")} AS d FROM p WHERE 1.0 - c / (na + nb - c) <= 0.5 + 1e-12"""

# ---- metrics

_C = "c AS (SELECT rec_id, endpoint, y, (rec_id * 7919 % 1000) / 1000.0 AS p, CASE WHEN (rec_id * 7919 % 1000) / 1000.0 > 0.5 THEN 1 ELSE 0 END AS pr FROM train_val WHERE y IN (0, 1) AND endpoint IS NOT NULL)"
SQL["threshold_metrics"] = f"""WITH {_C}, k AS (SELECT endpoint, count(*) FILTER (y = 1 AND pr = 1) + 0.0::DOUBLE AS tp, count(*) FILTER (y = 0 AND pr = 1) + 0.0::DOUBLE AS fp,
  count(*) FILTER (y = 1 AND pr = 0) + 0.0::DOUBLE AS fn, count(*) FILTER (y = 0 AND pr = 0) + 0.0::DOUBLE AS tn FROM c GROUP BY endpoint)
SELECT endpoint, {r("(tp + tn) / (tp + fp + fn + tn)")} AS accuracy, {r("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END")} AS precision,
  {r("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END")} AS recall, {r("CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END")} AS f1,
  {r("CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END")} AS mcc FROM k"""
SQL["probability_metrics"] = f"""WITH {_C} SELECT endpoint, {r("-avg(CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END)")} AS log_loss,
  {r("avg((p - y) * (p - y))")} AS brier FROM c GROUP BY endpoint"""
_CURVE = f"""WITH {_C}, s AS (SELECT endpoint, p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM c GROUP BY endpoint, p),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY endpoint) AS positives, sum(neg) OVER (PARTITION BY endpoint) AS negatives
  FROM s WINDOW w AS (PARTITION BY endpoint ORDER BY score DESC))"""
SQL["roc_points"] = _CURVE + " SELECT endpoint, CAST(score AS DOUBLE) AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives FROM k"
SQL["ranking_metrics"] = _CURVE + f""" SELECT endpoint,
  {r("CASE WHEN max(positives) > 0 AND max(negatives) > 0 THEN sum(pos * (negatives - fp + neg / 2)) / (max(positives) * max(negatives)) END")} AS roc_auc,
  {r("CASE WHEN max(positives) > 0 THEN sum(pos / positives * tp / (tp + fp)) END")} AS average_precision FROM k GROUP BY endpoint"""
def _digits(expr: str) -> str:
    """Six places below a million, nine digits beyond it, where a relative error is divided by the epsilon only."""
    return f"CASE WHEN abs({expr}) < 1e6 THEN {r(expr)} ELSE CAST(format('{{:.8e}}', {expr}) AS DOUBLE) END"


SQL["regression_metrics"] = f"""WITH v AS (SELECT rec_id, endpoint, {clean("y")} AS y FROM train_val), n AS (SELECT endpoint, y, y * 0.9 + (rec_id % 7) * 0.1 - y AS e FROM v WHERE y IS NOT NULL AND endpoint IS NOT NULL),
m AS (SELECT endpoint, CASE WHEN var_pop(y) > 0 THEN 1 - avg(e * e) / var_pop(y) END AS r2, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
  median(abs(e)) AS median_ae, avg(abs(e) / greatest(abs(y), 2.220446049250313e-16::DOUBLE)) AS mape, max(abs(e)) AS max_error FROM n GROUP BY endpoint)
SELECT endpoint, {", ".join(f"{_digits(c)} AS {c}" for c in ("r2", "mse", "rmse", "mae", "median_ae", "mape", "max_error"))} FROM m"""

# ---- cross-validation reports and comparisons of methods

_PRESENT = "cv_cycle NOT IN ('mean', 'std', 'median') AND CAST({m} AS VARCHAR) <> 'nan'"
_S = "s AS (" + " UNION ALL ".join(f"SELECT endpoint, lower(scoring) AS scoring, cv_cycle, '{m}' AS method, {m} AS value FROM cv_report WHERE {_PRESENT.format(m=m)}" for m in METHODS) + ")"
_B = "endpoint, scoring"
#: Only cycles in which every method of the group has a score: what the paired tests compare.
_SW = f"""{_S.replace("s AS (", "s0 AS (", 1)}, kk AS (SELECT {_B}, count(DISTINCT method) AS k FROM s0 GROUP BY {_B}),
wc AS (SELECT {_B}, cv_cycle FROM s0 JOIN kk USING ({_B}) GROUP BY {_B}, cv_cycle, k HAVING count(DISTINCT method) = k), s AS (SELECT s0.* FROM s0 JOIN wc USING ({_B}, cv_cycle))"""
SQL["cv_long"] = f"WITH {_S} SELECT * FROM s"
_SUM = f"m AS (SELECT {_B}, method, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median FROM s GROUP BY {_B}, method)"
SQL["cv_summary"] = f"WITH {_S}, {_SUM} SELECT {_B}, method, {r('mean')} AS mean, {r('std')} AS std, {r('median')} AS median FROM m"
SQL["cv_wide"] = f"""WITH {_S}, {_SUM}, e AS (SELECT {_B}, cv_cycle, method, value FROM s UNION ALL SELECT {_B}, 'mean', method, mean FROM m
  UNION ALL SELECT {_B}, 'std', method, std FROM m UNION ALL SELECT {_B}, 'median', method, median FROM m)
SELECT {_B}, cv_cycle, """ + ", ".join(f"round(max(value) FILTER (method = '{m}'), 6) + 0.0 AS {m}" for m in METHODS) + f" FROM e GROUP BY {_B}, cv_cycle"
SQL["best_methods"] = f"WITH {_S}, {_SUM} SELECT {_B}, arg_min(method, (-mean, method)) AS method, {r('max(mean)')} AS mean FROM m GROUP BY {_B}"
SQL["variance_homogeneity"] = f"""WITH {_S}, g AS (SELECT {_B}, method, var_samp(value) AS v, median(value) AS med FROM s GROUP BY {_B}, method),
z AS (SELECT {_B}, s.method, abs(value - med) AS z FROM s JOIN g USING ({_B}, method)),
zg AS (SELECT {_B}, method, count(*) AS n, avg(z) AS m, sum(z * z) - count(*) * avg(z) * avg(z) AS within FROM z GROUP BY {_B}, method),
zt AS (SELECT {_B}, avg(z) AS grand, count(*) AS total FROM z GROUP BY {_B})
SELECT {_B}, {r("max(g.v) / nullif(min(g.v), 0)")} AS fold_difference,
  {r("(max(total) - count(*)) * sum(n * (m - grand) * (m - grand)) / nullif((count(*) - 1) * sum(within), 0)")} AS levene FROM zg JOIN zt USING ({_B}) JOIN g USING ({_B}, method) GROUP BY {_B}"""
SQL["residuals"] = f"WITH {_S} SELECT {_B}, cv_cycle, method, value, {r(f'value - avg(value) OVER (PARTITION BY {_B}, method)')} AS centred FROM s"
SQL["residual_histogram"] = f"""WITH {_S}, c AS (SELECT {_B}, value - avg(value) OVER (PARTITION BY {_B}, method) AS x FROM s),
b AS (SELECT *, min(x) OVER (PARTITION BY {_B}) AS low, max(x) OVER (PARTITION BY {_B}) AS high FROM c)
SELECT {_B}, CAST(CASE WHEN high > low THEN least(floor((x - low) / (high - low) * 10), 9) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY ALL"""
_AN = f"""t AS (SELECT {_B}, avg(value) AS g, var_pop(value) * count(*) AS ss, count(DISTINCT method) AS k, count(DISTINCT cv_cycle) AS n FROM s GROUP BY {_B}),
sm AS (SELECT {_B}, var_pop(m) * count(*) AS v FROM (SELECT {_B}, method, avg(value) AS m FROM s GROUP BY {_B}, method) GROUP BY {_B}),
sc AS (SELECT {_B}, var_pop(m) * count(*) AS v FROM (SELECT {_B}, cv_cycle, avg(value) AS m FROM s GROUP BY {_B}, cv_cycle) GROUP BY {_B}),
an AS (SELECT {_B}, k, n, sm.v * n AS ss_m, ss - sm.v * n - sc.v * k AS ss_e FROM t JOIN sm USING ({_B}) JOIN sc USING ({_B}))"""
SQL["anova"] = f"WITH {_SW}, {_AN} SELECT {_B}, {r('(ss_m / (k - 1)) / nullif(ss_e / ((k - 1) * (n - 1)), 0)')} AS f FROM an"
_RK = f"""k AS (SELECT *, rank() OVER (PARTITION BY {_B}, cv_cycle ORDER BY value) + (count(*) OVER (PARTITION BY {_B}, cv_cycle, value) - 1) / 2.0 AS rank,
  count(*) OVER (PARTITION BY {_B}, cv_cycle) AS c, count(*) OVER (PARTITION BY {_B}, cv_cycle, value) AS ties FROM s)"""
SQL["method_ranks"] = f"WITH {_S}, {_RK} SELECT {_B}, cv_cycle, method, value, CAST(rank AS DOUBLE) AS rank, {r('rank / c')} AS pct_rank FROM k"
SQL["mean_pct_ranks"] = f"WITH {_S}, {_RK} SELECT {_B}, method, {r('avg(rank / c)')} AS mean_pct_rank FROM k GROUP BY {_B}, method"
_RS = f"""rs AS (SELECT {_B}, method, CAST(sum(rank) AS DOUBLE) AS r FROM k GROUP BY {_B}, method), rr AS (SELECT {_B}, sum(r * r) AS rr FROM rs GROUP BY {_B}),
z AS (SELECT {_B}, count(DISTINCT method) AS k, count(DISTINCT cv_cycle) AS n, sum(ties * ties - 1) AS tie, CAST(sum(rank * rank) AS DOUBLE) AS a FROM k GROUP BY {_B})"""
SQL["friedman"] = f"WITH {_SW}, {_RK}, {_RS} SELECT {_B}, {r('(12.0 / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / nullif(1 - tie / (n * k * (k * k - 1)), 0)')} AS q FROM z JOIN rr USING ({_B})"
SQL["conover"] = f"""WITH {_SW}, {_RK}, {_RS} SELECT {_B}, a.method AS method_1, b.method AS method_2, {r("abs(a.r - b.r) / nullif(sqrt(2 * (n * z.a - rr) / ((n - 1) * (k - 1))), 0)")} AS t
FROM rs a JOIN rs b USING ({_B}) JOIN z USING ({_B}) JOIN rr USING ({_B}) WHERE a.method < b.method"""
SQL["tukey"] = f"""WITH {_SW}, {_AN}, m AS (SELECT {_B}, method, avg(value) AS mean FROM s GROUP BY {_B}, method)
SELECT {_B}, a.method AS method_1, b.method AS method_2, {r("a.mean - b.mean")} AS mean_diff, {r("sqrt(ss_e / ((k - 1) * (n - 1)) / n)")} AS se
FROM m a JOIN m b USING ({_B}) JOIN an USING ({_B}) WHERE a.method < b.method"""
SQL["box_data"] = f"WITH {_S} SELECT {_B}, method, " + ", ".join(f"{r(f'quantile_cont(value, {q})')} AS {n}" for q, n in ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high"))) + f" FROM s GROUP BY {_B}, method"

# ---- selection, conformal prediction, inference

SQL["anova_scores"] = f"""WITH {F}, {LONG}, c AS (SELECT feature, activity, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM l WHERE x IS NOT NULL AND activity IN (0, 1) GROUP BY feature, activity)
SELECT feature, {r("((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / nullif(sum(w) / (sum(n) - count(*)), 0)")} AS f FROM c GROUP BY feature"""
SQL["regression_scores"] = f"""WITH {F}, {LONG}, c AS (SELECT feature, corr(x, activity) AS r, count(*) AS n FROM l WHERE x IS NOT NULL AND activity IS NOT NULL GROUP BY feature)
SELECT feature, {r("r * r * (n - 2) / nullif(1 - r * r, 0)")} AS f FROM c"""
SQL["conformal_intervals"] = f"""WITH {_S}, e AS (SELECT CAST(cv_cycle AS INTEGER) % 5 AS fold, abs(value - 0.7) AS residual FROM s WHERE method = 'm_knn' AND scoring = 'roc_auc'),
p AS (SELECT endpoint || '/' || scoring AS id, CAST(cv_cycle AS INTEGER) % 5 AS fold, avg(value) AS predicted FROM s WHERE method = 'm_boost' GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM e), v AS (SELECT id, list_sort(list(predicted - residual)) AS lo, list_sort(list(predicted + residual)) AS hi FROM p JOIN e USING (fold) GROUP BY id)
SELECT id, round_even(lo[greatest(1, least(n, CAST(floor(0.1 * (n + 1) + 1e-9) AS BIGINT)))], 3) AS lower, round_even(hi[greatest(1, least(n, CAST(ceil(0.9 * (n + 1) - 1e-9) AS BIGINT)))], 3) AS upper FROM v, n"""
_Y = f"t AS (SELECT rec_id, {clean('y')} AS y FROM test_set)"
SQL["write_back"] = f"WITH {_Y} SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN rec_id / 2.0 ELSE y END AS y FROM t"
SQL["prediction_summary"] = f"""WITH {_Y} SELECT count(*) AS n, {r("avg(y)")} AS mean, {r("stddev_pop(y)")} AS std, {r("avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END)")} AS missing,
{r("quantile_cont(y, 0.1)")} AS q10, {r("quantile_cont(y, 0.5)")} AS q50, {r("quantile_cont(y, 0.9)")} AS q90 FROM t"""
SQL["prediction_extremes"] = f"""WITH {_Y} SELECT * FROM (SELECT rec_id, y, 'top' AS "end" FROM t WHERE y IS NOT NULL ORDER BY y DESC, rec_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT rec_id, y, 'bottom' AS "end" FROM t WHERE y IS NOT NULL ORDER BY y, rec_id LIMIT 3)"""

# ---- steps whose columns depend on the data: those that remain or are treated at sf0.01

_KEPT = [c for c in FEATURES if c != "feature9"]
_SHOW_KEPT = ", ".join(["rec_id", r("activity") + " AS activity", "CAST(feature1 AS BIGINT) AS feature1", "CAST(feature2 AS BIGINT) AS feature2", *(f"{r(c)} AS {c}" for c in _KEPT[2:])])
for _name, _what in (("mean", "mean"), ("median", "median"), ("mode", "mode")):
    _fill = f"coalesce(x, CASE WHEN is_binary THEN mode ELSE {_what} END)"
    SQL[f"missing_{_name}"] = f"{_NBASE}, w AS ({_wide(_fill, 'l JOIN st USING (feature) JOIN md USING (feature)')}) SELECT {_SHOW_KEPT} FROM w"
SQL["low_variance"] = f"WITH {F} SELECT rec_id, activity, feature1, feature2, feature5, feature6, feature7, feature8, feature9, feature10 FROM f"
_EMPTIED = "e AS (SELECT rid, l.feature, rec_id, activity, CASE WHEN lower IS NULL OR x BETWEEN lower AND upper THEN x END AS x FROM l LEFT JOIN bad USING (feature))"
_EST = """est AS (SELECT feature, coalesce(bool_and(x IN (0, 1)), true) AS is_binary, avg(x) AS mean FROM e GROUP BY feature),
emd AS (SELECT feature, arg_min(x, (-c, x)) AS mode FROM (SELECT feature, x, count(*) AS c FROM e WHERE x IS NOT NULL GROUP BY feature, x) GROUP BY feature)"""
_fill = "coalesce(x, CASE WHEN is_binary THEN mode ELSE mean END)"
SQL["outliers_imputed"] = f"{_NBASE}, {_BAD}, {_EMPTIED}, {_EST}, w AS ({_wide(_fill, 'e JOIN est USING (feature) JOIN emd USING (feature)')}) SELECT {_SHOW} FROM w"
_TREATED = FEATURES[2:]
for _name, _edges in (("quantile", [f"quantile_cont(x, {i} / 3.0)" for i in range(4)]), ("uniform", [f"min(x) + (max(x) - min(x)) * {i} / 3" for i in range(4)])):
    _cols = ", ".join(f"{e} AS e{i}" for i, e in enumerate(_edges))
    _bin = "CASE WHEN e1 - e0 > 1e-8 AND e3 - e1 > 1e-8 AND x >= e1 THEN 1 ELSE 0 END + CASE WHEN e2 - e1 > 1e-8 AND e3 - e2 > 1e-8 AND x >= e2 THEN 1 ELSE 0 END"
    _picks = ", ".join(f"CAST(max({_bin}) FILTER (feature = '{c}') AS DOUBLE) AS Kbin{i}" for i, c in enumerate(_TREATED, 1))
    SQL[f"binned_{_name}"] = f"{_NBASE}, ed AS (SELECT feature, {_cols} FROM l GROUP BY feature) SELECT any_value(rec_id) AS rec_id, {_picks} FROM l JOIN ed USING (feature) GROUP BY rid"

# ---- models of closed form, groups, plots

_ACT = "a AS (SELECT rec_id, activity, feature3 AS x FROM f WHERE activity IS NOT NULL)"
SQL["dummy_predictions"] = f"WITH {F}, {_ACT} SELECT rec_id, {r('(SELECT avg(activity) FROM a)')} AS predicted FROM a"
_FIT = f"WITH {F}, {_ACT}, b AS (SELECT * FROM a WHERE x IS NOT NULL), m AS (SELECT avg(x) AS mx, avg(activity) AS my, covar_pop(x, activity) AS sxy, var_pop(x) AS sxx, count(*) AS n FROM b)"
SQL["linear_predictions"] = _FIT + f" SELECT rec_id, {r('my + sxy / sxx * (x - mx)', 5)} AS predicted FROM b, m"
SQL["ridge_predictions"] = _FIT + f" SELECT rec_id, {r('my + n * sxy / (n * sxx + 1.0) * (x - mx)', 5)} AS predicted FROM b, m"
SQL["group_activity"] = f"WITH t AS (SELECT source, {clean('y')} AS y FROM train_val WHERE source IS NOT NULL) SELECT source AS \"group\", count(*) AS n, {r('median(y)')} AS activity FROM t GROUP BY source"
SQL["shared_compounds"] = "SELECT drug_id FROM train_val INTERSECT SELECT drug_id FROM test_set"
SQL["split_checks"] = "SELECT count(*) AS n_rows, count(DISTINCT source) + count(*) FILTER (source IS NULL) AS n_groups, 0 AS n_unplaced, 0 AS n_parted FROM train_val"
SQL["probability_plot"] = f"""WITH {_S}, c AS (SELECT {_B}, method, cv_cycle, value - avg(value) OVER (PARTITION BY {_B}, method) AS x FROM s)
SELECT {_B}, CAST(row_number() OVER (PARTITION BY {_B} ORDER BY x, method, cv_cycle) AS INTEGER) AS place, {r("x")} AS value FROM c"""
SQL["stratified_group_folds"] = """WITH k AS (SELECT rec_id, source, endpoint, coalesce('s' || source, 'r' || rec_id) AS g, coalesce(endpoint, '') AS c FROM train_val),
n AS (SELECT g, c, count(*) AS n, min(rec_id) AS f FROM k GROUP BY g, c), t AS (SELECT g, sum(n) AS n, min(f) AS f, arg_min(c, (-n, c)) AS stratum FROM n GROUP BY g),
o AS (SELECT g, (row_number() OVER (PARTITION BY stratum ORDER BY n DESC, f) - 1) % 10 AS turn FROM t)
SELECT rec_id, source, endpoint, CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INTEGER) AS fold FROM k JOIN o USING (g)"""
_WIDTHS = ", ".join(str(2.0**k) for k in range(-20, 11))
SQL["domain_gamma"] = f"""WITH {_V}, e AS (SELECT id, unnest(x) AS v, unnest(range(1, 65)) AS i FROM v), sd AS (SELECT i, stddev_samp(v) AS s FROM e GROUP BY i),
z AS (SELECT id, list(v / CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY i) AS x FROM e JOIN sd USING (i) GROUP BY id),
d AS (SELECT list_distance(a.x, b.x) AS d FROM z a, z b), g AS (SELECT unnest([{_WIDTHS}]::DOUBLE[]) AS gamma),
w AS (SELECT gamma, var_pop(exp(-gamma * d)) AS spread FROM d, g GROUP BY gamma)
SELECT arg_min(gamma, (-round(spread, 12), gamma)) AS gamma FROM w"""
