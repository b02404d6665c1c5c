"""Comparison of methods over cross-validation scores.

Reports are wide (`scoring`, `cv_cycle`, one column per method); cycles are numbers as text plus `mean`, `std` and
`median`. Everything here works on the long form (*by, `cv_cycle`, `method`, `value`) of the numbered cycles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.functions.special import chi2_p, f_p, probit, range_p, range_quantile, t_p
from lodewright.operators.running import exact_quantiles

SUMMARY = ("mean", "std", "median")
#: Scores where less is better: fixed values.
MINIMISED = ("max_error", "mse", "rmse", "mae", "median_absolute_error", "mape", "log_loss", "brier", "neg_log_loss")


def long_scores(report: DataFrame, methods: Sequence[str], by: Sequence[str] = ("scoring",), scoring: Sequence[str] | None = None) -> DataFrame:
    """Numbered cycles in long form; names of scores are lower-cased and may be restricted.

    Every score that is neither null nor NaN is kept; tests that compare whole cycles take `whole_cycles` of them.
    """
    rows = report.withColumn("scoring", F.lower("scoring")).where(~F.col("cv_cycle").isin(*SUMMARY))
    if scoring is not None:
        rows = rows.where(F.col("scoring").isin(*(s.lower() for s in scoring)))
    scores = rows.select(*by, "cv_cycle", *methods).unpivot([*by, "cv_cycle"], list(methods), "method", "value")
    return scores.where(F.col("value").isNotNull() & ~F.isnan("value"))


def whole_cycles(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """The scores of cycles in which every method that has scores in the group has one."""
    methods = scores.groupBy(*by).agg(F.count_distinct("method").alias("__k"))
    whole = scores.groupBy(*by, "cv_cycle").agg(F.count_distinct("method").alias("__n")).join(methods, list(by))
    return scores.join(whole.where("__n = __k").select(*by, "cv_cycle"), [*by, "cv_cycle"], "left_semi")


def summary_rows(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, `method`, `mean`, `std`, `median`): population deviation."""
    return scores.groupBy(*by, "method").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", F.lit(0.5)).alias("median"))


def cross_validation_report(scores: DataFrame, by: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """The wide report with its summary cycles, from long scores."""
    stats = summary_rows(scores, by).unpivot([*by, "method"], list(SUMMARY), "cv_cycle", "value")
    every = scores.select(*by, "cv_cycle", "method", "value").unionByName(stats)
    return every.groupBy(*by, "cv_cycle").pivot("method", list(methods)).agg(F.first("value"))


def best_method(scores: DataFrame, by: Sequence[str], higher: bool = True) -> DataFrame:
    """(*by, `method`, `mean`): the method of best mean, the first name on a tie."""
    means = scores.groupBy(*by, "method").agg(F.avg("value").alias("mean"))
    order = F.struct(-F.col("mean") if higher else F.col("mean"), F.col("method"))
    return means.groupBy(*by).agg(F.min_by(F.struct("method", "mean"), order).alias("m")).select(*by, "m.method", "m.mean")


def centred(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values less the mean of their method: the residuals of the normality check."""
    return scores.withColumn("centred", F.col("value") - F.avg("value").over(Window.partitionBy(*by, "method")))


def histogram(scores: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """(*by, `bin`, `n`) of the centred values, in equal widths between the extremes."""
    every = Window.partitionBy(*by)
    marked = centred(scores, by).withColumns({"low": F.min("centred").over(every), "high": F.max("centred").over(every)})
    place = F.floor((F.col("centred") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    return marked.groupBy(*by, F.when(F.col("high") > F.col("low"), F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


def variance_homogeneity(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, `fold_difference`, `levene`, `p_value`): ratio of sample variances, and Levene's statistic about medians."""
    by_method = scores.groupBy(*by, "method").agg(F.var_samp("value").alias("v"), F.percentile("value", F.lit(0.5)).alias("med"))
    ratio = by_method.groupBy(*by).agg(F.try_divide(F.max("v"), F.min("v")).alias("fold_difference"))
    z = scores.join(by_method.select(*by, "method", "med"), [*by, "method"]).withColumn("z", F.abs(F.col("value") - F.col("med")))
    groups = z.groupBy(*by, "method").agg(F.count("z").alias("n"), F.avg("z").alias("m"), (F.var_pop("z") * F.count("z")).alias("within"))
    total = groups.groupBy(*by).agg(F.sum("n").alias("total"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum("within").alias("within"))
    between = groups.join(total.select(*by, "grand"), list(by)).groupBy(*by).agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("between"))
    w = F.try_divide((F.col("total") - F.col("k")) * F.col("between"), (F.col("k") - 1) * F.col("within"))
    out = total.join(between, list(by)).join(ratio, list(by)).withColumn("levene", w)
    return out.select(*by, "fold_difference", "levene", f_p(F.col("levene"), F.col("k") - 1, F.col("total") - F.col("k")).alias("p_value"))


def _anova_parts(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of squares of the repeated-measures design: cycles are the subjects, and only whole ones count."""
    keys, scores = list(by), whole_cycles(scores, by)
    total = scores.groupBy(*by).agg(F.avg("value").alias("g"), (F.var_pop("value") * F.count("value")).alias("ss"), F.count_distinct("method").alias("k"), F.count_distinct("cv_cycle").alias("n"))
    of = lambda c: scores.groupBy(*by, c).agg(F.avg("value").alias("m"))
    spread = lambda c, name: of(c).groupBy(*by).agg((F.var_pop("m") * F.count("m")).alias(name))
    parts = total.join(spread("method", "ss_methods"), keys).join(spread("cv_cycle", "ss_cycles"), keys)
    ss_m, ss_c = F.col("ss_methods") * F.col("n"), F.col("ss_cycles") * F.col("k")
    return parts.select(*by, "k", "n", ss_m.alias("ss_methods"), ss_c.alias("ss_cycles"), (F.col("ss") - ss_m - ss_c).alias("ss_error"))


def repeated_measures_anova(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, `f`, `p_value`)."""
    d1, d2 = F.col("k") - 1, (F.col("k") - 1) * (F.col("n") - 1)
    f = F.try_divide(F.col("ss_methods") / d1, F.col("ss_error") / d2)
    return _anova_parts(scores, by).withColumn("f", f).select(*by, "f", f_p(F.col("f"), d1, d2).alias("p_value"))


def ranks(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long scores with `rank` (average on ties) and `pct_rank` within each cycle."""
    cycle = Window.partitionBy(*by, "cv_cycle")
    tied = Window.partitionBy(*by, "cv_cycle", "value")
    rank = F.rank().over(cycle.orderBy("value")) + (F.count("*").over(tied) - 1) / 2
    return scores.withColumn("rank", rank).withColumn("pct_rank", F.col("rank") / F.count("*").over(cycle)).withColumn("ties", F.count("*").over(tied))


def friedman(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, `q`, `p_value`), corrected for ties."""
    keys = list(by)
    r = ranks(whole_cycles(scores, by), by)
    size = r.groupBy(*by).agg(F.count_distinct("method").alias("k"), F.count_distinct("cv_cycle").alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tie"))
    sums = r.groupBy(*by, "method").agg(F.sum("rank").alias("r")).groupBy(*by).agg(F.sum(F.col("r") * F.col("r")).alias("rr"))
    k, n = F.col("k"), F.col("n")
    raw = 12.0 / (n * k * (k + 1)) * F.col("rr") - 3 * n * (k + 1)
    correction = 1 - F.col("tie") / (n * k * (k * k - 1))
    return size.join(sums, keys).withColumn("q", F.try_divide(raw, correction)).select(*by, "q", chi2_p(F.col("q"), k - 1).alias("p_value"))


def pairs_of(means: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of one method beside those of each later one: as many as there are pairs of methods."""
    a = means.select(*by, *(F.col(c).alias(f"{c}_1") for c in means.columns if c not in by))
    b = means.select(*by, *(F.col(c).alias(f"{c}_2") for c in means.columns if c not in by))
    return a.join(b, list(by)).where("method_1 < method_2")


def conover(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, `method_1`, `method_2`, `t`, `p_value`, `p_holm`): Conover's comparisons after a Friedman test."""
    keys = list(by)
    r = ranks(whole_cycles(scores, by), by)
    size = r.groupBy(*by).agg(F.count_distinct("method").alias("k"), F.count_distinct("cv_cycle").alias("n"), F.sum(F.col("rank") * F.col("rank")).alias("a"))
    sums = r.groupBy(*by, "method").agg(F.sum("rank").alias("r"))
    rr = sums.groupBy(*by).agg(F.sum(F.col("r") * F.col("r")).alias("rr"))
    k, n = F.col("k"), F.col("n")
    spread = 2 * (n * F.col("a") - F.col("rr")) / ((n - 1) * (k - 1))
    pairs = pairs_of(sums, by).join(size, keys).join(rr, keys)
    pairs = pairs.withColumn("t", F.try_divide(F.abs(F.col("r_1") - F.col("r_2")), F.sqrt(spread)))
    return holm(pairs.select(*by, "method_1", "method_2", "t", t_p(F.col("t"), (n - 1) * (k - 1)).alias("p_value")), by)


def holm(pairs: DataFrame, by: Sequence[str], p: str = "p_value") -> DataFrame:
    """Adds `p_holm`: step-down adjusted p-values; `pairs` are pairs of methods, so windows are small."""
    order = Window.partitionBy(*by).orderBy(F.col(p))
    m = F.count("*").over(Window.partitionBy(*by))
    stepped = pairs.withColumn("__s", F.col(p) * (m - F.row_number().over(order) + 1))
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def mean_pct_ranks(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return ranks(scores, by).groupBy(*by, "method").agg(F.avg("pct_rank").alias("mean_pct_rank"))


def tukey(scores: DataFrame, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(*by, `method_1`, `method_2`, `mean_diff`, `se`, `q`, `p_value`, `lower`, `upper`): on the error of the
    repeated-measures ANOVA, with simultaneous intervals of the differences at level 1 - alpha."""
    keys = list(by)
    means = whole_cycles(scores, by).groupBy(*by, "method").agg(F.avg("value").alias("mean"))
    df = (F.col("k") - 1) * (F.col("n") - 1)
    pairs = pairs_of(means, by).join(_anova_parts(scores, by), keys)
    se = F.sqrt(F.col("ss_error") / df / F.col("n"))
    out = pairs.withColumn("mean_diff", F.col("mean_1") - F.col("mean_2")).withColumn("se", se).withColumn("q", F.try_divide(F.abs("mean_diff"), F.col("se")))
    half = range_quantile(F.lit(alpha), F.col("k"), df) * F.col("se")
    return out.select(
        *by, "method_1", "method_2", "mean_diff", "se", "q", range_p(F.col("q"), F.col("k"), df).alias("p_value"), (F.col("mean_diff") - half).alias("lower"), (F.col("mean_diff") + half).alias("upper"),
    )


def probability_plot(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, `place`, `quantile`, `value`): centred values in order beside the normal quantiles of their expected places
    (Filliben's medians of the order statistics)."""
    every, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("centred", "method", "cv_cycle")
    ranked = centred(scores, by).withColumns({"place": F.row_number().over(order), "n": F.count("*").over(every)})
    edge = F.pow(F.lit(0.5), 1.0 / F.col("n"))
    p = F.when(F.col("place") == F.col("n"), edge).when(F.col("place") == 1, 1 - edge).otherwise((F.col("place") - 0.3175) / (F.col("n") + 0.365))
    return ranked.select(*by, "place", probit(p).alias("quantile"), F.col("centred").alias("value"))


def group_activity(df: DataFrame, group_col: str, activity_col: str, how: str = "median") -> DataFrame:
    """(`group`, `n`, `activity`): the median or mean activity of each group; rows without a group are left out, missing
    activities do not count."""
    if how not in ("median", "mean"):
        raise ValueError("how must be median or mean")
    rows = df.where(F.col(group_col).isNotNull()).select(F.col(group_col).alias("group"), F.col(activity_col).cast("double").alias("x"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.avg("x").alias("activity"))
    if how == "mean":
        return sizes
    middle = exact_quantiles(rows, ["group"], [0.5]).select("group", F.col("q")[0].alias("activity"))
    return sizes.drop("activity").join(middle, "group", "left").select("group", "n", "activity")


def common_values(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct combinations of values that both tables hold, missing ones being equal; none where the tables are apart."""
    return a.select(*cols).intersect(b.select(*cols))


def plot_label(name: Column) -> Column:
    """A score's name as an axis shows it: words apart, with a capital; well-known abbreviations in capitals."""
    text = F.replace(F.regexp_replace(name, "^neg_", ""), F.lit("_"), F.lit(" "))
    short = F.upper(text)
    return F.when(short.isin("MSE", "RMSE", "MAE", "MAPE", "MCC", "F1", "R2"), short).when(short == "ROC AUC", "ROC AUC").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))


def stars(p: Column) -> Column:
    """Marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def box_data(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, `method`, `low`, `q1`, `median`, `q3`, `high`): what a box plot draws."""
    q = F.percentile("value", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return scores.groupBy(*by, "method").agg(q.alias("q")).select(*by, "method", *(F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))))


def analysis(scores: DataFrame, by: Sequence[str], method: str = "all") -> dict[str, DataFrame]:
    """Tests by name: `parametric`, `non-parametric` or `all`; a single method leaves nothing to compare."""
    if method not in ("parametric", "non-parametric", "all"):
        raise ValueError("method must be parametric, non-parametric or all")
    if scores.select("method").distinct().limit(2).count() < 2:
        return {}
    out = {"homogeneity": variance_homogeneity(scores, by)}
    if method != "non-parametric":
        out |= {"anova": repeated_measures_anova(scores, by), "tukey": tukey(scores, by)}
    if method != "parametric":
        out |= {"friedman": friedman(scores, by), "conover": conover(scores, by)}
    return out
