"""Queries of the core library over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.functions import chem, standardise
from lodewright.operators import binning, conformal, duplicates, inference, metrics, missing, models, neighbours, outliers, preprocess, profile, scaling, selection, splits, statistics, validation, variance, workflow
from lodewright.session import Scratch, table
from lodewright.sources import rejects

METHODS = ("m_boost", "m_forest", "m_knn", "m_linear")
BY = ("endpoint", "scoring")


def rounded(col: str | Column, places: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(col, places) + F.lit(0.0)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in cols})


# ---- records that fail to parse


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_records(table(spark, d, "raw_records")).where("reason is not null").select("raw_id")


def p3_rejects(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_records(table(spark, d, "raw_records")).where("reason is not null").select("raw_id", "file_name", "line_no", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_records(table(spark, d, "raw_records")).where("reason is null").select("raw_id", "record_kind", "drug_id", "structure", "result")


# ---- preprocessing


def _features(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_as_null(table(spark, d, "features"))


def _feature_names(df: DataFrame) -> list[str]:
    return profile.Roles().features(df)


def feature_statistics(spark: SparkSession, d: str) -> DataFrame:
    df = _features(spark, d)
    numbers = ("missing_pct", "mean", "median", "mode", "variance", "q1", "q3", "low", "high")
    return _rounded(profile.feature_stats(df, _feature_names(df)), *numbers)


def duplicate_columns(spark: SparkSession, d: str) -> DataFrame:
    df = _features(spark, d)
    return spark.createDataFrame([(c,) for c in duplicates.duplicate_columns(df, _feature_names(df), "rec_id")], "feature string")


def _duplicate_rows(keep: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = _features(spark, d)
        out = duplicates.duplicate_rows(df, _feature_names(df), keep=keep)
        return out.select("rec_id", rounded("activity").alias("activity"))

    return query


def _missing(strategy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, "features")
        out = missing.MissingHandler(strategy=strategy).fit(df).transform(df)
        return _rounded(out, *(c for c in out.columns if c not in ("rec_id", "feature1", "feature2")))

    return query


def low_variance(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "features")
    return variance.LowVarianceHandler().fit(df).transform(_features(spark, d))


def variance_curve(spark: SparkSession, d: str) -> DataFrame:
    df = _features(spark, d)
    return variance.variance_curve(df, _feature_names(df))


def outlier_counts(spark: SparkSession, d: str) -> DataFrame:
    df = _features(spark, d)
    return _rounded(outliers.outlier_counts(df, _feature_names(df)), "lower", "upper")


def _univariate(method: str, **more):
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, "features")
        out = outliers.UnivariateOutliersHandler(method, **more).fit(df).transform(df)
        return _rounded(out, "activity", *(c for c in out.columns if c.startswith("feature") and c not in ("feature1", "feature2")))

    return query


def _binned(strategy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = _features(spark, d)
        out = binning.KBinHandler(strategy=strategy).fit(df).transform(df)
        return out.select("rec_id", *(c for c in out.columns if c.startswith("Kbin")))

    return query


def _rescaled(method: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = _features(spark, d)
        out = scaling.Rescaler(method).fit(df).transform(df)
        return _rounded(out, "activity", *(f"feature{i}" for i in range(3, 11)))

    return query


# ---- splits


def random_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.random_split(table(spark, d, "train_val").select("rec_id"), "rec_id")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(table(spark, d, "train_val").select("rec_id", "endpoint"), "rec_id", "endpoint")


def group_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "train_val").select("rec_id", "source")
    return splits.group_split(rows, "rec_id", "source")


def random_group_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "train_val").select("rec_id", "source")
    return splits.group_split(rows, "rec_id", "source", seed=42)


def repeated_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.repeated_folds(table(spark, d, "test_set").select("rec_id"), "rec_id")


def repeated_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.repeated_folds(table(spark, d, "test_set").select("rec_id", "endpoint"), "rec_id", class_col="endpoint")


def stratified_group_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "train_val").select("rec_id", "source", "endpoint")
    return splits.stratified_group_folds(rows, "rec_id", "source", "endpoint")


# ---- neighbours


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return neighbours.knn(rows.where("id % 50 = 0"), rows, 5, exclude_self=True).select("query", "other", rounded("d").alias("d"), "rank")


def outlier_factors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(neighbours.local_outlier_factor(_vectors(spark, d)), "lof")


def domain_by_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return _rounded(neighbours.knn_domain(rows.where("id % 50 <> 0"), rows.where("id % 50 = 0")), "score")


def domain_by_outlier_factor(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return _rounded(neighbours.lof_domain(rows.where("id % 50 <> 0"), rows.where("id % 50 = 0")), "score")


def neighbour_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return neighbours.vote(rows.where("id % 50 = 0"), rows.where("id % 50 <> 0"), "y")


def neighbour_means(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return _rounded(neighbours.vote(rows.where("id % 50 = 0"), rows.where("id % 50 <> 0"), "y", classify=False), "predicted")


def tanimoto_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Bits are the places of the components above one standard deviation."""
    bits = F.filter(F.transform("x", lambda v, i: F.when(v > 0.15, i)), lambda v: v.isNotNull())
    rows = _vectors(spark, d).select("id", bits.alias("bits"))
    return _rounded(neighbours.tanimoto_links(rows, 0.5), "d")


# ---- metrics


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """Results of 0 and 1 with made-up probabilities that depend on the id."""
    rows = table(spark, d, "train_val").where("y in (0.0, 1.0) and endpoint is not null")
    p = F.pmod(F.col("rec_id") * 7919, F.lit(1000)) / F.lit(1000.0)
    return rows.select("rec_id", "endpoint", "y", p.alias("p")).withColumn("predicted", F.when(F.col("p") > 0.5, 1.0).otherwise(0.0))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "train_val").where("not isnan(y) and y is not null and endpoint is not null")
    return rows.select("rec_id", "endpoint", "y", (F.col("y") * 0.9 + F.pmod("rec_id", F.lit(7)) * 0.1).alias("predicted"))


def threshold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.threshold_metrics(_classes(spark, d), ["endpoint"], "y", "predicted"), "accuracy", "precision", "recall", "f1", "mcc")


def probability_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.probability_metrics(_classes(spark, d), ["endpoint"], "y", "p"), "log_loss", "brier")


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.ranking_metrics(_classes(spark, d), ["endpoint"], "y", "p"), "roc_auc", "average_precision")


def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return metrics.curve_points(_classes(spark, d), ["endpoint"], "y", "p").select("endpoint", "score", "tp", "fp", "positives", "negatives")


def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.regression_metrics(_numbers(spark, d), ["endpoint"], "y", "predicted")
    # A relative error where y is 0 is divided by the epsilon only: beyond a million, nine digits are compared.
    digits = lambda c: F.when(F.abs(c) < 1e6, rounded(c)).otherwise(F.format_string("%.8e", c).cast("double"))
    return out.withColumns({c: digits(F.col(c)) for c in out.columns if c != "endpoint"})


# ---- cross-validation reports and comparisons of methods


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return statistics.long_scores(table(spark, d, "cv_report"), METHODS, BY)


def cv_long(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def cv_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.summary_rows(_scores(spark, d), BY), "mean", "std", "median")


def cv_wide(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.cross_validation_report(_scores(spark, d), BY, METHODS), *METHODS)


def best_methods(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.best_method(_scores(spark, d), BY), "mean")


def variance_homogeneity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.variance_homogeneity(_scores(spark, d), BY), "fold_difference", "levene").drop("p_value")


def residuals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.centred(_scores(spark, d), BY), "centred")


def residual_histogram(spark: SparkSession, d: str) -> DataFrame:
    return statistics.histogram(_scores(spark, d), BY)


def anova(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.repeated_measures_anova(_scores(spark, d), BY), "f").drop("p_value")


def method_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.ranks(_scores(spark, d), BY), "pct_rank").drop("ties")


def mean_pct_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.mean_pct_ranks(_scores(spark, d), BY), "mean_pct_rank")


def friedman(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.friedman(_scores(spark, d), BY), "q").drop("p_value")


def conover(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.conover(_scores(spark, d), BY), "t").drop("p_value", "p_holm")


def tukey(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.tukey(_scores(spark, d), BY), "mean_diff", "se").drop("q", "p_value", "lower", "upper")


def comparison_p_values(spark: SparkSession, d: str) -> DataFrame:
    """All tests' p-values with their marks: by special functions, so without SQL."""
    s = _scores(spark, d)
    parts = [
        statistics.repeated_measures_anova(s, BY).select(*BY, F.lit("anova").alias("test"), "p_value"),
        statistics.friedman(s, BY).select(*BY, F.lit("friedman").alias("test"), "p_value"),
        statistics.variance_homogeneity(s, BY).select(*BY, F.lit("levene").alias("test"), "p_value"),
        statistics.tukey(s, BY).select(*BY, F.concat_ws(" ", F.lit("tukey"), "method_1", "method_2").alias("test"), "p_value"),
        statistics.conover(s, BY).select(*BY, F.concat_ws(" ", F.lit("conover"), "method_1", "method_2").alias("test"), F.col("p_holm").alias("p_value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("stars", statistics.stars(F.col("p_value")))


def box_data(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.box_data(_scores(spark, d), BY), "low", "q1", "median", "q3", "high")


# ---- selection, conformal prediction, inference


def anova_scores(spark: SparkSession, d: str) -> DataFrame:
    df = _features(spark, d).where("activity in (0.0, 1.0)")
    return _rounded(selection.anova_scores(df, _feature_names(df), "activity"), "f")


def regression_scores(spark: SparkSession, d: str) -> DataFrame:
    df = _features(spark, d).where("activity is not null")
    return _rounded(selection.regression_scores(df, _feature_names(df), "activity"), "f")


def conformal_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Fold predictions made up from the scores: one residual per cycle, one row per endpoint and score."""
    s = _scores(spark, d)
    fold = F.pmod(F.col("cv_cycle").cast("int"), F.lit(5))
    residuals_ = s.where("method = 'm_knn' and scoring = 'roc_auc'").select(fold.alias("fold"), F.abs(F.col("value") - 0.7).alias("residual"))
    rows = s.where("method = 'm_boost'").select(F.concat_ws("/", *BY).alias("id"), fold.alias("fold"), "value")
    predictions = rows.groupBy("id", "fold").agg(F.avg("value").alias("predicted"))
    return conformal.plus_intervals(predictions, residuals_, 0.1)


def write_back(spark: SparkSession, d: str) -> DataFrame:
    records = profile.missing_as_null(table(spark, d, "test_set").select("rec_id", "y"))
    predictions = records.where("rec_id % 3 = 0").select("rec_id", (F.col("rec_id") / 2.0).alias("y"))
    return inference.write_back(records, predictions, "rec_id", ["y"])


def prediction_summary(spark: SparkSession, d: str) -> DataFrame:
    out = inference.summary(profile.missing_as_null(table(spark, d, "test_set")), "y")
    return _rounded(out, "mean", "std", "missing", "q10", "q50", "q90")


def prediction_extremes(spark: SparkSession, d: str) -> DataFrame:
    return inference.extremes(profile.missing_as_null(table(spark, d, "test_set")), "rec_id", "y")


# ---- models, selection, whole rows, structures


def _complete(spark: SparkSession, d: str) -> DataFrame:
    """Features without gaps, as the handlers fill them, of records with an activity; written once."""
    df = profile.missing_as_null(table(spark, d, "features")).where("activity is not null")
    return Scratch(spark).save(missing.MissingHandler().fit(df).transform(df).dropDuplicates(["rec_id"]))


def _classes_of(df: DataFrame) -> DataFrame:
    return df.where("activity in (0.0, 1.0)")


def dummy_predictions(spark: SparkSession, d: str) -> DataFrame:
    df = profile.missing_as_null(table(spark, d, "features")).where("activity is not null").select("rec_id", "activity", "feature1")
    return models.fit_model("Dummy", df, ["feature1"], "activity", False).score(df).select("rec_id", rounded("predicted").alias("predicted"))


def _one_feature(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = profile.missing_as_null(table(spark, d, "features")).where("activity is not null and feature3 is not null").select("rec_id", "activity", "feature3")
        return models.fit_model(name, df, ["feature3"], "activity", False).score(df).select("rec_id", rounded("predicted", 5).alias("predicted"))

    return query


def _validated(names: tuple[str, ...], classification: bool):
    """Scores of models fitted on the training part and asked for the test part."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = _complete(spark, d)
        train, test = workflow.split_tables(_classes_of(df) if classification else df, {"option": "random"}, profile.Roles())
        return validation.external_validation(train, test, names, profile.Roles(), classification)

    return query


def boosted_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Second-order boosting of both kinds of trees, ten rounds each."""
    df = _complete(spark, d)
    cols, parts = profile.Roles().features(df), []
    for name in ("XGB", "CatBoost"):
        out = models.fit_model(name, df, cols, "activity", False, rounds=10).score(df)
        parts.append(out.select("rec_id", F.lit(name).alias("model"), rounded("predicted").alias("predicted")))
    return parts[0].unionByName(parts[1])


def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    df = _complete(spark, d)
    cols = profile.Roles().features(df)
    fits = {n: (lambda t, n=n: models.fit_model(n, t, cols, "activity", False)) for n in ("Dummy", "Linear", "Ridge")}
    return validation.cross_validate(df, fits, profile.Roles(), False, 5, 1)


def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    df = _complete(spark, d)
    return _rounded(selection.mutual_information_scores(df, profile.Roles().features(df), "activity", False, "rec_id"), "f")


def selected_features(spark: SparkSession, d: str) -> DataFrame:
    """What each selector keeps."""
    df = _complete(spark, d)
    rows = [(m, c) for m in ("Anova", "RandomForest", "GradientBoosting", "Lasso") for c in selection.FeatureSelector(m, False, k=5).fit(df).selected]
    return spark.createDataFrame(rows, "method string, feature string")


def _whole_rows(method: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = _complete(spark, d)
        scaled = Scratch(spark).save(scaling.Rescaler("StandardScaler").fit(df).transform(df))
        return outliers.MultivariateOutliersHandler(method).fit(scaled).transform(scaled).select("rec_id")

    return query


def removal_comparison(spark: SparkSession, d: str) -> DataFrame:
    df = _complete(spark, d)
    return outliers.compare_removal(df, {m: outliers.MultivariateOutliersHandler(m) for m in ("EmpiricalCovariance", "IsolationForest")})


def preprocessed(spark: SparkSession, d: str) -> DataFrame:
    """All preprocessing steps, one after the other."""
    return preprocess.DataPreprocessor().fit_transform(table(spark, d, "features"))[1]


def sphere_clusters(spark: SparkSession, d: str) -> DataFrame:
    bits = F.filter(F.transform("x", lambda v, i: F.when(v > 0.15, i)), lambda v: v.isNotNull())
    return splits.sphere_exclusion(_vectors(spark, d).select("id", bits.alias("bits")), 0.5)


def domain_gamma(spark: SparkSession, d: str) -> DataFrame:
    """The kernel width at which the values over all pairs vary most."""
    wide = _vectors(spark, d).select("id", *(F.col("x")[i].alias(f"x{i}") for i in range(64)))
    cols = [f"x{i}" for i in range(64)]
    rows = Scratch(spark).save(wide.select("id", neighbours.scaled(cols, neighbours.seuclidean_variances(wide, cols)).alias("x")))
    return spark.createDataFrame([(neighbours.best_gamma(rows),)], "gamma double")


def domain_by_machine(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return _rounded(neighbours.machine_domain(rows, rows.where("id % 50 = 0")), "score")


def group_activity(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.missing_as_null(table(spark, d, "train_val").select("source", "y"))
    return _rounded(statistics.group_activity(rows, "source", "y"), "activity")


def shared_compounds(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that the training and the test table both hold."""
    return statistics.common_values(table(spark, d, "train_val"), table(spark, d, "test_set"), ["drug_id"])


def split_checks(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_checks(splits.group_split(table(spark, d, "train_val").select("rec_id", "source"), "rec_id", "source"), "rec_id", "source", "split")


def probability_plot(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.probability_plot(_scores(spark, d), BY), "value").drop("quantile")


def tukey_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.tukey(_scores(spark, d), BY).select(*BY, "method_1", "method_2", "lower", "upper"), "lower", "upper")


def standardised_structures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "testcase").select("rec_id", "smiles")
    fixed = standardise.Standardizer(salts=True, uncharge=True, reionise=True, largest=True).column(F.col("smiles"))
    return rows.select("rec_id", fixed.alias("structure"), chem.scaffold(fixed).alias("scaffold"))


def structure_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "testcase").select("rec_id", "smiles")
    return rows.select("rec_id", *(F.size(chem.features(F.col("smiles"), k)).alias(k) for k in ("ECFP4", "FCFP4", "RDK5", "PubChem", "RDKdes")))


def scaffold_split(spark: SparkSession, d: str) -> DataFrame:
    rows = Scratch(spark).save(table(spark, d, "testcase").select("rec_id", chem.scaffold(F.col("smiles")).alias("scaffold")))
    return splits.group_split(rows, "rec_id", "scaffold")


def workflow_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A whole run on the features: split, steps, model, intervals and domain, then predictions of all records."""
    df = table(spark, d, "features").where("activity is not null and not isnan(activity)").dropDuplicates(["rec_id"])
    settings = workflow.Settings(developer={"select": ("Ridge", "Linear"), "n_repeats": 1}, domain={"method": "knn"}, preprocessor={"kbin": {"deactivate": True}})
    out = workflow.Workflow(settings).fit(df).predict(df, 0.1)
    return out.withColumnsRenamed({"Predicted value": "predicted", "Prediction Interval (alpha=0.1)": "interval", "Applicability domain": "domain"})


QUERIES = {
    f.__name__: f
    for f in (
        dummy_predictions, boosted_predictions, cross_validation, mutual_information, selected_features, removal_comparison, preprocessed, sphere_clusters, domain_gamma, domain_by_machine, group_activity, shared_compounds,
        split_checks, probability_plot, tukey_intervals, standardised_structures, structure_features, scaffold_split, workflow_predictions,
        p3_found, p3_rejects, p3_loaded, feature_statistics, duplicate_columns, low_variance, variance_curve, outlier_counts, random_split,
        stratified_split, group_split, random_group_split, repeated_folds, repeated_stratified_folds, stratified_group_folds, nearest,
        outlier_factors, domain_by_neighbours, domain_by_outlier_factor, neighbour_classes, neighbour_means, tanimoto_neighbours,
        threshold_metrics, probability_metrics, ranking_metrics, roc_points, regression_metrics, cv_long, cv_summary, cv_wide, best_methods,
        variance_homogeneity, residuals, residual_histogram, anova, method_ranks, mean_pct_ranks, friedman, conover, tukey,
        comparison_p_values, box_data, anova_scores, regression_scores, conformal_intervals, write_back, prediction_summary, prediction_extremes,
    )
}
QUERIES |= {f"duplicate_rows_{k}": _duplicate_rows(k) for k in duplicates.KEEPS}
QUERIES |= {f"missing_{s}": _missing(s) for s in missing.STRATEGIES}
QUERIES |= {
    "outliers_iqr_rows": _univariate("iqr", iqr_mode="drop"), "outliers_iqr_null": _univariate("iqr"), "outliers_winsorized": _univariate("winsorization"),
    "outliers_imputed": _univariate("imputation"), "outliers_power": _univariate("power"), "outliers_uniform": _univariate("uniform"),
    "outliers_normal": _univariate("normal"),
}
QUERIES |= {f"binned_{s}": _binned(s) for s in ("quantile", "uniform", "kmeans")}
QUERIES |= {f"rescaled_{n}": _rescaled(m) for n, m in (("minmax", "MinMaxScaler"), ("standard", "StandardScaler"), ("robust", "RobustScaler"))}
QUERIES |= {"linear_predictions": _one_feature("Linear"), "ridge_predictions": _one_feature("Ridge")}
QUERIES |= {
    "validated_classifiers": _validated(("Dummy", "Logistic", "KNeighbors", "RandomForest"), True),
    "validated_regressors": _validated(("Dummy", "Linear", "Ridge", "ElasticNetCV", "SVM", "RandomForest"), False),
}
QUERIES |= {f"rows_{n}": _whole_rows(m) for n, m in (("factor", "LocalOutlierFactor"), ("isolation", "IsolationForest"), ("one_class", "OneClassSVM"), ("robust", "RobustCovariance"), ("empirical", "EmpiricalCovariance"))}
