"""Labels, splits, tree models and their evaluation on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetgauge import settings as S
from fleetgauge.functions import expressions as X
from fleetgauge.operators import boosting, forest
from fleetgauge.operators.ordered import quantiles, running_totals
from fleetgauge.plans import drift
from fleetgauge.plans.scoring import flag_high_risk
from fleetgauge.plans.stats import quantile
from fleetgauge.schemas import require_columns
from fleetgauge.sources import registry
from fleetgauge.sources.shared import remove_shared, write_shared

#: Rounds without gain that end a boosted model, and the depth of its trees.
PATIENCE, DEPTH = 10, 5
#: Share of the training rows that decide when it ends.
VALIDATION = 0.15


def cast_features(df: DataFrame, features: Sequence[str] = tuple(S.RISK_FEATURES)) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features})


def assembler(features: Sequence[str] = tuple(S.RISK_FEATURES)) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def assemble(df: DataFrame, features: Sequence[str] = tuple(S.RISK_FEATURES)) -> DataFrame:
    return assembler(features).transform(cast_features(df, features))


def add_label(df: DataFrame, column: str = "error_rate_per_10k", q: float = S.LABEL_QUANTILE) -> DataFrame:
    """1 for the rows at or above the quantile of the column, else 0."""
    return df.withColumn("label", X.flag_ge(F.col(column), quantile(df, column, q).scalar()))


def _share(key: str, seed: int) -> Column:
    return X.hash_share(F.col(key), seed)


def split(df: DataFrame, key: str, test: float = 0.33, seed: int = S.SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: a row stays on its side for good."""
    share = _share(key, seed)
    return df.where(share >= test), df.where(share < test)


def split_stratified(
    df: DataFrame, key: str, label: str = "label", test: float = 0.2, seed: int = S.SEED
) -> tuple[DataFrame, DataFrame]:
    """As ``split``, with the same share of test rows in each label.

    The border is the quantile of the hash within the label: one row per class.
    """
    hashed = df.withColumn("_hash", _share(key, seed))
    borders = quantiles(hashed, "_hash", [test], by=[label]).select(label, "value")
    placed = hashed.join(F.broadcast(borders), label)
    return tuple(
        placed.where(side).select(df.columns)
        for side in (F.col("_hash") >= F.col("value"), F.col("_hash") < F.col("value"))
    )


def with_validation(df: DataFrame, key: str, part: float = VALIDATION, seed: int = S.SEED + 1) -> DataFrame:
    """Mark a slice of the training rows for early stopping."""
    return df.withColumn("is_validation", _share(key, seed) < part)


def fit_rows(df: DataFrame, key: str) -> DataFrame:
    """All rows, dealt out by the key."""
    return cast_features(df).repartition(key).sortWithinPartitions(key)


def _forest(df: DataFrame, label: str, key: str, classes: bool, options: forest.Options) -> PipelineModel:
    features = S.RISK_FEATURES
    borders = boosting.bin_borders(df, features)
    trees = forest.fit_forest(df, features, borders, label, options, key)
    return PipelineModel([forest.Forest.of(features, borders, classes, trees)])


def train_rf_regressor(df: DataFrame, label: str = "error_rate_per_10k", trees: int = 100, depth: int = 15, key: str = "firmware_version"):
    """A forest over all rows, whose nodes try all features."""
    return _forest(df, label, key, False, forest.Options(trees, depth, len(S.RISK_FEATURES), S.SEED))


def train_rf_classifier(
    df: DataFrame, label: str = "label", trees: int = 100, depth: int = 15, key: str = "firmware_version"
):
    """A forest over all rows for a label of 0 and 1, whose nodes try a root of the features'
    number."""
    tried = math.ceil(len(S.RISK_FEATURES) ** 0.5)
    return _forest(df, label, key, True, forest.Options(trees, depth, tried, S.SEED))


def _boosted(df: DataFrame, key: str, label: str, options: boosting.Options, stop: bool = True) -> PipelineModel:
    """Boosted trees over all rows; where ``stop``, a slice of them ends it early."""
    features = S.RISK_FEATURES
    borders = boosting.bin_borders(df, features)
    held = _share(key, S.SEED + 1) < VALIDATION if stop else None
    model = boosting.fit_ensembles(df, features, borders, label, options, held=held)[-1]
    return PipelineModel([boosting.BoostedTrees.of(features, borders, options.loss, model)])


def train_gbt_regressor(
    df: DataFrame, key: str = "firmware_version", label: str = "error_rate_per_10k", rounds: int = 1000, step: float = 0.1
) -> PipelineModel:
    """Boosted trees for the squared error that end ``PATIENCE`` rounds after the best one on
    a slice of the training rows, and keep the rounds up to that."""
    return _boosted(df, key, label, boosting.Options(boosting.SQUARED, rounds, step, DEPTH, PATIENCE))


def train_gbt_classifier(
    df: DataFrame, key: str = "firmware_version", label: str = "label", rounds: int = 1000, step: float = 0.1
) -> PipelineModel:
    """As ``train_gbt_regressor``, for the log-loss of a label of 0 and 1."""
    return _boosted(df, key, label, boosting.Options(boosting.LOGISTIC, rounds, step, DEPTH, PATIENCE))


def cross_validate_boosted(
    df: DataFrame, key: str, label: str, loss: str, folds: int = 5, rounds: int = 1000, step: float = 0.1
) -> DataFrame:
    """(fold, n, rounds, metric): one row per fold, by a hash of the key, with the RMSE or the
    ROC-AUC on its rows of a model that never saw them.

    The models of all folds are fitted at once; each ends early by a slice of its own training
    rows. A fold of one class only has no AUC. Rows are scored by cell, as a model gives those
    that agree in all bins the same margin.
    """
    features, fold = S.RISK_FEATURES, F.floor(_share(key, S.SEED + 2) * folds).cast("int")
    borders = boosting.bin_borders(df, features)
    held, options = _share(key, S.SEED + 1) < VALIDATION, boosting.Options(loss, rounds, step, DEPTH, PATIENCE)
    cells = write_shared(boosting.cells(df, features, borders, label, fold, held))
    fitted = boosting.fit_cells(cells, len(features), options, folds)[:folds]
    whole = cells.groupBy("fold", *boosting.codes_of(len(features))).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    scored = write_shared(whole.withColumn("margin", boosting.cell_margin(len(features), fitted, "fold")).select("fold", "n", "total", "squares", "margin"))
    remove_shared(cells)
    n, margin = F.col("n"), F.col("margin")
    squares = F.col("squares") - 2 * margin * F.col("total") + n * margin * margin
    sizes = scored.groupBy("fold").agg(
        F.sum("n").cast("bigint").alias("n"), F.sqrt(F.greatest(F.sum(squares), F.lit(0.0)) / F.sum("n")).alias("rmse")
    )
    if loss == boosting.SQUARED:
        found = sizes.withColumnRenamed("rmse", "metric")
    else:
        sides = scored.withColumn("margin", _no_nan("margin")).groupBy("fold", "margin").agg(
            F.sum("total").cast("bigint").alias("pos"), F.sum(n - F.col("total")).cast("bigint").alias("neg")
        )
        areas = _area(running_totals(sides, "margin", ["pos", "neg"], ["fold"], descending=True), ["fold"])
        found = sizes.drop("rmse").join(areas.withColumnRenamed("roc_auc", "metric"), "fold", "left")
    ends = F.create_map(*[F.lit(x) for m, model in enumerate(fitted) for x in (m, len(model.leaves))])
    return found.select("fold", "n", ends[F.col("fold")].alias("rounds"), "metric")


def cross_validate(estimator, df: DataFrame, evaluator, key: str, folds: int = 5) -> CrossValidatorModel:
    """k-fold cross-validation of a Spark ML estimator with folds by a hash of the key; see
    ``avgMetrics``."""
    fold = F.floor(_share(key, S.SEED + 2) * folds).cast("int")
    rows = fit_rows(df, key).withColumn("fold", fold).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return CrossValidator(
            estimator=Pipeline(stages=[assembler(), estimator]),
            estimatorParamMaps=ParamGridBuilder().build(),
            evaluator=evaluator,
            numFolds=folds,
            foldCol="fold",
            parallelism=folds,
        ).fit(rows)
    finally:
        rows.unpersist()


def rmse_evaluator(label: str = "error_rate_per_10k") -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=label, metricName="rmse")


def auc_evaluator(label: str = "label") -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")


def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: RMSE and R squared."""
    y, error = F.col(label), F.col(label) - F.col(prediction)
    sums = pred.agg(F.avg(error * error).alias("_mse"), F.var_pop(y).alias("_var"))
    return sums.select(
        F.sqrt("_mse").alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.col("_mse"), F.col("_var"))).alias("r2"),
    )


def prediction_band(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Half-width of the 95 % band of the residuals."""
    return pred.agg((F.stddev_samp(F.col(label) - F.col(prediction)) * 1.96).alias("band"))


def _no_nan(score: str) -> Column:
    return F.when(F.isnan(score), F.raise_error(F.lit(f"{score} holds NaN"))).otherwise(F.col(score))


def _by_score(pred: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at each distinct score, and above it. A NaN score is an error."""
    counts = pred.withColumn(score, _no_nan(score)).groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return running_totals(counts, score, ["pos", "neg"], by, descending=True)


def roc_curve(
    pred: DataFrame, label: str = "label", score: str = "risk_score", bins: int | None = None
) -> DataFrame:
    """False and true positive rate at each distinct score taken as threshold.

    With ``bins`` only so many steps of the sum of both rates are kept, the last point of each:
    any point left out lies within a box of ``2 / bins`` below its neighbour, and the area under
    the kept points differs from ``roc_auc``, which stays exact, by ``2 / bins`` at most.
    """
    sides = pred.agg(
        F.struct(
            F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
        )
    ).scalar()
    ran = _by_score(pred, label, score).withColumn("_all", sides)
    curve = ran.select(
        F.col(score).alias("threshold"),
        X.ratio(F.col("neg_before") + F.col("neg"), F.col("_all.neg")).alias("fpr"),
        X.ratio(F.col("pos_before") + F.col("pos"), F.col("_all.pos")).alias("tpr"),
    )
    if bins is not None:
        step = F.ceil((F.coalesce("fpr", F.lit(0.0)) + F.coalesce("tpr", F.lit(0.0))) * (bins / 2))
        point = F.struct((-F.col("threshold")).alias("order"), "threshold", "fpr", "tpr")
        curve = curve.groupBy(step.alias("_step")).agg(F.max(point).alias("_p")).select("_p.threshold", "_p.fpr", "_p.tpr")
    return curve.orderBy(F.desc("threshold"))


def roc_auc(
    pred: DataFrame, label: str = "label", score: str = "risk_score", by: Sequence[str] = ()
) -> DataFrame:
    """Exact area under the ROC curve, also per group: each negative counts the positives above
    it, ties half."""
    return _area(_by_score(pred, label, score, by), by)


def _area(ran: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The area from positives and negatives at each score, and above it."""
    above = F.col("pos_before").cast("double") + F.col("pos") / 2
    sums = ran.groupBy(*by).agg(
        F.sum(F.col("neg") * above).alias("_area"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg")
    )
    box = F.col("_pos").cast("double") * F.col("_neg")
    return sums.select(*by, F.try_divide(F.col("_area"), box).alias("roc_auc"))


def classification_metrics(
    pred: DataFrame, label: str = "label", predicted: str = "predicted", score: str = "risk_score"
) -> DataFrame:
    """One row: accuracy and ROC-AUC."""
    return pred.agg(
        X.ratio(F.count_if(F.col(label) == F.col(predicted)), X.rows()).alias("accuracy")
    ).withColumn("roc_auc", roc_auc(pred, label, score).scalar())


def confusion_matrix(pred: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return (
        pred.groupBy(label)
        .agg(
            F.count_if(F.col(predicted) == 0).alias("predicted_low"),
            F.count_if(F.col(predicted) == 1).alias("predicted_high"),
        )
        .orderBy(label)
    )


def classification_report(pred: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    cells = pred.groupBy(label, predicted).agg(X.rows().alias("n"))
    hit = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col(label).alias("class")).agg(
        F.sum("n").alias("support"), F.sum(hit).alias("_hits")
    )
    claimed = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("_claimed"))
    precision = F.coalesce(X.ratio(F.col("_hits"), F.col("_claimed")), F.lit(0.0))
    recall = F.coalesce(X.ratio(F.col("_hits"), F.col("support")), F.lit(0.0))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return (
        actual.join(claimed, "class", "full")
        .fillna(0, ["support", "_hits", "_claimed"])
        .withColumn("precision", precision)
        .withColumn("recall", recall)
        .select(
            "class", "precision", "recall", F.coalesce(f1, F.lit(0.0)).alias("f1"), "support"
        )
        .orderBy("class")
    )


def feature_importance(
    spark: SparkSession, model: PipelineModel, features: Sequence[str] = tuple(S.RISK_FEATURES)
) -> DataFrame:
    """One row per feature, most important first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(weight)) for name, weight in zip(features, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def score(df: DataFrame, model: PipelineModel, threshold: float = S.RISK_THRESHOLD) -> DataFrame:
    """Add the probability of high risk and its flag."""
    require_columns(df, ["firmware_version", *S.RISK_FEATURES], "patches")
    probability = vector_to_array(F.col("probability"))[1]
    scored = model.transform(cast_features(df)).withColumn("risk_score", probability)
    return flag_high_risk(scored, threshold)


def score_patches(df: DataFrame, model: PipelineModel, threshold: float = S.RISK_THRESHOLD) -> DataFrame:
    return score(df, model, threshold).select(S.SCORED_COLUMNS)


def retrain(
    df: DataFrame, key: str = "firmware_version", rounds: int = 500, step: float = 0.01
) -> tuple[PipelineModel, DataFrame]:
    """Refit on history and new rows, all rounds; the model and its ROC-AUC on held-out rows."""
    train, test = map(write_shared, split_stratified(df, key))
    options = boosting.Options(boosting.LOGISTIC, rounds, step, DEPTH, None)
    model = _boosted(train, key, "label", options, stop=False)
    remove_shared(train)
    return model, roc_auc(score(test, model))


def renew(history: DataFrame, new: DataFrame, root: str, key: str = "firmware_version", **options) -> str | None:
    """The whole cycle: if new rows drift from history, refit on both, save the model as the
    version after the last one saved, and only then promote it. The version, or None."""
    report = drift.drift_report(history, new, ["code_churn_score"])
    if not drift.should_retrain(report).first()["retrain"]:
        return None
    model, _ = retrain(drift.append_new(history, drift.mark_new(new, key)), key, **options)
    version = registry.reserve_version(history.sparkSession, root)
    registry.save_model(model, root, version)
    registry.promote(history.sparkSession, root, version)
    return version
