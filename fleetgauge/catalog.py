"""The queries by name, each over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import settings as S
from fleetgauge.functions import expressions as X
from fleetgauge.operators import boosting
from fleetgauge.plans import drift, features, kpis, models, scoring, sketches, stats
from fleetgauge.schemas import SCHEMAS, required_nulls
from fleetgauge.sources import files, roundtrips
from fleetgauge.sources import fixtures as V
from fleetgauge.sources.shared import remove_shared, write_shared

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, as sums of doubles depend on the order of their terms."""
    return df.withColumns({c: X.round_to(F.col(c), 6) for c in columns})


# Tables the queries read.


def _events(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: run(V.device_events(spark, d))


def _tickets(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: run(V.support_tickets(spark, d))


def _events_tickets(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: run(V.device_events(spark, d), V.support_tickets(spark, d))


def _events_releases(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: run(V.device_events(spark, d), V.release_dates(spark, d))


def _over(view: Callable) -> Callable:
    """Queries over one patch view."""

    def make(run: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, d: run(view(spark, d))

    return make


def _qa_view(spark: SparkSession, d: str) -> DataFrame:
    return scoring.qa_priority(V.scored_patches(spark, d))


_base, _patches, _scored = _over(V.patch_base), _over(V.patch_features), _over(V.scored_patches)
_qa, _predictions = _over(_qa_view), _over(V.predictions)


def _monitoring(spark: SparkSession, d: str) -> DataFrame:
    return scoring.monitoring_sheet(
        scoring.qa_sheet(V.scored_patches(spark, d)), V.patch_base(spark, d)
    )


_monitored = _over(_monitoring)


def _sides(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    return V.history(patches), V.new_patches(patches)


def _labelled(patches: DataFrame) -> DataFrame:
    return models.add_label(patches).withColumnRenamed("label", "high_risk_flag")


def _is_new() -> Column:
    return F.col("release_date") >= F.lit(V.NEW_SINCE).cast("date")


# Queries that need more than one line.


def merge_features(spark: SparkSession, d: str) -> DataFrame:
    events, tickets = V.device_events(spark, d), V.support_tickets(spark, d)
    merged = features.merge_features(
        V.versioned_patches(spark, d),
        features.error_rates(events),
        features.rma_by_firmware(tickets, events),
    )
    kept = ["release_seq", "firmware_version", "error_rate_per_10k", "error_events", "tickets", "rmas"]
    sql = [c for c in merged.columns if c.endswith("_sql")]
    return rounded(merged.select(*kept, *sql), "error_rate_per_10k")


def training_table(spark: SparkSession, d: str) -> DataFrame:
    events, tickets = V.device_events(spark, d), V.support_tickets(spark, d)
    table = features.training_table(
        V.versioned_patches(spark, d),
        features.pre_post_errors(V.release_dates(spark, d), events),
        features.rma_by_firmware(tickets, events),
    )
    # As doubles: unmatched versions leave nulls in these counts.
    counts = ["pre_errors_sql", "post_errors_sql", "delta_errors_sql", "tickets_sql"]
    shown = table.select(
        "release_seq",
        "firmware_version",
        "pre_errors_synth",
        *[F.col(c).cast("double").alias(c) for c in counts],
        "rma_rate_sql",
        "target_error_rate",
        "regression_ratio",
    )
    return rounded(shown, "target_error_rate", "regression_ratio")


def _pre_post(spark: SparkSession, d: str, **options) -> DataFrame:
    return features.pre_post_errors(V.release_dates(spark, d), V.device_events(spark, d), **options)


def top_regressions(spark: SparkSession, d: str) -> DataFrame:
    found = _pre_post(spark, d).where(F.col("post_pre_ratio").isNotNull())
    return found.orderBy(F.desc("post_pre_ratio"), "release_version", "error_code").limit(10)


def rollup_pre_post(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.rollup_pre_post(_pre_post(spark, d)), "post_pre_ratio")


def _spikes(calendar: bool) -> Query:
    return _events(
        lambda events: rounded(features.error_spikes(events, calendar=calendar), "trailing_7d_avg")
    )


def _rma(spark: SparkSession, d: str) -> DataFrame:
    return features.rma_by_firmware(V.support_tickets(spark, d), V.device_events(spark, d))


def patch_features(spark: SparkSession, d: str) -> DataFrame:
    columns = SCHEMAS["patch_features"].fieldNames()
    doubles = [
        "patch_size_mb",
        "code_churn_score",
        "previous_version_error_rate",
        "error_rate_per_10k",
        "post_pre_ratio",
        "rma_rate",
    ]
    return rounded(V.patch_features(spark, d).select(columns), *doubles)


def gate_input(spark: SparkSession, d: str) -> DataFrame:
    sheet = V.patch_features(spark, d).select("firmware_version", *S.RISK_FEATURES)
    return rounded(sheet, "code_churn_score", "previous_version_error_rate")


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    columns = SCHEMAS["patch_features"].fieldNames()
    patches = V.patch_features(spark, d).select(*columns, "product_line", "release_seq")
    return stats.quality_report(patches)


def append_new(spark: SparkSession, d: str) -> DataFrame:
    old, new = _sides(V.patch_base(spark, d))
    both = drift.append_new(old, drift.mark_new(new))
    return rounded(both.select("firmware_version", "code_churn_score"), "code_churn_score")


def _five(df: DataFrame) -> DataFrame:
    return rounded(df, "min", "q1", "median", "q3", "max")


def _summary(df: DataFrame, column: str) -> DataFrame:
    return rounded(stats.describe(df, column), "mean", "median", "std", "min", "max")


def _bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    return rounded(stats.histogram(df, column, bins), "bin_start", "bin_end")


def _tiers() -> list[str]:
    return [name for name, _ in S.MONITORING_TIERS] + [S.MONITORING_TIER_REST]


def _buckets() -> list[str]:
    return [name for name, _ in S.QA_BUCKETS] + [S.QA_BUCKET_REST]


def missing_values(spark: SparkSession, d: str) -> DataFrame:
    """Nulls in every column that its table must fill, over the three tables."""
    tables = {
        "device_events": V.regional_events(spark, d),
        "firmware_releases": V.release_dates(spark, d),
        "support_tickets": V.support_tickets(spark, d),
    }
    parts = []
    for name, df in tables.items():
        wide = required_nulls(df, name)
        parts.append(wide.unpivot([], wide.columns, "column_name", "nulls").withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).orderBy("table_name", "column_name")


def sql_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Errors per version, by SQL text over a registered table."""
    files.register(V.device_events(spark, d), "device_events")
    return files.q(
        spark,
        "select firmware_version, count(*) as error_events from device_events group by firmware_version",
    )


def gate_json(spark: SparkSession, d: str) -> DataFrame:
    """The fields of the gate's JSON summary."""
    text = scoring.gate(V.scored_patches(spark, d)).select(scoring.summary_json("patches.csv").alias("text"))
    fields = F.from_json("text", "input_file string, n_high_risk bigint, avg_risk_score double")
    return rounded(text.select(fields.alias("s")).select("s.*"), "avg_risk_score")


# Models. Their figures depend on the learner, so what is returned is exact by itself: the
# rows of the splits, and whether the figures reach the published ones. The figures are in
# the functions of ``plans.models``.


MODEL_COLUMNS = ["firmware_version", "release_date", "error_rate_per_10k", *S.RISK_FEATURES]
LEAST_AUC, LEAST_R2, LEAST_ACCURACY = 0.90, 0.78, 0.87


def _labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    """All patches with their label, written once, as fits and metrics read them several times."""
    rows = write_shared(V.patch_features(spark, d).select(MODEL_COLUMNS))
    labelled = write_shared(models.add_label(rows))
    remove_shared(rows)
    return labelled


def _train_test(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labelled = _labelled_rows(spark, d)
    fit, test = map(write_shared, models.split(labelled, "firmware_version"))
    remove_shared(labelled)
    return fit, test


def _sizes(test: DataFrame) -> DataFrame:
    return test.agg(F.count(F.lit(1)).alias("n_test"), F.sum("label").alias("positives"))


def _reaches(df: DataFrame, column: str, least: float):
    """Scalar: whether the one row of ``df`` has ``column`` at ``least``."""
    return df.select(F.col(column) >= least).scalar()


def _regression(train: Callable) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        fit, test = _train_test(spark, d)
        scored = train(fit).transform(models.cast_features(test)).select("error_rate_per_10k", "prediction")
        found = models.regression_metrics(write_shared(scored), "error_rate_per_10k")
        return _sizes(test).withColumn("r2_reached", _reaches(found, "r2", LEAST_R2))

    return run


def _classification(train: Callable) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        fit, test = _train_test(spark, d)
        scored = models.score(test, train(fit)).select("label", "risk_score", "high_risk_flag")
        found = models.classification_metrics(write_shared(scored), predicted="high_risk_flag")
        return _sizes(test).withColumns(
            {
                "auc_reached": _reaches(found, "roc_auc", LEAST_AUC),
                "accuracy_reached": _reaches(found, "accuracy", LEAST_ACCURACY),
            }
        )

    return run


def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """Five folds of the boosted models: mean AUC and mean RMSE against the published ones.

    The RMSE that stands for R squared is taken from the spread of the label.
    """
    fit, _ = _train_test(spark, d)
    mean = lambda label, loss: models.cross_validate_boosted(fit, "firmware_version", label, loss).agg(F.avg("metric").alias("m"))
    auc, rmse = mean("label", boosting.LOGISTIC), mean("error_rate_per_10k", boosting.SQUARED)
    most = F.stddev_pop("error_rate_per_10k") * (1 - LEAST_R2) ** 0.5
    return fit.agg(
        F.count(F.lit(1)).alias("n_train"),
        _reaches(auc, "m", LEAST_AUC).alias("auc_reached"),
        (rmse.scalar() <= most).alias("rmse_reached"),
    )


def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """The features, and whether each importance is a share and all add up to one."""
    fit, _ = _train_test(spark, d)
    found = models.feature_importance(spark, models.train_rf_regressor(fit))
    whole = found.select(F.abs(F.sum("importance") - 1) < 1e-6).scalar()
    return found.select("feature", (F.col("importance").between(0, 1) & whole).alias("is_share"))


def scored_by_model(spark: SparkSession, d: str) -> DataFrame:
    """The scored test rows, and whether score and flag are sound."""
    fit, test = _train_test(spark, d)
    scored = models.score_patches(test, models.train_rf_classifier(fit))
    return scored.select(
        "firmware_version",
        F.col("risk_score").between(0, 1).alias("is_probability"),
        (F.col("high_risk_flag") == (F.col("risk_score") >= S.RISK_THRESHOLD).cast("int")).alias("is_flagged_right"),
    )


def retrained(spark: SparkSession, d: str) -> DataFrame:
    """The held-out rows after refitting on history and new rows, and whether the AUC holds."""
    old, new = _sides(_labelled_rows(spark, d))
    both = write_shared(drift.append_new(old, drift.mark_new(new)))
    _, auc = models.retrain(both)
    _, test = models.split_stratified(both, "firmware_version")
    return _sizes(test).withColumn("auc_reached", _reaches(auc, "roc_auc", LEAST_AUC))


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The feature vectors as arrays."""
    rows = models.assemble(V.patch_features(spark, d))
    array = vector_to_array("features")
    return rows.select("firmware_version", F.transform(array, lambda x: X.round_to(x, 6)).alias("features"))


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and positives on both sides of the plain and the stratified split."""
    rows = models.add_label(V.patch_base(spark, d).select("firmware_version", "error_rate_per_10k"))
    parts = []
    for kind, sides in (
        ("plain", models.split(rows, "firmware_version")),
        ("stratified", models.split_stratified(rows, "firmware_version")),
    ):
        for side, part in zip(("train", "test"), sides, strict=True):
            counts = part.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))
            parts.append(counts.select(F.lit(kind).alias("kind"), F.lit(side).alias("side"), "n", "positives"))
    return reduce(DataFrame.unionByName, parts)


def history_sample(spark: SparkSession, d: str) -> DataFrame:
    """The fixed-size sample of history that stands for new arrivals."""
    drawn = drift.mark_new(drift.sample_n(V.history(V.patch_base(spark, d)), "firmware_version"))
    return drawn.select("firmware_version", "release_seq")


def drift_from_moments(spark: SparkSession, d: str) -> DataFrame:
    """Drift from states of three batches of history and of the new rows."""
    old, new = _sides(V.patch_features(spark, d))
    third = F.pmod(F.col("release_seq"), F.lit(3))
    history = drift.merge_moments(*[drift.moments(old.where(third == k)) for k in range(3)])
    report = drift.drift_from_moments(history, drift.moments(new))
    return rounded(report, "history_mean", "new_mean", "drift_pct")


def sketched_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Errors per day from the sketches, and whether the whole span's counts are near the exact."""
    events = V.device_events(spark, d)
    days = sketches.daily_sketches(events, "model")
    exact = kpis.executive_kpis(events).select(F.struct("*").alias("e")).scalar()
    found = sketches.executive_kpis(days).withColumn("e", exact).select("*", *[F.col("e")[c].alias(f"exact_{c}") for c in ("total_devices", "unique_error_codes", "total_firmware_versions")])
    near = [sketches.is_near(c, f"exact_{c}").alias(f"{c}_near") for c in ("total_devices", "unique_error_codes", "total_firmware_versions")]
    return found.select("total_error_events", *near)


def sketched_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Errors per model from daily sketches, and whether the device counts are near the exact."""
    events = V.device_events(spark, d)
    found = sketches.by_dimension(sketches.daily_sketches(events, "model"), "model")
    exact = kpis.by_model(events).select("model", F.col("device_count").alias("exact"))
    return found.join(exact, "model").select("model", "total_errors", sketches.is_near("device_count", "exact").alias("devices_near"))


QUERIES: dict[str, Query] = {
    "required_nulls": missing_values,
    "executive_kpis": _events(kpis.executive_kpis),
    "error_rate_by_firmware": _events_releases(kpis.error_rate_by_firmware),
    "high_risk_firmware": _events(kpis.high_risk_firmware),
    "error_code_share": _events(kpis.error_code_share),
    "ticket_summary": _tickets(kpis.ticket_summary),
    "rma_rate_joined": _events_tickets(kpis.rma_rate_joined),
    "weekly_trend": _events(kpis.weekly_trend),
    "by_model": _events(kpis.by_model),
    "by_region": lambda spark, d: kpis.by_region(V.regional_counts(spark, d), "n_events"),
    "sketched_kpis": sketched_kpis,
    "sketched_by_model": sketched_by_model,
    "error_cooccurrence": _events(kpis.error_cooccurrence),
    "version_regressions": _events(kpis.version_regressions),
    "version_regressions_consecutive": _events(
        lambda e: kpis.version_regressions(e, consecutive=True)
    ),
    "escalation": _tickets(kpis.escalation),
    "release_health": _events_tickets(kpis.release_health),
    "table_counts": lambda spark, d: features.table_counts(
        {
            "device_events": V.device_events(spark, d),
            "firmware_releases": V.release_dates(spark, d),
            "support_tickets": V.support_tickets(spark, d),
        }
    ),
    "cardinalities": _events(features.cardinalities),
    "error_rates": _events(features.error_rates),
    "top_error_rates": _events(
        lambda e: scoring.top_by(features.error_rates(e), "error_rate_per_10k", 10)
    ),
    "rma_by_error": _tickets(features.rma_by_error),
    "attributed_tickets": _events_tickets(lambda e, t: features.attribute_tickets(t, e)),
    "rma_by_firmware": _rma,
    "meaningful_rma": lambda spark, d: features.meaningful_rma(_rma(spark, d)),
    "top_rma": lambda spark, d: features.top_rma(_rma(spark, d)),
    "error_spikes": _spikes(calendar=False),
    "error_spikes_calendar": _spikes(calendar=True),
    "pre_post_errors": _pre_post,
    "pre_post_same_version": lambda spark, d: _pre_post(spark, d, same_version=True),
    "top_regressions": top_regressions,
    "stability_curves": _events_releases(features.stability_curves),
    "first_curves": _events_releases(
        lambda e, r: features.first_curves(features.stability_curves(e, r))
    ),
    "rollup_pre_post": rollup_pre_post,
    "firmware_releases": V.firmware_releases,
    "patch_features": patch_features,
    "gate_input": gate_input,
    "merge_features": merge_features,
    "training_table": training_table,
    "error_rate_quantile": _base(
        lambda p: rounded(stats.quantile(p, "error_rate_per_10k", 0.75), "value"),
    ),
    "churn_bounds": _base(
        lambda p: rounded(stats.churn_bounds(p), "churn_min", "churn_max"),
    ),
    "describe_risk": _scored(lambda p: _summary(p, "risk_score")),
    "describe_qa": _qa(lambda p: _summary(p, "QA_priority_score")),
    "risk_counts": _scored(lambda p: stats.value_counts(p, "high_risk_flag")),
    "bucket_shares": _qa(lambda p: rounded(stats.value_counts(p, "QA_bucket", True), "share")),
    "bucket_by_hotfix": _qa(lambda p: stats.crosstab(p, "is_hotfix", "QA_bucket", _buckets())),
    "tier_by_age": _monitored(
        lambda m: stats.crosstab(m, "older_device_flag", "monitoring_tier", _tiers())
    ),
    "risk_histogram": _scored(lambda p: _bins(p, "risk_score", 20)),
    "qa_histogram": _qa(
        lambda p: _bins(p, "QA_priority_score", 30)
    ),
    "error_rate_histogram": _base(
        lambda p: _bins(p, "error_rate_per_10k", 20)
    ),
    "hotfix_mean": _base(
        lambda p: rounded(stats.group_mean(p, "is_hotfix", "error_rate_per_10k"), "mean")
    ),
    "tier_risk_quantiles": _monitored(
        lambda m: _five(stats.group_quantiles(m, "monitoring_tier", "risk_score")),
    ),
    "tier_priority_quantiles": _monitored(
        lambda m: _five(stats.group_quantiles(m, "monitoring_tier", "monitoring_priority")),
    ),
    "churn_correlation": _base(
        lambda p: rounded(stats.pearson(p, "code_churn_score", "error_rate_per_10k"), "r")
    ),
    "hotfix_correlation": _base(
        lambda p: rounded(
            stats.pearson(p.withColumn("is_hotfix", F.col("is_hotfix").cast("int")), "is_hotfix", "error_rate_per_10k"),
            "r",
        )
    ),
    "signal_audit": _patches(
        lambda p: rounded(stats.signal_audit(p, complete=True), "spearman")
    ),
    "signal_audit_pairwise": _patches(
        lambda p: rounded(stats.signal_audit(p), "spearman")
    ),
    "feature_summary": _patches(lambda p: rounded(stats.feature_summary(p), "mean_error_rate")),
    "quality_report": quality_report,
    "cumulative_share": _qa(
        lambda p: rounded(
            stats.cumulative_share(p, "QA_priority_score"), "QA_priority_score", "cumulative_pct"
        ),
    ),
    "gate": _scored(lambda p: rounded(scoring.gate(p), "avg_risk_score")),
    "qa_sheet": _scored(
        lambda p: rounded(scoring.qa_sheet(p), "code_churn_score", "churn_norm", "QA_priority_score")
    ),
    "qa_top": _qa(
        lambda p: rounded(
            scoring.top_by(p.select("firmware_version", "QA_priority_score", "QA_bucket"), "QA_priority_score"),
            "QA_priority_score",
        )
    ),
    "monitoring_sheet": _monitored(lambda m: rounded(m, "monitoring_priority")),
    "monitoring_top": _monitored(
        lambda m: rounded(
            scoring.top_by(
                m.select("firmware_version", "monitoring_priority", "monitoring_tier"),
                "monitoring_priority",
                3,
            ),
            "monitoring_priority",
        )
    ),
    "qa_hours": _scored(lambda p: rounded(scoring.qa_hours(p), "pct_saved")),
    "drift_report": _patches(
        lambda p: rounded(drift.drift_between(p, _is_new()), "history_mean", "new_mean", "drift_pct")
    ),
    "drift_from_moments": drift_from_moments,
    "should_retrain": _base(
        lambda p: drift.should_retrain(drift.drift_between(p, _is_new(), ["code_churn_score"]))
    ),
    "class_balance": _base(
        lambda p: rounded(drift.class_balance(_labelled(p), _is_new()), "share")
    ),
    "append_new": append_new,
    "risk_labels": _base(
        lambda p: rounded(
            models.add_label(p.select("firmware_version", "error_rate_per_10k")), "error_rate_per_10k"
        ),
    ),
    "regression_metrics": _predictions(
        lambda p: rounded(models.regression_metrics(p, "error_rate_per_10k", "estimate"), "rmse", "r2")
    ),
    "classification_metrics": _predictions(
        lambda p: rounded(models.classification_metrics(p), "accuracy", "roc_auc"),
    ),
    "classification_report": _predictions(
        lambda p: rounded(models.classification_report(p), "precision", "recall", "f1")
    ),
    "confusion_matrix": _predictions(models.confusion_matrix),
    "roc_curve": _predictions(
        lambda p: rounded(models.roc_curve(p), "fpr", "tpr")
    ),
    "roc_curve_bins": _predictions(
        lambda p: rounded(models.roc_curve(p, bins=40), "fpr", "tpr")
    ),
    "prediction_band": _predictions(
        lambda p: rounded(models.prediction_band(p, "error_rate_per_10k", "estimate"), "band")
    ),
    "split_sizes": split_sizes,
    "history_sample": history_sample,
    "rf_regressor": _regression(models.train_rf_regressor),
    "rf_classifier": _classification(models.train_rf_classifier),
    "gbt_regressor": _regression(models.train_gbt_regressor),
    "gbt_classifier": _classification(models.train_gbt_classifier),
    "cross_validation": cross_validation,
    "feature_importance": feature_importance,
    "scored_by_model": scored_by_model,
    "retrained": retrained,
    "feature_matrix": feature_matrix,
    "sql_error_rates": sql_error_rates,
    "gate_json": gate_json,
    **roundtrips.QUERIES,
}
