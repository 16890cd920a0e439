"""Release gate, QA priority and fleet monitoring from risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import settings as S
from fleetgauge.functions import expressions as X
from fleetgauge.schemas import require_columns


def flag_high_risk(df: DataFrame, threshold: float = S.RISK_THRESHOLD) -> DataFrame:
    return df.withColumn("high_risk_flag", X.flag_ge(F.col("risk_score"), threshold))


def gate_summary(scored: DataFrame) -> DataFrame:
    score = F.col("risk_score")
    return scored.agg(
        X.rows().alias("n_patches"),
        F.count_if(F.col("high_risk_flag") == 1).alias("n_high_risk"),
        F.count_if(score.isNull() | F.isnan(score)).alias("n_unscored"),
        F.avg("risk_score").alias("avg_risk_score"),
    )


def gate(scored: DataFrame) -> DataFrame:
    """One row: counts, mean score, verdict and exit code. No patches pass.

    A patch without a score can neither pass nor fail: the verdict is ERROR, the code 2.
    """
    unscored, flagged = F.col("n_unscored") > 0, F.col("n_high_risk") > 0
    return gate_summary(scored).select(
        "*",
        F.when(unscored, "ERROR").when(flagged, "FAIL").otherwise("PASS").alias("verdict"),
        F.when(unscored, 2).otherwise(flagged.cast("int")).alias("exit_code"),
    )


def summary_json(input_file: str) -> Column:
    """The gate summary of a row as JSON text."""
    return F.to_json(F.struct(F.lit(input_file).alias("input_file"), "n_high_risk", "avg_risk_score"))


def normalise_churn(df: DataFrame, low: float = S.CHURN_MIN, high: float = S.CHURN_MAX) -> DataFrame:
    if high <= low:
        raise ValueError("The upper churn bound must lie above the lower one.")
    norm = (F.col("code_churn_score") - low) / (high - low + 1e-6)
    return df.withColumn("churn_norm", X.clip(norm, 0.0, 1.0))


def qa_priority(scored: DataFrame) -> DataFrame:
    """Add normalised churn, the weighted QA score and its bucket."""
    require_columns(scored, ["firmware_version", "code_churn_score", "risk_score"], "scored patches")
    score = S.QA_RISK_WEIGHT * F.col("risk_score") + S.QA_CHURN_WEIGHT * F.col("churn_norm")
    return (
        normalise_churn(scored)
        .withColumn("QA_priority_score", score)
        .withColumn("QA_bucket", X.qa_bucket(F.col("QA_priority_score")))
    )


def qa_sheet(scored: DataFrame) -> DataFrame:
    return qa_priority(scored).select(S.QA_COLUMNS)


def monitoring_sheet(qa: DataFrame, ages: DataFrame) -> DataFrame:
    """Patches with device age, a weighted monitoring score and its tier.

    ``ages`` may repeat a version; its highest age is taken, so no row of the QA
    sheet is doubled.
    """
    require_columns(ages, ["firmware_version", "avg_device_age_days"], "device ages")
    require_columns(qa, ["firmware_version", "risk_score"], "QA sheet")
    oldest = ages.groupBy("firmware_version").agg(
        F.max("avg_device_age_days").alias("avg_device_age_days")
    )
    older = X.flag_ge(F.col("avg_device_age_days"), S.DEVICE_AGE_THRESHOLD)
    priority = S.MONITORING_RISK_WEIGHT * F.col("risk_score") + S.MONITORING_AGE_WEIGHT * F.col(
        "older_device_flag"
    )
    return (
        qa.select("firmware_version", "risk_score")
        .join(oldest, "firmware_version", "left")
        .withColumn("older_device_flag", older)
        .withColumn("monitoring_priority", priority)
        .withColumn("monitoring_tier", X.monitoring_tier(F.col("monitoring_priority")))
        .select(S.MONITORING_COLUMNS)
    )


def top_by(df: DataFrame, score: str, k: int = 10, key: str = "firmware_version") -> DataFrame:
    """The ``k`` rows of highest score; ties go by key."""
    return df.orderBy(F.desc(score), key).limit(k)


def qa_hours(scored: DataFrame) -> DataFrame:
    """QA hours with risk tiers and without them, and the saving."""
    high = F.count_if(F.col("high_risk_flag") == 1)
    low = F.count_if(F.col("high_risk_flag") == 0)
    hours = scored.agg(
        (high * S.QA_HOURS_HIGH + low * S.QA_HOURS_LOW).alias("hours_with_model"),
        (X.rows() * S.QA_HOURS_FLAT).alias("hours_without_model"),
    )
    saved = F.col("hours_without_model") - F.col("hours_with_model")
    share = F.coalesce(F.try_divide(saved, F.col("hours_without_model")) * 100, F.lit(0.0))
    return hours.select("*", saved.alias("hours_saved"), share.alias("pct_saved"))
