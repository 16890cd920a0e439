"""Drift between history and new patches, and the decision to retrain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge import settings as S
from fleetgauge.functions import expressions as X
from fleetgauge.operators.sampling import bottom_k


def sample_n(df: DataFrame, key: str, n: int = 50, seed: int = 99) -> DataFrame:
    """``n`` rows drawn by a hash of the key: the same rows for any partitioning."""
    return bottom_k(df, X.hash_share(F.col(key), seed), key, n)


def mark_new(df: DataFrame, key: str = "firmware_version", suffix: str = ".NEW") -> DataFrame:
    return df.withColumn(key, X.suffix_key(F.col(key), suffix))


def append_new(history: DataFrame, new: DataFrame) -> DataFrame:
    return history.unionByName(new, allowMissingColumns=True)


def _drift(now: Column, base: Column) -> Column:
    change = F.try_divide(F.abs(now - base), base) * 100
    return F.when(base == 0, F.lit(0.0)).otherwise(change)


def both_sides(history: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """History and new rows in one frame, told apart by ``is_new``."""
    parts = [df.select(F.lit(flag).alias("is_new"), *columns) for df, flag in ((history, False), (new, True))]
    return parts[0].unionByName(parts[1])


def drift_between(
    rows: DataFrame,
    is_new: Column,
    features: Sequence[str] = tuple(S.DRIFT_FEATURES),
    threshold: float = S.DRIFT_THRESHOLD_PCT,
) -> DataFrame:
    """Means of each feature on both sides of one frame, in one pass, and their difference
    in percent."""
    means = rows.agg(
        *[F.avg(F.when(side, F.col(c))).alias(f"{name}_{c}") for c in features for name, side in (("h", ~is_new), ("n", is_new))]
    )
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"h_{c}").alias("history_mean"), F.col(f"n_{c}").alias("new_mean")) for c in features]
    pct = _drift(F.col("new_mean"), F.col("history_mean"))
    return (
        means.select(F.inline(F.array(*entries)))
        .withColumn("drift_pct", pct)
        .withColumn("drifted", F.coalesce(F.col("drift_pct") > threshold, F.lit(False)))
        .orderBy("feature")
    )


def moments(rows: DataFrame, features: Sequence[str] = tuple(S.DRIFT_FEATURES)) -> DataFrame:
    """(feature, n, total): one row per feature, from which means follow. States of several
    batches are merged by ``merge_moments``, so a batch is read once, when it arrives."""
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features]
    return rows.select(F.inline(F.array(*entries))).groupBy("feature").agg(F.count("x").alias("n"), F.sum("x").alias("total"))


def merge_moments(*states: DataFrame) -> DataFrame:
    """The state of all batches together."""
    whole = states[0]
    for state in states[1:]:
        whole = whole.unionByName(state)
    return whole.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def drift_from_moments(history: DataFrame, new: DataFrame, threshold: float = S.DRIFT_THRESHOLD_PCT) -> DataFrame:
    """As ``drift_report``, from states: history is not read again."""
    mean = X.ratio(F.col("total"), F.col("n"))
    both = history.select("feature", mean.alias("history_mean")).join(new.select("feature", mean.alias("new_mean")), "feature", "full")
    return (
        both.withColumn("drift_pct", _drift(F.col("new_mean"), F.col("history_mean")))
        .withColumn("drifted", F.coalesce(F.col("drift_pct") > threshold, F.lit(False)))
        .orderBy("feature")
    )


def drift_report(
    history: DataFrame,
    new: DataFrame,
    features: Sequence[str] = tuple(S.DRIFT_FEATURES),
    threshold: float = S.DRIFT_THRESHOLD_PCT,
) -> DataFrame:
    """As ``drift_between``, for two frames."""
    return drift_between(both_sides(history, new, features), F.col("is_new"), features, threshold)


def drift_pct(history: DataFrame, new: DataFrame, feature: str = "code_churn_score") -> DataFrame:
    return drift_report(history, new, [feature]).select("drift_pct")


def should_retrain(
    report: DataFrame,
    feature: str = "code_churn_score",
    threshold: float = S.DRIFT_THRESHOLD_PCT,
    accuracy_drop: float | None = None,
    max_accuracy_drop: float = 0.05,
    new_rows: int | None = None,
    min_new_rows: int | None = None,
) -> DataFrame:
    """One row: whether to retrain.

    Drift of the leading feature decides; a drop in accuracy or a number of new
    rows may be given as further reasons.
    """
    drifted = F.bool_or((F.col("feature") == feature) & (F.col("drift_pct") > threshold))
    other = (accuracy_drop is not None and accuracy_drop > max_accuracy_drop) or (
        new_rows is not None and min_new_rows is not None and new_rows >= min_new_rows
    )
    return report.agg((F.coalesce(drifted, F.lit(False)) | F.lit(other)).alias("retrain"))


def class_balance(rows: DataFrame, is_new: Column, label: str = "high_risk_flag") -> DataFrame:
    """Share of each class among history and new rows of one frame."""
    side = F.when(is_new, "new").otherwise("history").alias("side")
    counts = rows.groupBy(side, label).agg(X.rows().alias("n"))
    totals = F.sum("n").over(W.partitionBy("side"))  # one row per class
    return counts.select("side", label, "n", X.ratio(F.col("n"), totals).alias("share")).orderBy("side", label)
