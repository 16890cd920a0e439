"""Distinct counts from daily sketches: an option beside the exact counts of ``kpis``.

A day's sketches are computed once and stored by day. Any span of days, and any coarser
grouping, is a merge of stored sketches, so events are not read again. A count is off by
``1.04 / sqrt(2 ** LOG_K)`` of itself in standard deviation, 0.8 %; ``WITHIN`` is four of them
rounded up.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions import expressions as X

LOG_K, WITHIN = 14, 0.035
COUNTED = ("device_id", "error_code", "firmware_version")


def daily_sketches(events: DataFrame, *dimensions: str) -> DataFrame:
    """(day, dimensions, n_events, a sketch of each of ``COUNTED``): one row a day and group."""
    sketches = [F.hll_sketch_agg(c, LOG_K).alias(f"{c}_sketch") for c in COUNTED]
    return events.groupBy(F.to_date("timestamp").alias("day"), *dimensions).agg(X.rows().alias("n_events"), *sketches)


def read_days(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored sketches, or None where there are none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def store_days(events: DataFrame, path: str, *dimensions: str) -> DataFrame:
    """Sketch the days of ``events`` that are not stored yet, store them, and return all.

    A stored day is final: its events are filtered out before they are grouped. Days of a
    restated history have to be deleted first.
    """
    spark = events.sparkSession
    known = read_days(spark, path)
    if known is not None:
        done = [r.day for r in known.select("day").distinct().collect()]  # one row a day
        events = events.where(~F.to_date("timestamp").isin(done)) if done else events
    daily_sketches(events, *dimensions).write.mode("append").partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def distinct_counts(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, n_events, an estimate of each of ``COUNTED``) over all days of ``sketches``."""
    counts = [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(c) for c in COUNTED]
    return sketches.groupBy(*by).agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"), *counts)


def executive_kpis(sketches: DataFrame) -> DataFrame:
    """The columns of ``kpis.executive_kpis``, estimated."""
    return distinct_counts(sketches).select(
        F.col("firmware_version").alias("total_firmware_versions"),
        F.col("device_id").alias("total_devices"),
        F.col("n_events").alias("total_error_events"),
        F.col("error_code").alias("unique_error_codes"),
        X.round_to(X.ratio(F.col("n_events"), F.col("device_id")), 2).alias("errors_per_device"),
    )


def by_dimension(sketches: DataFrame, dimension: str) -> DataFrame:
    """Devices, errors and their ratio per group, as ``kpis.by_model`` has them, estimated."""
    return distinct_counts(sketches, dimension).select(
        dimension,
        F.col("device_id").alias("device_count"),
        F.col("n_events").alias("total_errors"),
        X.round_to(X.ratio(F.col("n_events"), F.col("device_id")), 2).alias("errors_per_device"),
    )


def is_near(estimate: str, exact: str):
    """Whether an estimate is within the stated error of an exact count."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.lit(WITHIN) * F.col(exact)
