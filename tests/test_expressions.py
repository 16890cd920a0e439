"""Expressions on small frames with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetgauge.functions import expressions as X


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_round_is_decimal_half_up(spark):
    rows = [(1.005,), (2.675,), (-0.25,), (12.5,)]
    assert values(spark, X.round_to(F.col("x"), 2), rows, "x double") == [1.01, 2.68, -0.25, 12.5]


def test_ratio_by_zero_is_null(spark):
    assert values(spark, X.ratio(F.col("a"), F.col("b")), [(1, 0), (1, 4)], "a int, b int") == [None, 0.25]


def test_year_week_matches_python(spark):
    days = [(dt.datetime(2019, 1, 1) + dt.timedelta(days=i),) for i in range(2190)]
    found = values(spark, X.year_week(F.col("t")), days, "t timestamp_ntz")
    assert found == [d[0].strftime("%Y-%W") for d in days]


def test_bucket_edges(spark):
    rows = [(0.3999,), (0.40,), (0.65,), (0.85,), (0.90,), (None,)]
    assert values(spark, X.qa_bucket(F.col("s")), rows, "s double") == [
        "Low", "Medium", "High", "Critical", "Critical", "Low",
    ]
    assert values(spark, X.monitoring_tier(F.col("s")), rows, "s double") == [
        "Standard Monitoring", "Standard Monitoring", "Enhanced Monitoring",
        "Enhanced Monitoring", "Immediate Monitoring", "Standard Monitoring",
    ]


def test_flag_is_zero_for_null_and_one_at_the_threshold(spark):
    rows = [(0.49,), (0.5,), (None,)]
    assert values(spark, X.flag_ge(F.col("s"), 0.5), rows, "s double") == [0, 1, 0]


def test_clip_keeps_null(spark):
    rows = [(-1.0,), (0.5,), (2.0,), (None,)]
    assert values(spark, X.clip(F.col("s"), 0.0, 1.0), rows, "s double") == [0.0, 0.5, 1.0, None]


def test_risk_tier_and_status_bounds_are_strict(spark):
    rows = [(3.0, 2.0), (3.1, 2.0), (2.0, 2.0), (2.1, 2.0)]
    tiers = values(spark, X.risk_tier(F.col("r"), F.col("a")), rows, "r double, a double")
    assert tiers == ["MODERATE", "HIGH RISK", "LOW", "MODERATE"]
    rows = [(1.3, 1.0), (0.7, 1.0), (1.0, 1.0)]
    status = values(spark, X.regression_status(F.col("c"), F.col("p")), rows, "c double, p double")
    assert status == ["REGRESSION", "IMPROVEMENT", "STABLE"]


def test_release_period_edges(spark):
    release = dt.date(2024, 6, 15)
    rows = [(release + dt.timedelta(days=d), release) for d in (-15, -14, -1, 0, 14, 15)]
    found = values(spark, X.release_period(F.col("d"), F.col("r")), rows, "d date, r date")
    assert found == [None, "pre", "pre", "post", "post", None]


def test_days_are_cut_toward_zero(spark):
    release = dt.date(2024, 6, 15)
    at = [dt.datetime(2024, 6, 14, 12), dt.datetime(2024, 6, 14), dt.datetime(2024, 6, 13, 12),
          dt.datetime(2024, 6, 15), dt.datetime(2024, 6, 16, 23)]
    ts = F.col("t")
    col = X.days_toward_zero(F.to_date(ts), X.is_midnight(ts), F.col("r"))
    assert values(spark, col, [(t, release) for t in at], "t timestamp_ntz, r date") == [0, -1, -1, 0, 1]


def test_version_key_orders_numerically(spark):
    rows = [("10.10.0",), ("10.9.0",), ("9.9.9",)]
    df = spark.createDataFrame(rows, "v string").orderBy(X.version_key(F.col("v")))
    assert [r.v for r in df.collect()] == ["9.9.9", "10.9.0", "10.10.0"]


def test_churn_and_smoothed_ratio(spark):
    rows = [(8436, 466, 90), (100, 10, 0)]
    col = X.churn_score(F.col("l"), F.col("f"), F.col("g"))
    found = values(spark, col, rows, "l int, f int, g int")
    assert found == [pytest.approx(0.27986666666666665), pytest.approx(0.055)]
    assert values(spark, X.smoothed_ratio(F.col("a"), F.col("b")), [(5, 0)], "a int, b int") == [6.0]
