"""Distinct counts from stored daily sketches against exact ones."""

import os

from pyspark.sql import functions as F

from fleetgauge.plans import kpis, sketches
from fleetgauge.sources import fixtures as V


def test_estimates_are_within_the_stated_error(spark):
    many = spark.range(120_000)
    events = many.select(
        F.concat(F.lit("d"), F.col("id") % 40_000).alias("device_id"), F.concat(F.lit("e"), F.col("id") % 37).alias("error_code"),
        F.concat(F.lit("v"), F.col("id") % 900).alias("firmware_version"), (F.col("id") % 3).alias("model"),
        F.timestamp_seconds(F.col("id") * 20).cast("timestamp_ntz").alias("timestamp"),
    )
    days = sketches.daily_sketches(events, "model")
    found, exact = sketches.executive_kpis(days).first(), kpis.executive_kpis(events).first()
    for name in ("total_devices", "unique_error_codes", "total_firmware_versions"):
        assert abs(found[name] - exact[name]) <= sketches.WITHIN * exact[name]
    assert found.total_error_events == 120_000 and days.count() > 20
    groups = {r.model: r for r in sketches.by_dimension(days, "model").collect()}
    assert set(groups) == {0, 1, 2} and all(r.total_errors == 40_000 for r in groups.values())


def test_stored_days_are_used_again(spark, sf, tmp_path):
    events, path = V.device_events(spark, sf), str(tmp_path / "days")
    cut = events.agg(F.percentile_approx(F.unix_date(F.to_date("timestamp")), 0.5)).first()[0]
    assert sketches.read_days(spark, path) is None
    old = events.where(F.unix_date(F.to_date("timestamp")) <= cut)
    sketches.store_days(old, path, "model")
    before = {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if "day=" in d}
    # stored days are not computed again, so changed events of these change nothing
    changed = events.withColumn("device_id", F.when(F.unix_date(F.to_date("timestamp")) <= cut, "other").otherwise(F.col("device_id")))
    whole = sketches.store_days(changed, path, "model")
    assert all(os.path.getmtime(f) == t for f, t in before.items()) and before
    found, exact = sketches.executive_kpis(whole).first(), kpis.executive_kpis(events).first()
    assert found.total_error_events == exact.total_error_events
    assert abs(found.total_devices - exact.total_devices) <= max(1, sketches.WITHIN * exact.total_devices)
    assert sketches.store_days(events, path, "model").count() == whole.count()
    assert sketches.executive_kpis(whole.limit(0)).first().total_error_events == 0
