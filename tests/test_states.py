"""Drift from stored states, and checks on a write's own pass."""

from pyspark.sql import functions as F

from fleetgauge.plans import drift, stats
from fleetgauge.sources import fixtures as V
from fleetgauge.sources.shared import write_shared


def test_three_appends_equal_the_whole_report(spark, sf):
    rows = V.patch_features(spark, sf)
    old, new = V.history(rows), V.new_patches(rows)
    state = None
    for k in range(3):
        batch = drift.moments(old.where(F.pmod("release_seq", F.lit(3)) == k))
        state = write_shared(batch if state is None else drift.merge_moments(state, batch))
    found = drift.drift_from_moments(state, drift.moments(new))
    expected = {r.feature: r for r in drift.drift_report(old, new).collect()}
    for r in found.collect():
        own = expected.pop(r.feature)
        assert abs(r.history_mean - own.history_mean) < 1e-6 and abs(r.drift_pct - own.drift_pct) < 1e-6 and r.drifted == own.drifted
    assert not expected
    plan = drift.drift_from_moments(state, write_shared(drift.moments(new)))._jdf.queryExecution().executedPlan().toString()
    assert "o_orderkey" not in plan  # history is not scanned
    empty = drift.drift_from_moments(drift.moments(old.limit(0)), drift.moments(new)).collect()
    assert all(r.history_mean is None and not r.drifted for r in empty)


def test_checks_are_those_of_the_report_in_one_scan(spark, sf, tmp_path):
    good = V.patch_features(spark, sf)
    bad = good.withColumn("error_rate_per_10k", F.when(F.col("release_seq") % 7 != 0, F.col("error_rate_per_10k")))
    bad = bad.withColumn("rma_rate", F.when(F.col("release_seq") % 5 == 0, 1.5).otherwise(F.col("rma_rate")))
    for k, rows in enumerate((good, bad)):
        seen = stats.write_checked(rows, str(tmp_path / str(k)))
        report = {r.check: r.violations for r in stats.quality_report(rows).collect()}
        assert {n: seen[n] for n in report if n in seen} == {n: v for n, v in report.items() if n != "dates_in_order"}
        assert seen["rows"] == rows.count() == spark.read.parquet(str(tmp_path / str(k))).count()
        assert abs(seen["versions"] - seen["rows"]) <= 0.05 * seen["rows"]
    flagged = V.scored_patches(spark, sf).withColumn("rma_rate", F.lit(0.5))
    assert stats.write_checked(flagged, str(tmp_path / "f"))["n_high_risk"] == flagged.where("high_risk_flag = 1").count()
