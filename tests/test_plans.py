"""Queries on hand-made frames: one test per decision about their meaning."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fleetgauge import settings as S
from fleetgauge.plans import drift, features, kpis, models, scoring, stats
from fleetgauge.sources import fixtures as V

EVENT = "event_id bigint, device_id string, error_code string, timestamp timestamp_ntz, firmware_version string"
TICKET = "ticket_id string, device_id string, error_code string, created_at timestamp_ntz, tier int, rma_issued int"
DAY = dt.datetime(2024, 6, 15)


def at(days, hours=0):
    return DAY + dt.timedelta(days=days, hours=hours)


def events(spark, data):
    return spark.createDataFrame(data, EVENT)


def daily(spark, counts, code="E1"):
    """Events with the given number per day, days numbered from 0."""
    out = []
    for day, n in counts.items():
        out += [(len(out) + i, "d", code, at(day, 1), "1.0.0") for i in range(n)]
    return events(spark, out)


def test_spike_window_counts_rows_or_calendar_days(spark):
    df = daily(spark, {0: 2, 1: 2, 20: 3})
    by_rows = {r.day: r.trailing_7d_avg for r in features.error_spikes(df).collect()}
    assert by_rows == {at(20).date(): 2.0}
    assert features.error_spikes(df, calendar=True).count() == 0


def test_spike_compares_the_rounded_ratio(spark):
    df = daily(spark, {0: 200, 1: 299})
    assert [r.spike_ratio for r in features.error_spikes(df).collect()] == [1.5]
    assert features.error_spikes(daily(spark, {0: 200, 1: 298})).count() == 0


def test_pre_post_window_edges(spark):
    data = [(i, "d", "E1", at(d, 5), "0.9.0") for i, d in enumerate([-15, -14, -1, 0, 0, 3, 14, 14, 15])]
    releases = spark.createDataFrame([("1.0.0", DAY.date())], "firmware_version string, release_date date")
    row = features.pre_post_errors(releases, events(spark, data)).first()
    assert (row.pre_errors, row.post_errors, row.delta_errors, row.post_pre_ratio) == (2, 5, 3, 2.5)
    assert features.pre_post_errors(releases, events(spark, data), minimum=6).count() == 0
    assert features.pre_post_errors(releases, events(spark, data), same_version=True).count() == 0


def test_pre_post_equals_range_join(spark, sf):
    from fleetgauge.sources import fixtures as V

    ev, rel = V.device_events(spark, sf), V.firmware_releases(spark, sf)
    day = F.to_date("timestamp")
    plain = (
        rel.alias("r")
        .join(ev.alias("e"), day.between(F.date_add("release_date", -14), F.date_add("release_date", 14)))
        .groupBy(F.col("r.firmware_version"), "error_code")
        .agg(
            F.count_if(day < F.col("release_date")).alias("pre"),
            F.count_if(day >= F.col("release_date")).alias("post"),
        )
        .where("post >= 5")
    )
    found = features.pre_post_errors(rel, ev)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[:4] for r in found.collect()} == {tuple(r) for r in plain.collect()}


def test_stability_keeps_the_half_day_before_release(spark):
    data = [(0, "d", "E", at(-1, 12), "1.0.0"), (1, "d", "E", at(-1), "1.0.0"), (2, "d", "E", at(2, 3), "1.0.0")]
    releases = spark.createDataFrame([("1.0.0", DAY.date())], "firmware_version string, release_date date")
    found = features.stability_curves(events(spark, data), releases)
    assert [(r.days_since_release, r.error_count) for r in found.collect()] == [(0, 1), (2, 1)]


def test_attribution_ties_repeats_and_misses(spark):
    ev = events(
        spark,
        [
            (1, "d1", "E", at(0, 1), "1.0.0"),
            (2, "d1", "E", at(0, 1), "1.0.1"),
            (3, "d1", "E", at(5), "1.0.2"),
            (4, "d2", "E", at(1), "2.0.0"),
        ],
    )
    tk = spark.createDataFrame(
        [
            ("t1", "d1", "E", at(1), 1, 1),  # two events at one time: the later id
            ("t2", "d1", "E", at(5), 1, 0),  # event at the very moment of the ticket
            ("t3", "d1", "E", at(-1), 1, 0),  # no event yet
            ("t4", "d1", "E", at(1), 1, 1),  # repeated id, older match
            ("t4", "d2", "E", at(2), 1, 0),  # repeated id, newer match
        ],
        TICKET,
    )
    found = {r.ticket_id: (r.firmware_version, r.rma_issued) for r in features.attribute_tickets(tk, ev).collect()}
    assert found == {"t1": ("1.0.1", 1), "t2": ("1.0.2", 0), "t4": ("2.0.0", 0)}


def _fan_out(spark):
    ev = events(
        spark,
        [(i, "d1", "E", at(0), "1.0.0") for i in range(3)]
        + [(10, "d2", "E", at(0), "1.0.0"), (11, "d2", "F", at(0), "2.0.0"), (12, "d3", "F", at(0), "1.0.0")],
    )
    tk = spark.createDataFrame(
        [("a", "d1", "E", at(1), 2, 1), ("b", "d1", "E", at(1), 3, 1), ("a", "d2", "E", at(1), 1, 0),
         ("a", "d2", "F", at(1), 1, 1), ("c", "d9", "E", at(1), 1, 1)],
        TICKET,
    )
    return ev, tk


def _joined(ev, tk, how):
    return ev.alias("e").join(
        tk.alias("t"),
        (F.col("e.device_id") == F.col("t.device_id")) & (F.col("e.error_code") == F.col("t.error_code")),
        how,
    )


def test_joined_rma_rate_equals_the_join(spark):
    ev, tk = _fan_out(spark)
    plain = (
        _joined(ev, tk, "inner")
        .groupBy("firmware_version")
        .agg(F.count_distinct("ticket_id").alias("t"), F.sum("rma_issued").alias("r"))
    )
    found = kpis.rma_rate_joined(ev, tk, minimum=1)
    assert {(r[0], r[1], r[2]) for r in found.collect()} == {tuple(r) for r in plain.collect()}
    assert max(r.rma_rate_pct for r in found.collect()) == 300.0


def test_health_equals_the_join(spark):
    ev, tk = _fan_out(spark)
    ev = ev.unionByName(events(spark, [(20, "d5", "G", at(0), "3.0.0")]))
    plain = (
        _joined(ev, tk, "left")
        .groupBy("firmware_version")
        .agg(
            (F.count("*") / F.count_distinct("e.device_id")).alias("e"),
            F.coalesce(F.sum("rma_issued") / F.nullif(F.count("ticket_id"), F.lit(0)), F.lit(0.0)).alias("r"),
            F.coalesce(F.avg("tier"), F.lit(1.0)).alias("t"),
        )
    )
    expected = {
        r[0]: round(100 - (r.e * 30 + r.r * 40 + (r.t - 1) / 2 * 30), 1) for r in plain.collect()
    }
    found = {r.firmware_version: r for r in kpis.release_health(ev, tk).collect()}
    assert {k: r.health_score for k, r in found.items()} == pytest.approx(expected)
    lone = found["3.0.0"]
    assert (lone.rma_rate, lone.avg_support_tier, lone.health_score) == (0.0, 1.0, 70.0)


def test_regressions_by_text_and_consecutive(spark):
    data = []
    for version, n in {"10.9.0": 1, "10.10.0": 3, "11.0.0": 6}.items():
        data += [(len(data) + i, "d", "E", at(0), version) for i in range(n)]
    ev = events(spark, data)
    pairs = {(r.current_version, r.previous_version): r.status for r in kpis.version_regressions(ev).collect()}
    assert pairs == {
        ("10.9.0", "10.10.0"): "IMPROVEMENT",
        ("11.0.0", "10.10.0"): "REGRESSION",
        ("11.0.0", "10.9.0"): "REGRESSION",
    }
    steps = [(r.current_version, r.previous_version) for r in kpis.version_regressions(ev, consecutive=True).collect()]
    assert sorted(steps) == [("10.10.0", "10.9.0"), ("11.0.0", "10.10.0")]


def test_repeated_releases_multiply_totals_like_the_join(spark):
    ev = events(spark, [(i, "d", "E", at(0), "1.0.0") for i in range(2)] + [(9, "d", "E", at(0), "2.0.0")])
    day = DAY.date()
    rel = spark.createDataFrame([("1.0.0", day), ("1.0.0", day)], "firmware_version string, release_date date")
    found = {r.firmware_version: r.total_errors for r in kpis.error_rate_by_firmware(ev, rel).collect()}
    assert found == {"1.0.0": 4, "2.0.0": 1}


def test_top_rma_falls_back_to_volume(spark):
    schema = "firmware_version string, tickets bigint, rmas bigint, rma_rate double"
    few = spark.createDataFrame([("a", 1, 1, 1.0), ("b", 3, 0, 0.0)], schema)
    assert [r.firmware_version for r in features.top_rma(few).collect()] == ["b", "a"]
    some = few.unionByName(spark.createDataFrame([("c", 5, 1, 0.2)], schema))
    assert [r.firmware_version for r in features.top_rma(some).collect()] == ["c"]
    assert features.top_rma(few.limit(0)).count() == 0


def test_merge_fills_measured_columns_only(spark):
    left = spark.createDataFrame([("a", 5, None), ("b", 6, 0.5)], "firmware_version string, error_events bigint, rma_rate double")
    rates = spark.createDataFrame([("a", 9, 1.5)], "firmware_version string, error_events bigint, error_rate_per_10k double")
    rma = spark.createDataFrame([("a", 2, 1, 0.5)], "firmware_version string, tickets bigint, rmas bigint, rma_rate double")
    found = {r.firmware_version: r for r in features.merge_features(left, rates, rma).collect()}
    assert found["b"].error_events_sql == 0 and found["b"].rma_rate_sql == 0.0
    assert found["a"].rma_rate is None and found["a"].error_events == 5


def test_training_table_picks_the_ratio(spark):
    left = spark.createDataFrame([("a", 3.0, 10.0), ("b", 4.0, 11.0)], "firmware_version string, post_pre_ratio double, error_rate_per_10k double")
    pre_post = spark.createDataFrame(
        [("a", "E", 1, 5, 4, 5.0), ("a", "F", 0, 6, 6, None)],
        "release_version string, error_code string, pre_errors bigint, post_errors bigint, delta_errors bigint, post_pre_ratio double",
    )
    rma = spark.createDataFrame([("a", 2, 1, 0.5)], "firmware_version string, tickets bigint, rmas bigint, rma_rate double")
    ratio = lambda **o: {r.firmware_version: r.regression_ratio for r in features.training_table(left, pre_post, rma, **o).collect()}
    assert ratio() == {"a": 5.0, "b": 1.0}
    assert ratio(ratio_from="synth") == {"a": 3.0, "b": 4.0}


def test_first_release_defaults(spark):
    data = [("A", "1.0.0", DAY.date(), 1), ("A", "1.0.1", DAY.date(), 2), ("A", "1.0.2", at(4).date(), 3)]
    df = spark.createDataFrame(data, "product_line string, firmware_version string, release_date date, release_seq bigint")
    gaps = features.release_gaps(df).withColumn("error_rate_per_10k", F.col("release_seq") * 10.0)
    found = features.add_previous_release(gaps).orderBy("release_seq").collect()
    assert [r.previous_version for r in found] == ["9.9.9", "1.0.0", "1.0.1"]
    assert [r.days_since_previous_release for r in found] == [7.0, 0.0, 4.0]
    assert [r.previous_version_error_rate for r in found] == [0.0, 10.0, 20.0]


@pytest.mark.parametrize("complete", [False, True])
def test_spearman_equals_pandas(spark, complete):
    import pandas as pd

    data = [(float(i % 7), float((i * 37) % 50), i % 3 == 0, float(i * i % 11)) for i in range(120)]
    pdf = pd.DataFrame(data, columns=["a", "b", "flag", "y"])
    if not complete:
        pdf.loc[3:9, "a"] = None
    df = spark.createDataFrame(
        [tuple(None if v != v else v for v in r) for r in pdf.astype(object).itertuples(index=False)],
        "a double, b double, flag boolean, y double",
    )
    expected = pdf.assign(flag=pdf.flag.astype(int)).corr(method="spearman")["y"]
    found = stats.signal_audit(df, ["a", "b", "flag", "absent"], "y", complete=complete).collect()
    assert {r.feature: r.spearman for r in found} == pytest.approx({c: expected[c] for c in ("a", "b", "flag")})
    assert [r.feature for r in stats.signal_audit(df, ["a", "flag"], "y", drop_booleans=True).collect()] == ["a"]


def test_histogram_closes_the_last_bin_and_handles_constants(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.9,), (10.0,), (None,)], "v double")
    assert [(r.bin, r.n) for r in stats.histogram(df, "v", 10).collect()] == [(0, 1), (1, 1), (9, 2)]
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r.bin_start, r.n) for r in stats.histogram(same, "v", 2).collect()] == [(2.0, 2)]


def test_out_of_order_across_blocks(spark):
    big = 1 << 20
    data = [("A", 1, at(0).date()), ("A", 2, at(1).date()), ("A", big + 1, at(0).date()), ("A", big + 2, at(3).date())]
    df = spark.createDataFrame(data, "line string, seq bigint, d date")
    assert stats.out_of_order(df, "line", "seq", "d").first().steps_back == 1


SCORED = "firmware_version string, code_churn_score double, risk_score double, high_risk_flag int, avg_device_age_days double"


def test_gate_verdicts(spark):
    df = spark.createDataFrame([("v1", 0.1, 0.2, 0, 1.0), ("v2", 0.2, 0.3, 0, 1.0), ("v3", 0.3, 0.7, 1, 1.0)], SCORED)
    row = scoring.gate(df).first()
    assert (row.n_high_risk, row.verdict, row.exit_code) == (1, "FAIL", 1)
    assert row.avg_risk_score == pytest.approx(0.4)
    assert scoring.gate(df.where("high_risk_flag = 0")).first().verdict == "PASS"
    empty = scoring.gate(df.limit(0)).first()
    assert (empty.verdict, empty.exit_code, empty.avg_risk_score) == ("PASS", 0, None)
    text = scoring.gate(df).select(scoring.summary_json("in.csv")).first()[0]
    assert json.loads(text)["n_high_risk"] == 1


def test_flag_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.49999,), (None,)], "risk_score double")
    assert [r.high_risk_flag for r in scoring.flag_high_risk(df).collect()] == [1, 0, 0]


def test_qa_and_monitoring_scores(spark):
    df = spark.createDataFrame([("v1", 0.87, 1.0, 1, 700.0), ("v2", 0.0, 0.5, 1, 599.0)], SCORED)
    qa = {r.firmware_version: r for r in scoring.qa_sheet(df).collect()}
    assert qa["v1"].QA_bucket == "Critical" and qa["v1"].churn_norm == pytest.approx(1.0, abs=1e-5)
    assert qa["v2"].churn_norm == 0.0 and qa["v2"].QA_priority_score == pytest.approx(0.3)
    ages = df.unionByName(df)
    sheet = {r.firmware_version: r for r in scoring.monitoring_sheet(scoring.qa_sheet(df), ages).collect()}
    assert len(sheet) == 2 and sheet["v1"].monitoring_tier == "Immediate Monitoring"
    assert (sheet["v2"].older_device_flag, sheet["v2"].monitoring_tier) == (0, "Standard Monitoring")


def test_scoring_guards(spark):
    df = spark.createDataFrame([("v1", 0.1)], "firmware_version string, risk_score double")
    with pytest.raises(ValueError, match="code_churn_score"):
        scoring.qa_priority(df)
    with pytest.raises(ValueError):
        scoring.normalise_churn(df, 0.5, 0.5)


def test_scores_leave_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("v1", 0.87, 1.0, 1, 700.0)], SCORED)
    plan = scoring.monitoring_sheet(scoring.qa_sheet(df), df)._jdf.queryExecution().executedPlan()
    assert "Python" not in plan.toString()


def test_qa_hours(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "high_risk_flag int")
    row = scoring.qa_hours(df).first()
    assert tuple(row) == (7.0, 10.0, 3.0, 30.0)
    assert scoring.qa_hours(df.limit(0)).first().pct_saved == 0.0


def test_drift_and_trigger(spark):
    schema = "code_churn_score double, flat double"
    old = spark.createDataFrame([(1.0, 0.0), (1.0, 0.0)], schema)
    new = spark.createDataFrame([(1.2, 5.0)], schema)
    report = drift.drift_report(old, new, ["code_churn_score", "flat"])
    found = {r.feature: r.drift_pct for r in report.collect()}
    assert found == {"code_churn_score": pytest.approx(20.0), "flat": 0.0}
    assert drift.should_retrain(report).first().retrain
    assert not drift.should_retrain(report, threshold=25.0).first().retrain
    assert drift.should_retrain(report, threshold=25.0, accuracy_drop=0.1).first().retrain
    assert drift.should_retrain(report, threshold=25.0, new_rows=50, min_new_rows=50).first().retrain
    assert not drift.should_retrain(drift.drift_report(old, old, ["flat"])).first().retrain


def test_sample_is_stable_and_marked(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("firmware_version"))
    one = {r[0] for r in drift.sample_n(df, "firmware_version").collect()}
    two = {r[0] for r in drift.sample_n(df.repartition(7), "firmware_version").collect()}
    assert len(one) == 50 and one == two
    assert all(r[0].endswith(".NEW") for r in drift.mark_new(df).collect())
    wider = drift.append_new(df, df.withColumn("x", F.lit(1)))
    assert wider.count() == 1000 and wider.where("x is null").count() == 500


def test_classification_measures(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1)]
    df = spark.createDataFrame(rows, "label int, predicted int, risk_score double")
    row = models.classification_metrics(df).first()
    assert (row.accuracy, row.roc_auc) == (0.6, pytest.approx(4.5 / 6))
    report = {r["class"]: r for r in models.classification_report(df).collect()}
    assert (report[1].precision, report[1].recall, report[1].f1, report[1].support) == (0.5, 0.5, 0.5, 2)
    cells = {r.label: (r.predicted_low, r.predicted_high) for r in models.confusion_matrix(df).collect()}
    assert cells == {0: (2, 1), 1: (1, 1)}
    curve = [(r.threshold, r.fpr, r.tpr) for r in models.roc_curve(df).collect()]
    assert curve[0] == (0.9, 0.0, 0.5) and curve[-1] == (0.1, 1.0, 1.0)


def test_settings_are_the_published_ones():
    assert S.RISK_FEATURES == [
        "code_churn_score", "previous_version_error_rate", "avg_device_age_days", "is_hotfix", "patch_security",
    ]
    assert all(isinstance(c, str) for c in S.RISK_FEATURES)
    assert S.RISK_THRESHOLD == 0.50 and 0 <= S.RISK_THRESHOLD <= 1


def test_hot_key_forms_no_pairs(spark):
    """60,000 events and 20,000 tickets of one device and code: over 10^9 pairs if joined."""
    n, m = 60_000, 20_000
    base = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")

    def later(seconds):
        return base + F.make_dt_interval(secs=seconds)

    ids = F.col("id")
    key = [F.lit("hot").alias("device_id"), F.lit("E").alias("error_code")]
    ev = spark.range(n).select(
        ids.alias("event_id"),
        *key,
        later(ids).alias("timestamp"),
        F.concat(F.lit("1.0."), (ids % 3).cast("string")).alias("firmware_version"),
    )
    tk = spark.range(m).select(
        ids.cast("string").alias("ticket_id"),
        *key,
        later(ids * 3 + 1).alias("created_at"),
        F.lit(2).alias("tier"),
        (ids % 2).cast("int").alias("rma_issued"),
    )
    assert [tuple(r) for r in features.rma_by_firmware(tk, ev).collect()] == [("1.0.1", m, m // 2, 0.5)]
    joined = {r.firmware_version: (r.support_tickets, r.rma_count) for r in kpis.rma_rate_joined(ev, tk).collect()}
    assert joined == {f"1.0.{i}": (m, n // 3 * (m // 2)) for i in range(3)}
    health = {r.firmware_version: (r.error_rate, r.rma_rate) for r in kpis.release_health(ev, tk).collect()}
    assert health == {f"1.0.{i}": (n / 3 * m, 0.5) for i in range(3)}


def test_null_counts_and_shares(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "c string, n int")
    assert tuple(stats.null_counts(df).first()) == (1, 1)
    assert [(r.c, r.n, r.share) for r in stats.value_counts(df, "c", normalize=True).collect()] == [("a", 2, 1.0)]


def test_patches_without_place_keep_their_rows(spark):
    rows = [("a", "2024-01-01", 1), ("a", "2024-01-05", 2), (None, "2024-01-06", 3), ("a", None, 4), (None, None, None)]
    df = spark.createDataFrame(rows, "product_line string, d string, release_seq long")
    df = df.select("product_line", F.to_date("d").alias("release_date"), "release_seq").withColumns(
        {"firmware_version": F.col("release_seq").cast("string"), "error_rate_per_10k": F.col("release_seq") * 1.0}
    )
    found = {r.release_seq: r for r in features.add_previous_release(features.release_gaps(df)).collect()}
    assert {k: r.days_since_previous_release for k, r in found.items()} == {1: 7.0, 2: 4.0, 3: 7.0, 4: 7.0, None: 7.0}
    assert {k: r.previous_version for k, r in found.items()} == {1: "9.9.9", 2: "1", 3: "9.9.9", 4: "9.9.9", None: "9.9.9"}


def test_consecutive_versions_of_any_form(spark):
    versions = ["10.9.0", "10.10.0", "10.10", "10.10.0-rc1", "10.10.0.1", "10.10.0.2", "9.1.1", "11.0.0", "beta"]
    rows = [(v, f"d{i}", f"e{j}") for k, v in enumerate(versions) for i in range(1) for j in range(1 + 2 * (k + 1))]
    events = spark.createDataFrame(rows, "firmware_version string, device_id string, error_code string")
    found = kpis.version_regressions(events, consecutive=True, min_change=0.0).collect()
    order = ["beta", "9.1.1", "10.9.0", "10.10", "10.10.0", "10.10.0.1", "10.10.0.2", "10.10.0-rc1", "11.0.0"]
    assert {(r.previous_version, r.current_version) for r in found} == set(zip(order, order[1:]))


def test_gate_counts_patches_without_score(spark):
    df = spark.createDataFrame([(0.9, 1), (None, 0), (float("nan"), 1)], "risk_score double, high_risk_flag int")
    row = scoring.gate(df).first()
    assert (row.n_unscored, row.verdict, row.exit_code) == (2, "ERROR", 2)


def test_nan_scores_are_seen(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, float("nan"))], "label int, risk_score double")
    with pytest.raises(Exception, match="NaN"):
        models.roc_auc(df).collect()
    found = stats.cumulative_share(df, "risk_score").collect()
    assert [r.cumulative_pct for r in found] == [pytest.approx(90.0), pytest.approx(100.0), None]
    assert found[2].n == 1 and found[2]["rank"] is None


def test_no_distinct_count_expands_raw_events(spark, sf):
    events = V.device_events(spark, sf)
    for df in (kpis.executive_kpis(events), features.cardinalities(events), kpis.error_code_share(events), kpis.weekly_trend(events), kpis.by_model(events)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        below = plan.split("Expand", 1)[1] if "Expand" in plan else plan
        assert "Aggregate" in below
