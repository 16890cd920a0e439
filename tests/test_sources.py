"""Files, schemas, the model registry and the gate from end to end."""

import json
import os

import pytest
from pyspark.ml import Transformer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.plans import gating, models
from fleetgauge.sources import files, registry
from fleetgauge.sources import fixtures as V


def csv(path, text):
    path.write_text(text)
    return str(path)


def test_raw_tables_take_the_union_of_columns(spark, tmp_path):
    csv(tmp_path / "device_events.csv", "device_id,firmware_version,timestamp,error_code,severity,model,region\n"
        "D1,1.0.0,2024-01-05 10:00:00,E1,low,M,EU\nD2,1.0.0,garbled,E1,low,M,EU\n")  # fmt: skip
    csv(tmp_path / "firmware_releases.csv", "firmware_version,release_date,previous_version,days_since_previous_release\n1.0.0,2024-01-02,9.9.9,7.0\n")
    csv(tmp_path / "support_tickets.csv", "ticket_id,device_id,firmware_version,created_at,error_code,issue_type,resolution,rma_issued\n"
        "TKT_1,D1,1.0.0,2024-01-06 00:00:00,E1,crash,rma,1\n")  # fmt: skip
    raw = files.read_raw(spark, str(tmp_path))
    for name, df in raw.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.SCHEMAS[name]]
    assert raw["support_tickets"].first().tier is None
    assert schemas.required_nulls(raw["device_events"], "device_events").first().timestamp == 1
    files.register(raw["device_events"], "device_events")
    assert files.q(spark, "select count(*) as n from device_events").first().n == 2


def test_feature_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1.0.0", 3, 2.5)], schemas.SCHEMAS["error_rates"])
    files.write_features({"error_rates": df}, str(tmp_path))
    assert files.read_table(spark, str(tmp_path), "error_rates").collect() == df.collect()


def test_feature_folder_and_side_tables(spark, tmp_path):
    for name in schemas.FEATURE_TABLES:
        empty = spark.createDataFrame([], schemas.SCHEMAS[name])
        files.write_table(empty, str(tmp_path / f"{name}.parquet"))
    read = files.read_features(spark, str(tmp_path))
    assert {n: df.count() for n, df in read.items()} == dict.fromkeys(schemas.FEATURE_TABLES, 0)
    csv(tmp_path / "device_inventory.csv", "device_id,model,region,manufacture_date,hardware_revision,cpu_class\n"
        "DEV_0001,M,APAC,2024-01-02,B,high\n")  # fmt: skip
    assert str(files.read_device_inventory(spark, str(tmp_path)).first().manufacture_date) == "2024-01-02"
    csv(tmp_path / "firmware_metadata.csv", "firmware_version,release_date,days_since_previous_release,is_hotfix\n"
        "10.0.1,2024-01-30,,0\n")  # fmt: skip
    row = files.read_firmware_metadata(spark, str(tmp_path)).first()
    assert row.days_since_previous_release is None and row.is_hotfix == 0


def test_defaults_fill_only_known_columns(spark):
    df = spark.createDataFrame([(None, 1.0)], "a string, b double")
    assert tuple(schemas.fill_defaults(df, {"a": "9.9.9", "c": 0}).first()) == ("9.9.9", 1.0)


def test_scored_headers_are_trimmed(spark, tmp_path):
    path = csv(tmp_path / "s.csv", "firmware_version , risk_score,is_hotfix\nv1,0.5,True\n")
    row = files.read_scored(spark, path).first()
    assert (row.risk_score, row.is_hotfix) == (0.5, 1)


def test_events_are_written_by_day_and_pruned(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    events = V.device_events(spark, sf)
    files.write_events(events, path)
    back = spark.read.parquet(path)
    assert back.count() == events.count()
    plan = back.where("event_day = date'2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan


def test_export_needs_its_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    files.export_projection(df, ["b"], str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["b"]
    with pytest.raises(ValueError, match="c"):
        files.export_projection(df, ["c"], str(tmp_path / "no"))


def test_column_helpers(spark):
    df = spark.createDataFrame([("a", 1, True, 2.0)], "version string, n int, flag boolean, x double")
    assert schemas.normalise_version_col(df, ["firmware_version"]).columns[0] == "firmware_version"
    assert schemas.normalise_version_col(df, ["n"]).columns[0] == "version"
    assert schemas.numeric_columns(df) == ["n", "x"]
    assert schemas.select_existing(df, ["x", "zz"]).columns == ["x"]
    assert schemas.rename_key(df, "version", "v").columns[0] == "v"


class FixedModel(Transformer):
    """Gives each row its churn score as the probability of class 1."""

    def _transform(self, df):
        make = F.udf(lambda p: Vectors.dense([float("nan")] * 2 if p is None else [1 - p, p]), VectorUDT())
        return df.withColumn("probability", make("code_churn_score"))


HEADER = "firmware_version,code_churn_score,previous_version_error_rate,avg_device_age_days,is_hotfix,patch_security\n"


def run_gate(spark, tmp_path, text):
    path = csv(tmp_path / "patches.csv", text)
    return gating.score_file(spark, path, FixedModel(), str(tmp_path))


def test_gate_fails_and_writes_the_scored_copy(spark, tmp_path):
    text = HEADER + "v1,0.2,0.02,100,0,1\nv2,0.3,0.05,200,1,0\nv3,0.7,0.15,50,0,1\n"
    code, summary = run_gate(spark, tmp_path, text)
    assert code == 1 and json.loads(summary)["n_high_risk"] == 1
    out = spark.read.option("header", True).csv(str(tmp_path / "scored_patches.csv"))
    assert out.columns == [*HEADER.strip().split(","), "risk_score", "high_risk_flag"]
    assert out.count() == 3


def test_gate_passes_low_risk_and_empty_files(spark, tmp_path):
    assert run_gate(spark, tmp_path, HEADER + "v1,0.49,0.02,100,False,True\n")[0] == 0
    assert run_gate(spark, tmp_path, HEADER)[0] == 0


def test_gate_threshold_and_renamed_version(spark, tmp_path):
    assert run_gate(spark, tmp_path, HEADER.replace("firmware_version", "version") + "v1,0.5,0.02,1,0,0\n")[0] == 1


def test_gate_missing_file_and_columns(spark, tmp_path):
    assert gating.score_file(spark, str(tmp_path / "none.csv"), FixedModel(), str(tmp_path))[0] == 2
    with pytest.raises(ValueError, match="patch_security"):
        run_gate(spark, tmp_path, HEADER.replace(",patch_security", "") + "v1,0.5,0.02,1,0\n")


def test_gate_decides_nothing_on_lost_cells_and_scores(spark, tmp_path):
    good = "v1,0.2,0.02,100,0,1\n"
    for bad in ("v2,abc,0.02,100,0,1\n", "v2,0.1,0.02,100,maybe,1\n", "v2,,0.02,100,0,1\n"):
        code, reason = run_gate(spark, tmp_path, HEADER + good + bad)
        assert code == 2 and "1" in reason


def test_csv_cells_hold_breaks_and_quotes(spark, tmp_path):
    path = csv(tmp_path / "q.csv", 'a,b\n"line one\nline two",1\n"said ""no"", left",2\n')
    assert [tuple(r) for r in files.read_csv(spark, path).collect()] == [("line one\nline two", "1"), ('said "no", left', "2")]


def test_boosting_goes_on_past_small_gains(spark):
    from pyspark.ml.regression import GBTRegressor

    df = spark.range(300).select(
        F.col("id").cast("string").alias("firmware_version"),
        ((F.col("id") % 97) * 3 + F.col("id") % 7).cast("double").alias("error_rate_per_10k"),
        *[((F.col("id") * k) % 97 / 97.0).alias(c) for k, c in zip((1, 5, 11, 17, 23), schemas_features())],
    )
    ours = models.train_gbt_regressor(df, rounds=16, step=0.004).stages[-1]
    stopping = GBTRegressor(labelCol="error_rate_per_10k", maxIter=16, stepSize=0.004, seed=42, validationIndicatorCol="is_validation")
    usual = stopping.fit(models.assemble(models.with_validation(df, "firmware_version")))
    assert ours.getNumTrees > usual.getNumTrees


def test_renewal_saves_before_it_promotes(spark, rows, tmp_path):
    root = str(tmp_path / "models")
    old = rows.where("code_churn_score < 0.1")
    new = rows.where("code_churn_score >= 0.1")
    assert models.renew(old, old, root) is None and registry.active_version(spark, root) is None
    assert models.renew(old, new, root, rounds=3, step=0.1) == "v001"
    assert registry.active_version(spark, root) == "v001" and registry.next_version(spark, root) == "v002"


@pytest.fixture(scope="module")
def rows(spark, sf):
    df = V.patch_features(spark, sf).select("firmware_version", "error_rate_per_10k", *schemas_features())
    return models.add_label(df).cache()


def schemas_features():
    from fleetgauge.settings import RISK_FEATURES

    return RISK_FEATURES


def test_label_marks_the_top_quarter(rows):
    assert rows.agg(F.avg("label")).first()[0] == pytest.approx(0.25, abs=0.01)


def test_splits_are_stable_and_whole(rows):
    train, test = models.split(rows, "firmware_version")
    again = models.split(rows.repartition(5), "firmware_version")[1]
    assert train.count() + test.count() == rows.count()
    assert {r[0] for r in test.select("firmware_version").collect()} == {
        r[0] for r in again.select("firmware_version").collect()
    }
    kept, held = models.split_stratified(rows, "firmware_version")
    assert kept.count() + held.count() == rows.count()
    for label in (0, 1):
        all_rows = rows.where(F.col("label") == label).count()
        assert held.where(F.col("label") == label).count() == pytest.approx(all_rows * 0.2, abs=1.5)


def test_models_learn_save_and_score_alike(spark, rows, tmp_path):
    train, test = models.split(rows, "firmware_version")
    model = models.train_gbt_classifier(train, rounds=10)
    scored = models.score(test, model)
    assert scored.where("risk_score < 0 or risk_score > 1").count() == 0
    assert models.roc_auc(scored).first().roc_auc > 0.93
    root = str(tmp_path / "models")
    registry.save_model(model, root, "v001")
    registry.save_model(model, root, "v002")
    loaded = registry.load_model(spark, str(tmp_path / "elsewhere"), "v002", fallback=root)
    left = {r[0]: r[1] for r in scored.select("firmware_version", "risk_score").collect()}
    right = models.score(test, loaded).select("firmware_version", "risk_score").collect()
    assert {r[0]: r[1] for r in right} == pytest.approx(left)
    assert registry.active_version(spark, root) is None
    for version in ("v001", "v002", "v001"):
        registry.promote(spark, root, version)
        assert registry.active_version(spark, root) == version
    assert os.path.isdir(os.path.join(root, "v002"))
    with pytest.raises(FileNotFoundError):
        registry.promote(spark, root, "v009")
    with pytest.raises(FileNotFoundError):
        registry.load_model(spark, root, "v009", fallback=str(tmp_path))


def test_forest_regressor_and_importance(spark, rows):
    train, test = models.split(rows, "firmware_version")
    model = models.train_rf_regressor(train, trees=20)
    metrics = models.regression_metrics(model.transform(models.cast_features(test)), "error_rate_per_10k").first()
    assert metrics.r2 > 0.78
    found = models.feature_importance(spark, model).collect()
    weights = [r.importance for r in found]
    assert weights == sorted(weights, reverse=True) and sum(weights) == pytest.approx(1.0)
    # The label is made of these two and a little noise.
    assert {r.feature for r in found[:2]} == {"code_churn_score", "is_hotfix"}
