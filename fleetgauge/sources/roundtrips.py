"""Queries that write tables of a data folder and read them again through the readers.

Each writes to a new folder below the shared one, so building the query runs jobs.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import settings as S
from fleetgauge import schemas
from fleetgauge.functions import expressions as X
from fleetgauge.plans import features, models, scoring, stats
from fleetgauge.sources import files, registry
from fleetgauge.sources import fixtures as V
from fleetgauge.sources.shared import shared_folder


def _folder(spark: SparkSession) -> str:
    return posixpath.join(shared_folder(spark), f"files-{uuid.uuid4().hex}")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: X.round_to(F.col(c), 6) for c in columns})


def raw_tables(spark: SparkSession, d: str) -> DataFrame:
    """Key, time and one text of every row of the raw tables, by way of CSV files."""
    folder = _folder(spark)
    given = {
        "device_events": V.regional_events(spark, d),
        "firmware_releases": V.firmware_releases(spark, d),
        "support_tickets": V.support_tickets(spark, d),
    }
    for name, df in given.items():
        kept = schemas.select_existing(df, schemas.SCHEMAS[name].fieldNames())
        files.write_sheet(kept, posixpath.join(folder, f"{name}.csv"))
    raw = files.read_raw(spark, folder)
    shown = {
        "device_events": ("event_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "region"),
        "firmware_releases": ("firmware_version", F.date_format("release_date", "yyyy-MM-dd"), "previous_version"),
        "support_tickets": ("ticket_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), "resolution"),
    }
    parts = [
        raw[name].select(F.lit(name).alias("source"), F.col(key).cast("string").alias("id"), at.alias("at"), F.col(text).alias("detail"))
        for name, (key, at, text) in shown.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def feature_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and sums of the six feature tables after ``write_features`` and ``read_features``."""
    folder, events, tickets = _folder(spark), V.device_events(spark, d), V.support_tickets(spark, d)
    releases = V.release_dates(spark, d)
    files.write_features(
        {
            "error_rates": features.error_rates(events),
            "rma_by_error": features.rma_by_error(tickets),
            "rma_by_firmware": features.rma_by_firmware(tickets, events),
            "error_spikes": features.error_spikes(events),
            "pre_post_errors": features.pre_post_errors(releases, events),
            "stability_curves": features.stability_curves(events, releases),
        },
        folder,
    )
    sums = {
        "error_rates": "error_events", "rma_by_error": "ticket_count", "rma_by_firmware": "tickets",
        "error_spikes": "error_count", "pre_post_errors": "post_errors", "stability_curves": "error_count",
    }
    read = files.read_features(spark, folder)
    parts = [read[n].agg(F.lit(n).alias("table_name"), X.rows().alias("n"), F.sum(c).alias("total")) for n, c in sums.items()]
    return reduce(DataFrame.unionByName, parts)


def merged_table(spark: SparkSession, d: str) -> DataFrame:
    """The patches after ``write_table``, partitioned by hotfix, and ``read_table``."""
    folder = _folder(spark)
    files.write_table(V.patch_features(spark, d), posixpath.join(folder, "patch_features.parquet"), ["is_hotfix"])
    return _rounded(files.read_table(spark, folder, "patch_features").select("firmware_version", "is_hotfix", "code_churn_score"), "code_churn_score")


def scored_file(spark: SparkSession, d: str) -> DataFrame:
    """Scored patches after ``write_scored``, with blanks around the headers, and ``read_scored``."""
    scored = V.scored_patches(spark, d).select("firmware_version", "is_hotfix", "risk_score", "high_risk_flag")
    path = files.write_scored(scored.toDF(*[f" {c} " for c in scored.columns]), _folder(spark), "in/patches.csv")
    return _rounded(files.read_scored(spark, path), "risk_score").withColumn("file_name", F.lit(posixpath.basename(path)))


def gate_file(spark: SparkSession, d: str) -> DataFrame:
    """The gate's input exported, read by ``read_patches`` under its older key name, and checked."""
    path = posixpath.join(_folder(spark), "patches.csv")
    needed = ["firmware_version", *S.RISK_FEATURES]
    files.export_projection(V.patch_features(spark, d).withColumnRenamed("firmware_version", "version"), ["version", *S.RISK_FEATURES], path)
    patches = files.read_patches(spark, path, lost="lost_cells")
    patches = schemas.require_columns(schemas.normalise_version_col(patches, needed), needed, path)
    missing = files.read_patches(spark, f"{path}.none") is None
    return _rounded(patches.withColumn("other_is_missing", F.lit(missing)), "code_churn_score", "previous_version_error_rate")


def dashboard_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The QA sheet after ``write_sheet``, read as text and typed."""
    path = posixpath.join(_folder(spark), "qa.csv")
    files.write_sheet(scoring.qa_sheet(V.scored_patches(spark, d)), path)
    sheet = files.typed_patches(files.read_csv(spark, path))
    return _rounded(sheet.select("firmware_version", "QA_priority_score", "QA_bucket", "high_risk_flag"), "QA_priority_score")


def written_checks(spark: SparkSession, d: str) -> DataFrame:
    """What ``stats.write_checked`` saw of the patches it wrote, beside the rows that are there."""
    path = posixpath.join(_folder(spark), "patches.parquet")
    seen = stats.write_checked(V.patch_features(spark, d).select(*schemas.SCHEMAS["patch_features"].fieldNames()), path)
    names = ["rows", "no_nulls", "error_rate_positive", "rma_rate_in_unit_range"]
    there = spark.read.parquet(path).agg(X.rows().alias("rows_there"))
    return there.select("rows_there", *[F.lit(seen[n]).cast("long").alias(n) for n in names])


def device_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Devices of the telemetry written as an inventory and read with its schema."""
    folder = _folder(spark)
    devices = V.regional_events(spark, d).select("device_id", "model", "region").distinct()
    files.write_table(devices, posixpath.join(folder, "device_inventory.parquet"))
    read = files.read_device_inventory(spark, folder)
    return read.select("device_id", "model", "region", F.col("manufacture_date").isNull().alias("is_undated"))


def promotions(spark: SparkSession, d: str) -> DataFrame:
    """Two saved versions, promoted in turn and rolled back; the log, which one is active, and
    how many patches the loaded one takes."""
    root = posixpath.join(_folder(spark), "models")
    patches = models.cast_features(V.patch_base(spark, d).withColumn("previous_version_error_rate", F.lit(0.0)))
    for version in ("v001", "v002"):
        registry.save_model(PipelineModel([models.assembler()]), root, version)
    for version in ("v001", "v002", "v001"):
        registry.promote(spark, root, version)
    active = registry.active_version(spark, root)
    taken = registry.load_model(spark, "nowhere", active, fallback=root).transform(patches).agg(F.count("features"))
    log = registry.promotions(spark, root)
    return log.select("seq", "version", (F.col("version") == active).alias("is_active"), taken.scalar().alias("n_patches"))


def renamed_key(spark: SparkSession, d: str) -> DataFrame:
    """``rename_key`` on the comparison around releases."""
    compared = features.pre_post_errors(V.release_dates(spark, d), V.device_events(spark, d))
    return schemas.rename_key(compared).select("firmware_version", "error_code", "delta_errors")


def existing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Of a list of columns those that patches have."""
    listed = ["firmware_version", "files_changed", "not_there", "lines_changed", "nor_this"]
    return schemas.select_existing(V.patch_base(spark, d), listed)


def numeric_sums(spark: SparkSession, d: str) -> DataFrame:
    """The sum of every numeric column of the patches; booleans, texts and dates are none."""
    patches = V.patch_base(spark, d)
    names = schemas.numeric_columns(patches)
    entries = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in names]
    long = patches.select(F.inline(F.array(*entries)))
    # rounded sums of doubles depend on their order, whole ones do not
    whole: Column = F.sum(F.floor("x"))
    return long.groupBy("name").agg(whole.alias("total"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "raw_tables": raw_tables,
    "feature_tables": feature_tables,
    "merged_table": merged_table,
    "scored_file": scored_file,
    "gate_file": gate_file,
    "dashboard_sheet": dashboard_sheet,
    "written_checks": written_checks,
    "device_inventory": device_inventory,
    "promotions": promotions,
    "renamed_key": renamed_key,
    "existing_columns": existing_columns,
    "numeric_sums": numeric_sums,
}
