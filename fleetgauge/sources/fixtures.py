"""The analytics tables as deterministic views over a star schema of parquet files.

Device telemetry comes from ``events``, releases from the versions seen in it,
tickets from its dearer events, and patch features from ``orders`` with their
``lineitem`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions import expressions as X
from fleetgauge.plans.features import (
    add_churn,
    add_outcomes,
    add_previous_release,
    release_gaps,
)
from fleetgauge.plans.scoring import flag_high_risk

# Fixed values of the views.
MODELS = ["Halo One", "Halo Mini", "Halo Max", "Beam Stick", "Beam Panel"]
SEVERITY_STEPS = [("critical", 1), ("high", 5), ("medium", 12)]
TICKET_VALUE = 50.0
NEW_SINCE = "2001-01-01"


# Columns the views read; stated, so that no job is run to find them out.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_quantity double",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")



def _versioned(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    version = F.concat(
        F.lit("10."),
        F.floor(F.col("k") / 10).cast("string"),
        F.lit("."),
        (F.col("k") % 10).cast("string"),
    )
    return events.withColumn("k", k).withColumn("firmware_version", version)


def device_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events of all devices, without the region of the device."""
    serial = F.col("event_id") % 20
    severity = None
    for name, below in SEVERITY_STEPS:
        severity = F.when(serial < below, name) if severity is None else severity.when(serial < below, name)
    return _versioned(table(spark, sf_dir, "events")).select(
        "event_id",
        F.concat(F.lit("DEV_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("device_id"),
        F.concat(
            F.lit("ERR_"),
            F.upper("event_type"),
            F.lit("_"),
            (F.col("event_id") % 10 + 100).cast("string"),
        ).alias("error_code"),
        F.col("ts").alias("timestamp"),
        "firmware_version",
        severity.otherwise("low").alias("severity"),
        F.element_at(
            F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % len(MODELS) + 1).cast("int")
        ).alias("model"),
        "user_id",
        "value",
    )


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales regions of the devices' owners."""
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("region"))
    )


def regional_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device events with the region of the owner; null where the owner is not known."""
    return device_events(spark, sf_dir).join(_owners(spark, sf_dir), "user_id", "left")


def regional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per device and version with the sales region of the device's owner.

    Counted before the owners join, so a busy device is a few rows by then. The region is
    null where the owner is not known.
    """
    counts = (
        device_events(spark, sf_dir)
        .groupBy("user_id", "device_id", "firmware_version")
        .agg(X.rows().alias("n_events"))
    )
    return counts.join(_owners(spark, sf_dir), "user_id", "left")


def _seen_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("release_seq") * 3 / 10).cast("int"))
    return (
        _versioned(table(spark, sf_dir, "events"))
        .select(F.col("k").cast("bigint").alias("release_seq"), "firmware_version")
        .distinct()
        .withColumn("release_date", day)
    )


def release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and their release dates, for queries that need no more."""
    return _seen_releases(spark, sf_dir).select("firmware_version", "release_date")


def firmware_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release per version seen, with the gap to the one before it in its line."""
    dated = _seen_releases(spark, sf_dir).withColumn(
        "product_line", F.floor(F.col("release_seq") / 10)
    )
    gaps = release_gaps(dated).withColumn("error_rate_per_10k", F.lit(0.0))
    return add_previous_release(gaps).select(
        "firmware_version",
        "release_date",
        "previous_version",
        "days_since_previous_release",
    )


def support_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket for each event of value 50 or more, raised 1 to 7 days later."""
    kind = F.floor(F.col("event_id") / 3) % 3
    later = F.make_dt_interval((F.col("event_id") % 7 + 1).cast("int"))
    rma = (F.col("event_id") % 7 == 0).cast("int")
    return (
        device_events(spark, sf_dir)
        .where(F.col("value") >= TICKET_VALUE)
        .select(
            F.col("event_id").cast("string").alias("ticket_id"),
            "device_id",
            "error_code",
            (F.col("timestamp") + later).alias("created_at"),
            (kind + 1).cast("int").alias("tier"),
            F.when(rma == 1, "rma")
            .when(kind == 0, "fixed")
            .when(kind == 1, "no_issue")
            .otherwise("workaround")
            .alias("resolution"),
            rma.alias("rma_issued"),
        )
    )


def patch_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with their size, churn and error rate; nothing lagged but the gap."""
    work = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("release_seq"))
        .agg(X.rows().alias("_files"), F.sum("l_quantity").alias("_quantity"))
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("release_seq"),
        F.col("o_orderkey").cast("string").alias("firmware_version"),
        F.col("o_orderpriority").alias("product_line"),
        F.to_date("o_orderdate").alias("release_date"),
        (F.col("o_totalprice") / 20000).alias("patch_size_mb"),
        X.flag_eq(F.col("o_orderpriority"), "1-URGENT").alias("is_hotfix"),
        X.flag_eq(F.col("o_orderpriority"), "2-HIGH").alias("patch_security"),
    )
    patches = release_gaps(orders).join(work, "release_seq", "left")
    patches = patches.withColumns(
        {
            "files_changed": F.coalesce("_files", F.lit(0).cast("bigint")),
            "lines_changed": F.coalesce((F.col("_quantity") * 10).cast("bigint"), F.lit(0).cast("bigint")),
            "avg_device_age_days": (F.col("release_seq") * 37 % 660 + 90).cast("double"),
        }
    ).drop("_files", "_quantity")
    rate = (
        F.lit(2000.0)
        + F.col("code_churn_score") * 1500
        + F.col("is_hotfix").cast("int") * 1000
        + F.col("release_seq") * 53 % 300
    )
    return add_churn(patches).withColumn("error_rate_per_10k", rate)


def patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patch features, those of the previous release included."""
    seq = F.col("release_seq")
    patches = add_previous_release(patch_base(spark, sf_dir)).withColumns(
        {
            "pre_errors": seq * 7 % 40,
            "post_errors": F.floor(F.col("error_rate_per_10k") / 100),
            "error_events": F.floor(F.col("error_rate_per_10k") / 50),
        }
    )
    patches = patches.withColumn("tickets", F.col("post_errors") * 4).withColumn(
        "rmas",
        F.floor(F.col("tickets").cast("double") * ((seq % 10).cast("double") / F.lit(100.0))),
    )
    return add_outcomes(patches)


def scored_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with a deterministic risk score in steps of one thousandth.

    The previous release is left out: no consumer of the scores needs it, and
    with it each query would lag the whole table.
    """
    score = (F.col("release_seq") * 101 % 1000).cast("double") / 1000
    return flag_high_risk(patch_base(spark, sf_dir).withColumn("risk_score", score))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, score and estimate of each patch, as a model would leave them."""
    base = scored_patches(spark, sf_dir)
    off = F.col("release_seq") * 29 % 200
    return base.select(
        "firmware_version",
        "error_rate_per_10k",
        (F.col("error_rate_per_10k") + off - 100).alias("estimate"),
        (F.col("error_rate_per_10k") >= 3000).cast("int").alias("label"),
        "risk_score",
        F.col("high_risk_flag").alias("predicted"),
    )


def history(patches: DataFrame) -> DataFrame:
    return patches.where(F.col("release_date") < F.lit(NEW_SINCE).cast("date"))


def new_patches(patches: DataFrame) -> DataFrame:
    return patches.where(F.col("release_date") >= F.lit(NEW_SINCE).cast("date"))


def versioned_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches keyed by versions of the telemetry, some of which it never saw."""
    k = F.col("release_seq") % 120
    version = F.concat(
        F.lit("10."), F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string")
    )
    return patch_features(spark, sf_dir).withColumn("firmware_version", version)
