"""Baseline KPI reports over device events, releases and support tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import settings as S
from fleetgauge.functions import expressions as X
from fleetgauge.operators.ordered import previous_in_cells
from fleetgauge.operators.pairs import blocked_pairs, pair_support


def grouped(events: DataFrame, *columns: str) -> DataFrame:
    """Events counted by some columns, as ``_n``: distinct counts over it see each
    combination once instead of every event."""
    return events.groupBy(*columns).agg(X.rows().alias("_n"))


def executive_kpis(events: DataFrame) -> DataFrame:
    return grouped(events, "firmware_version", "device_id", "error_code").agg(
        F.count_distinct("firmware_version").alias("total_firmware_versions"),
        F.count_distinct("device_id").alias("total_devices"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_error_events"),
        F.count_distinct("error_code").alias("unique_error_codes"),
    ).withColumn(
        "errors_per_device",
        X.round_to(X.ratio(F.col("total_error_events"), F.col("total_devices")), 2),
    )


def error_rate_by_firmware(events: DataFrame, releases: DataFrame) -> DataFrame:
    """Events are counted per version first, so the join sees one row per version."""
    counts = grouped(events, "firmware_version", "device_id", "error_code").groupBy("firmware_version").agg(
        F.count_distinct("device_id").alias("affected_devices"),
        F.sum("_n").alias("_events"),
        F.count_distinct("error_code").alias("unique_errors"),
    )
    dates = releases.groupBy("firmware_version", "release_date").agg(X.rows().alias("_copies"))
    total = F.col("_events") * F.coalesce("_copies", F.lit(1))
    return (
        counts.join(dates, "firmware_version", "left")
        .select(
            "firmware_version",
            "release_date",
            "affected_devices",
            total.alias("total_errors"),
            X.round_to(X.ratio(total, F.col("affected_devices")), 2).alias("error_rate_per_device"),
            "unique_errors",
        )
        .orderBy(F.desc("release_date"), "firmware_version")
    )


def version_rates(events: DataFrame) -> DataFrame:
    """Events, devices and events per device of each version."""
    return events.groupBy("firmware_version").agg(
        X.rows().alias("error_count"), F.count_distinct("device_id").alias("device_count")
    ).withColumn("error_rate", X.ratio(F.col("error_count"), F.col("device_count")))


def high_risk_firmware(events: DataFrame) -> DataFrame:
    stats = version_rates(events)
    average = stats.agg(F.avg("error_rate")).scalar()
    return (
        stats.withColumn("_avg", average)
        .orderBy(F.desc("error_rate"), "firmware_version")
        .select(
            "firmware_version",
            "error_count",
            "device_count",
            X.round_to(F.col("error_rate"), 3).alias("error_rate"),
            X.round_to(F.col("_avg"), 3).alias("baseline_avg"),
            X.round_to(X.ratio(F.col("error_rate"), F.col("_avg")), 2).alias("risk_multiplier"),
            X.risk_tier(F.col("error_rate"), F.col("_avg")).alias("risk_tier"),
        )
    )


def error_code_share(events: DataFrame, k: int = 20) -> DataFrame:
    total = events.agg(X.rows()).scalar()
    return (
        grouped(events, "error_code", "device_id", "firmware_version")
        .groupBy("error_code")
        .agg(
            F.sum("_n").alias("occurrence_count"),
            F.count_distinct("device_id").alias("affected_devices"),
            F.count_distinct("firmware_version").alias("firmware_versions_affected"),
        )
        .orderBy(F.desc("occurrence_count"), "error_code")
        .limit(k)
        .withColumn("pct_of_all_errors", X.percent(F.col("occurrence_count"), total))
    )


def ticket_summary(tickets: DataFrame) -> DataFrame:
    return (
        tickets.groupBy("error_code")
        .agg(
            X.rows().alias("ticket_count"),
            X.round_to(F.avg("tier"), 2).alias("avg_tier"),
            F.sum("rma_issued").alias("total_rmas"),
        )
        .withColumn("rma_rate_pct", X.percent(F.col("total_rmas"), F.col("ticket_count")))
        .orderBy(F.desc("ticket_count"), "error_code")
    )


def having_min(df: DataFrame, column: str, minimum: int) -> DataFrame:
    """Groups with a sufficient sample."""
    return df.where(F.col(column) >= minimum)


def _event_cells(events: DataFrame) -> DataFrame:
    return events.groupBy("firmware_version", "device_id", "error_code").agg(X.rows().alias("_n"))


def rma_rate_joined(events: DataFrame, tickets: DataFrame, minimum: int = S.MIN_TICKETS) -> DataFrame:
    """RMA rate by version over the join on device and code.

    Each event meets each ticket of its key, so RMAs are counted once per event
    while tickets are counted once: the rate may pass 100 %. The join is not
    carried out; counts per key give the same sums. Tickets of one row each add
    up per key. Only ids of several rows are joined to the versions, to replace
    their rows by distinct ids.
    """
    key = ["device_id", "error_code"]
    cells = _event_cells(events.where(X.present(*key)))
    tickets = tickets.where(X.present(*key))
    per_key = tickets.groupBy(*key).agg(
        F.sum("rma_issued").alias("_rmas"), F.count("ticket_id").alias("_ids")
    )
    sums = (
        cells.join(per_key, key)
        .groupBy("firmware_version")
        .agg(F.sum(F.col("_n") * F.col("_rmas")).alias("_rmas"), F.sum("_ids").alias("_ids"))
    )
    per_home = tickets.where(X.present("ticket_id")).groupBy("ticket_id", *key)
    per_home = per_home.agg(X.rows().alias("_rows"))
    repeated = per_home.groupBy("ticket_id").agg(F.sum("_rows").alias("_all")).where("_all > 1")
    surplus = (
        cells.join(per_home.join(repeated.select("ticket_id"), "ticket_id", "left_semi"), key)
        .groupBy("firmware_version")
        .agg(F.count_distinct("ticket_id").alias("_distinct"), F.sum("_rows").alias("_rows"))
        .select("firmware_version", (F.col("_distinct") - F.col("_rows")).alias("_ids"))
    )
    counted = (
        sums.unionByName(surplus, allowMissingColumns=True)
        .groupBy("firmware_version")
        .agg(F.sum("_ids").alias("support_tickets"), F.sum("_rmas").alias("rma_count"))
    )
    return (
        having_min(counted, "support_tickets", minimum)
        .withColumn("rma_rate_pct", X.percent(F.col("rma_count"), F.col("support_tickets")))
        .orderBy(F.desc("rma_rate_pct"), "firmware_version")
    )


def weekly_trend(events: DataFrame) -> DataFrame:
    return (
        grouped(events.withColumn("year_week", X.year_week(F.col("timestamp"))), "year_week", "device_id", "firmware_version")
        .groupBy("year_week")
        .agg(
            F.sum("_n").alias("error_count"),
            F.count_distinct("device_id").alias("unique_devices"),
            F.count_distinct("firmware_version").alias("active_versions"),
        )
        .orderBy("year_week")
    )


def by_dimension(
    events: DataFrame, dimension: str, distinct: str, name: str, weight: str | None = None
) -> DataFrame:
    """Devices, errors and a distinct count for each value of a device dimension.

    Rows may be counts of events already; ``weight`` then names the count.
    """
    if weight is None:
        events, weight = grouped(events, dimension, "device_id", distinct), "_n"
    return (
        events.groupBy(dimension)
        .agg(
            F.count_distinct("device_id").alias("device_count"),
            F.sum(weight).alias("total_errors"),
            F.count_distinct(distinct).alias(name),
        )
        .select(
            dimension,
            "device_count",
            "total_errors",
            X.round_to(X.ratio(F.col("total_errors"), F.col("device_count")), 2).alias(
                "errors_per_device"
            ),
            name,
        )
        .orderBy(F.desc("errors_per_device"), dimension)
    )


def by_model(events: DataFrame, weight: str | None = None) -> DataFrame:
    return by_dimension(events, "model", "error_code", "unique_error_types", weight)


def by_region(events: DataFrame, weight: str | None = None) -> DataFrame:
    return by_dimension(events, "region", "firmware_version", "firmware_versions", weight)


def error_cooccurrence(events: DataFrame, minimum: int = S.MIN_DEVICES, k: int = 15) -> DataFrame:
    devices = events.agg(F.count_distinct("device_id")).scalar()
    return (
        pair_support(events, "device_id", "error_code", minimum)
        .select(
            F.col("item_1").alias("error_1"),
            F.col("item_2").alias("error_2"),
            F.col("holders").alias("devices_with_both"),
        )
        .orderBy(F.desc("devices_with_both"), "error_1", "error_2")
        .limit(k)
        .withColumn("pct_of_devices", X.percent(F.col("devices_with_both"), devices))
    )


def version_regressions(events: DataFrame, consecutive: bool = False, min_change: float = 0.1) -> DataFrame:
    """Rate changes between versions.

    By default each version is compared with every version of smaller text, as
    many result rows as there are such pairs. ``consecutive`` compares it with
    the one before it in version order only: by the numbers of its parts, then by
    what follows them, then by the whole text.
    """
    rates = version_rates(events).select("firmware_version", "error_rate")
    if consecutive:
        key = X.version_key(F.col("firmware_version"))
        keyed = rates.where(F.col("firmware_version").isNotNull()).select(
            "*", F.slice(key, 1, 1).alias("_major"), F.slice(key, 2, 1).alias("_minor"), key.alias("_key")
        )
        pairs = previous_in_cells(
            keyed, ["_major", "_minor"], ["_key", "firmware_version"], ["firmware_version", "error_rate"]
        ).select(
            F.col("firmware_version").alias("current_version"),
            F.col("_previous.firmware_version").alias("previous_version"),
            F.col("error_rate").alias("current_rate"),
            F.col("_previous.error_rate").alias("previous_rate"),
        )
        pairs = pairs.where(F.col("previous_version").isNotNull())
    else:
        current = rates.select(
            F.col("firmware_version").alias("current_version"),
            F.col("error_rate").alias("current_rate"),
        )
        previous = rates.select(
            F.col("firmware_version").alias("previous_version"),
            F.col("error_rate").alias("previous_rate"),
        )
        pairs = blocked_pairs(
            current,
            previous,
            "current_version",
            "previous_version",
            F.col("current_version") > F.col("previous_version"),
        )
    now, before = F.col("current_rate"), F.col("previous_rate")
    return (
        pairs.where(F.abs(now - before) > min_change)
        .select(
            "current_version",
            "previous_version",
            X.round_to(now, 3).alias("current_error_rate"),
            X.round_to(before, 3).alias("previous_error_rate"),
            X.round_to(now - before, 3).alias("rate_change"),
            X.regression_status(now, before).alias("status"),
        )
        .orderBy(F.desc("rate_change"), "current_version", "previous_version")
    )


def escalation(tickets: DataFrame, minimum: int = S.MIN_TICKETS) -> DataFrame:
    tier = F.col("tier")
    counted = tickets.groupBy("error_code").agg(
        F.count_if(tier == 1).alias("tier_1"),
        F.count_if(tier == 2).alias("tier_2"),
        F.count_if(tier == 3).alias("tier_3"),
        X.rows().alias("total_tickets"),
        F.count_if(tier >= 2).alias("_raised"),
    )
    return (
        having_min(counted, "total_tickets", minimum)
        .withColumn("escalation_rate_pct", X.percent(F.col("_raised"), F.col("total_tickets")))
        .drop("_raised")
        .orderBy(F.desc("escalation_rate_pct"), "error_code")
    )


def release_health(events: DataFrame, tickets: DataFrame) -> DataFrame:
    """100 minus penalties for errors, RMAs and support tier: higher is better.

    Rates are those of the left join of events and tickets on device and code,
    in which an event counts once per ticket of its key. As in
    ``rma_rate_joined`` the sums come from counts per key.
    """
    per_key = tickets.groupBy("device_id", "error_code").agg(
        X.rows().alias("_rows"),
        F.count("ticket_id").alias("_tickets"),
        F.sum("rma_issued").alias("_rmas"),
        F.sum("tier").alias("_tiers"),
        F.count("tier").alias("_tiered"),
    )
    n = F.col("_n")
    sums = (
        _event_cells(events)
        .join(per_key, ["device_id", "error_code"], "left")
        .groupBy("firmware_version")
        .agg(
            F.sum(n * F.coalesce("_rows", F.lit(1))).alias("_joined"),
            F.count_distinct("device_id").alias("_devices"),
            F.sum(n * F.col("_rmas")).alias("_rmas"),
            F.sum(n * F.col("_tickets")).alias("_tickets"),
            F.sum(n * F.col("_tiers")).alias("_tiers"),
            F.sum(n * F.col("_tiered")).alias("_tiered"),
        )
    )
    scored = sums.select(
        "firmware_version",
        X.ratio(F.col("_joined"), F.col("_devices")).alias("e"),
        F.coalesce(X.ratio(F.col("_rmas"), F.col("_tickets")), F.lit(0.0)).alias("r"),
        F.coalesce(X.ratio(F.col("_tiers"), F.col("_tiered")), F.lit(1.0)).alias("t"),
    )
    penalty = (
        F.col("e") * S.HEALTH_ERROR_WEIGHT
        + F.col("r") * S.HEALTH_RMA_WEIGHT
        + (F.col("t") - 1) / 2 * S.HEALTH_TIER_WEIGHT
    )
    return scored.select(
        "firmware_version",
        X.round_to(F.col("e"), 3).alias("error_rate"),
        X.round_to(F.col("r"), 3).alias("rma_rate"),
        X.round_to(F.col("t"), 2).alias("avg_support_tier"),
        X.round_to(F.lit(100) - penalty, 1).alias("health_score"),
    ).orderBy(F.desc("health_score"), "firmware_version")
