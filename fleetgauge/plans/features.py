"""Feature tables per error code, day and firmware version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge import settings as S
from fleetgauge.functions import expressions as X
from fleetgauge.operators.asof import asof_join
from fleetgauge.operators.intervals import days_around
from fleetgauge.operators.ordered import previous_row


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(X.rows().alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cardinalities(events: DataFrame) -> DataFrame:
    # grouped first, so that distinct counts see no repeated rows; the filter is always true
    # and keeps the optimizer from dropping the grouping
    kinds = events.groupBy("device_id", "error_code", "severity", "firmware_version").agg(X.rows().alias("_n")).where("_n > 0")
    return kinds.agg(
        F.count_distinct("device_id").alias("device_count"),
        F.count_distinct("error_code").alias("error_code_count"),
        F.count_distinct("severity").alias("severity_count"),
        F.count_distinct("firmware_version").alias("firmware_count"),
    )


def error_rates(events: DataFrame) -> DataFrame:
    """Errors of each version per 10,000 devices of the whole fleet."""
    devices = events.agg(F.count_distinct("device_id")).scalar()
    rate = X.ratio(F.col("error_events"), devices) * 10000
    return (
        events.groupBy("firmware_version")
        .agg(X.rows().alias("error_events"))
        .withColumn("error_rate_per_10k", X.round_to(rate, 2))
        .orderBy(F.desc("error_rate_per_10k"), "firmware_version")
    )


def _rma_rate(rmas: str, tickets: str) -> Column:
    return X.round_to(X.ratio(F.col(rmas), F.col(tickets)), 3)


def rma_by_error(tickets: DataFrame) -> DataFrame:
    return (
        tickets.groupBy("error_code")
        .agg(X.rows().alias("ticket_count"), F.sum("rma_issued").alias("rma_count"))
        .withColumn("rma_rate", _rma_rate("rma_count", "ticket_count"))
        .orderBy(F.desc("rma_rate"), "error_code")
    )


def attribute_tickets(tickets: DataFrame, events: DataFrame) -> DataFrame:
    """Each ticket id with the version of its newest event at or before it.

    Events tie by ``event_id``. A ticket id that occurs more than once keeps the
    row with the newest event.
    """
    matched = asof_join(
        tickets.select("ticket_id", "device_id", "error_code", "created_at", "rma_issued"),
        events.select("device_id", "error_code", "timestamp", "event_id", "firmware_version"),
        on=["device_id", "error_code"],
        left_time="created_at",
        right_time="timestamp",
        tie="event_id",
        values=["firmware_version"],
    )
    best = F.max(F.struct("timestamp", "event_id", "rma_issued", "firmware_version"))
    return matched.groupBy("ticket_id").agg(best.alias("_m")).select(
        "ticket_id",
        F.col("_m.firmware_version").alias("firmware_version"),
        F.col("_m.rma_issued").alias("rma_issued"),
    )


def rma_by_firmware(tickets: DataFrame, events: DataFrame) -> DataFrame:
    return (
        attribute_tickets(tickets, events)
        .groupBy("firmware_version")
        .agg(X.rows().alias("tickets"), F.sum("rma_issued").alias("rmas"))
        .withColumn("rma_rate", _rma_rate("rmas", "tickets"))
        .orderBy(F.desc("rma_rate"), "firmware_version")
    )


def meaningful_rma(rma: DataFrame, minimum: int = S.MIN_TICKETS) -> DataFrame:
    """Versions with enough tickets for their rate to mean something."""
    return rma.where(F.col("tickets") >= minimum)


def top_rma(rma: DataFrame, k: int = 10, minimum: int = S.MIN_TICKETS) -> DataFrame:
    """Top versions by RMA rate among those with enough tickets; by tickets if none has.

    Versions with enough tickets sort first, so the ``k`` rows kept are enough
    to tell whether there is any.
    """
    enough = F.col("tickets") >= minimum
    best = (
        rma.withColumn("_enough", enough)
        .orderBy(
            F.desc("_enough"),
            F.desc(F.when(enough, F.col("rma_rate")).otherwise(F.col("tickets").cast("double"))),
            "firmware_version",
        )
        .limit(k)
    )
    any_enough = F.max("_enough").over(W.partitionBy(F.lit(0)))
    return best.withColumn("_any", any_enough).where("_enough or not _any").drop("_enough", "_any")


def daily_errors(events: DataFrame) -> DataFrame:
    return events.groupBy("error_code", F.to_date("timestamp").alias("day")).agg(
        X.rows().alias("error_count")
    )


def error_spikes(
    events: DataFrame,
    window: int = S.SPIKE_WINDOW,
    threshold: float = S.SPIKE_RATIO,
    calendar: bool = False,
) -> DataFrame:
    """Days on which a code runs at ``threshold`` times its trailing mean or more.

    The mean is over the previous ``window`` days that have events; with
    ``calendar`` it is over the days with events among the previous ``window``
    calendar days. The rounded ratio is compared, so 1.495 passes as 1.5. The
    window sees one row per code and day.
    """
    code = W.partitionBy("error_code")
    if calendar:
        day_number = F.datediff("day", F.lit("1970-01-01").cast("date"))
        frame = code.orderBy(day_number).rangeBetween(-window, -1)
    else:
        frame = code.orderBy("day").rowsBetween(-window, -1)
    trailing = F.col("trailing_7d_avg")
    return (
        daily_errors(events)
        .withColumn("trailing_7d_avg", F.avg("error_count").over(frame))
        .where(trailing.isNotNull())
        .withColumn("spike_ratio", X.round_to(X.ratio(F.col("error_count"), trailing), 2))
        .where(F.col("spike_ratio") >= threshold)
        .orderBy(F.desc("spike_ratio"), "error_code", "day")
    )


def pre_post_errors(
    releases: DataFrame,
    events: DataFrame,
    days: int = S.RELEASE_WINDOW_DAYS,
    minimum: int = S.MIN_POST_ERRORS,
    same_version: bool = False,
) -> DataFrame:
    """Errors in the ``days`` before a release and from its day to ``days`` after.

    All events of the window count, whatever version they ran, unless
    ``same_version`` is set. Events are counted per code and day, and windows
    are built per release date, so the join grows with days and codes only.
    """
    if same_version:
        daily = events.groupBy(
            "firmware_version", "error_code", F.to_date("timestamp").alias("day")
        ).agg(X.rows().alias("error_count"))
        dated = releases.select("firmware_version", "release_date")
        near = daily.join(dated, "firmware_version").withColumn(
            "period", X.release_period(F.col("day"), F.col("release_date"), days)
        )
        sums = _period_sums(near, "firmware_version", "error_code")
    else:
        near = (
            days_around(releases, "release_date", days, days)
            .join(daily_errors(events), "day")
            .withColumn("period", X.release_period(F.col("day"), F.col("release_date"), days))
        )
        per_date = _period_sums(near, "release_date", "error_code")
        sums = (
            releases.select("firmware_version", "release_date")
            .join(per_date, "release_date")
            .groupBy("firmware_version", "error_code")
            .agg(*[F.sum(c).alias(c) for c in ("pre_errors", "post_errors")])
        )
    pre, post = F.col("pre_errors"), F.col("post_errors")
    return (
        sums.where(post >= minimum)
        .select(
            F.col("firmware_version").alias("release_version"),
            "error_code",
            "pre_errors",
            "post_errors",
            (post - pre).alias("delta_errors"),
            X.round_to(F.when(pre > 0, X.ratio(post, pre)), 2).alias("post_pre_ratio"),
        )
        .orderBy("release_version", "error_code")
    )


def _period_sums(near: DataFrame, *keys: str) -> DataFrame:
    def total(period: str) -> Column:
        return F.sum(F.when(F.col("period") == period, F.col("error_count")).otherwise(0))

    return (
        near.where(F.col("period").isNotNull())
        .groupBy(*keys)
        .agg(total("pre").alias("pre_errors"), total("post").alias("post_errors"))
    )


def stability_curves(events: DataFrame, releases: DataFrame) -> DataFrame:
    """Errors of a version by whole days since its release, from day 0.

    Days are cut toward zero, so events less than a day early fall on day 0.
    """
    ts = F.col("timestamp")
    daily = events.groupBy(
        "firmware_version", F.to_date(ts).alias("_day"), X.is_midnight(ts).alias("_midnight")
    ).agg(X.rows().alias("_n"))
    since = X.days_toward_zero(F.col("_day"), F.col("_midnight"), F.col("release_date"))
    return (
        daily.join(releases.select("firmware_version", "release_date"), "firmware_version")
        .withColumn("days_since_release", since)
        .where(F.col("days_since_release") >= 0)
        .groupBy("firmware_version", "days_since_release")
        .agg(F.sum("_n").alias("error_count"))
        .orderBy("firmware_version", "days_since_release")
    )


def first_curves(curves: DataFrame, k: int = 5) -> DataFrame:
    """The curves of the first ``k`` versions."""
    first = curves.select("firmware_version").distinct().orderBy("firmware_version").limit(k)
    return curves.join(first, "firmware_version", "left_semi").orderBy(
        "firmware_version", "days_since_release"
    )


def rollup_pre_post(pre_post: DataFrame) -> DataFrame:
    """Before/after counts per version; null ratios do not enter the mean."""
    return pre_post.groupBy(F.col("release_version").alias("firmware_version")).agg(
        F.sum("pre_errors").alias("pre_errors"),
        F.sum("post_errors").alias("post_errors"),
        F.sum("delta_errors").alias("delta_errors"),
        F.avg("post_pre_ratio").alias("post_pre_ratio"),
    )


def release_gaps(releases: DataFrame, line: str = "product_line", seq: str = "release_seq") -> DataFrame:
    """Add ``days_since_previous_release`` within a product line.

    Only the first release of a date has a gap; the later ones follow it on the
    same day. So the dates of a line are enough, and no window over the releases
    themselves is needed. A release without line or date has the gap of a first one.
    """
    dates = releases.where(X.present(line, "release_date")).groupBy(line, "release_date").agg(F.min(seq).alias("_first"))
    before = F.lag("release_date").over(W.partitionBy(line).orderBy("release_date"))
    dates = dates.select(line, "release_date", "_first", before.alias("_before"))
    gap = F.when(F.col(seq) != F.col("_first"), F.lit(0)).otherwise(
        F.coalesce(F.datediff("release_date", "_before"), F.lit(S.FIRST_RELEASE_GAP_DAYS))
    )
    return releases.join(dates, [line, "release_date"], "left").select(
        *[F.col(c) for c in releases.columns],
        gap.cast("double").alias("days_since_previous_release"),
    )


def add_churn(patches: DataFrame) -> DataFrame:
    return patches.withColumn(
        "code_churn_score",
        X.churn_score(
            F.col("lines_changed"), F.col("files_changed"), F.col("days_since_previous_release")
        ),
    )


def add_previous_release(
    patches: DataFrame, line: str = "product_line", seq: str = "release_seq"
) -> DataFrame:
    """Add the version and error rate of the release before each one."""
    lagged = previous_row(
        patches, line, "release_date", seq, ["firmware_version", "error_rate_per_10k"]
    )
    previous = F.col("_previous")
    return lagged.withColumns(
        {
            "previous_version": F.coalesce(
                previous["firmware_version"], F.lit(S.FIRST_PREVIOUS_VERSION)
            ),
            "previous_version_error_rate": F.coalesce(
                previous["error_rate_per_10k"], F.lit(0.0)
            ),
        }
    ).drop("_previous")


def add_outcomes(patches: DataFrame) -> DataFrame:
    """Change and smoothed ratio of the errors around a release, and its RMA rate."""
    post, pre = F.col("post_errors"), F.col("pre_errors")
    return patches.withColumns(
        {
            "delta_errors": post - pre,
            "post_pre_ratio": X.smoothed_ratio(post, pre),
            "rma_rate": X.ratio(F.col("rmas"), F.col("tickets")),
        }
    )


def _suffixed(df: DataFrame, key: str, suffix: str) -> DataFrame:
    return df.select(key, *[F.col(c).alias(c + suffix) for c in df.columns if c != key])


def merge_features(features: DataFrame, rates: DataFrame, rma: DataFrame) -> DataFrame:
    """Patch features with the measured tables; no measurement counts as zero."""
    key = "firmware_version"
    merged = features.join(_suffixed(rates, key, "_sql"), key, "left").join(
        _suffixed(rma, key, "_sql"), key, "left"
    )
    added = [c for c in merged.columns if c not in features.columns]
    return fill_zero(merged, added)


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, subset=columns)


def training_table(
    features: DataFrame, pre_post: DataFrame, rma: DataFrame, ratio_from: str = "sql"
) -> DataFrame:
    """Patch features with the before/after sums and the attributed RMA rates.

    Clashing names end in ``_synth`` (features) and ``_sql`` (measured).
    ``regression_ratio`` is the measured ratio, or that of the features with
    ``ratio_from="synth"``; 1.0 where there is none.
    """
    key = "firmware_version"
    measured = [_suffixed(rollup_pre_post(pre_post), key, "_sql"), _suffixed(rma, key, "_sql")]
    clash = {c.removesuffix("_sql") for df in measured for c in df.columns if c != key}
    joined = features.select(
        *[F.col(c).alias(f"{c}_synth" if c in clash else c) for c in features.columns]
    )
    for df in measured:
        joined = joined.join(df, key, "left")
    return joined.withColumns(
        {
            "target_error_rate": F.col("error_rate_per_10k"),
            "regression_ratio": F.coalesce(F.col(f"post_pre_ratio_{ratio_from}"), F.lit(1.0)),
        }
    )
