"""Column expressions shared by the queries. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge import settings as S


def rows() -> Column:
    """Number of rows of a group."""
    return F.count(F.lit(1))


def present(*columns: str) -> Column:
    """All of the columns are non-null."""
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def round_to(col: Column, digits: int) -> Column:
    """Decimal half-up rounding of a double."""
    return F.round(col.cast("double"), digits)


def ratio(num: Column, den: Column) -> Column:
    """Real division; null when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column, digits: int = 1) -> Column:
    return round_to(F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double")), digits)


def clip(col: Column, lo: float, hi: float) -> Column:
    """Bound a value; null stays null (``least`` and ``greatest`` would skip it)."""
    bounded = F.greatest(F.lit(lo), F.least(F.lit(hi), col))
    return F.when(col.isNotNull(), bounded)


def flag_ge(col: Column, threshold) -> Column:
    """1 when ``col >= threshold``, else 0; null counts as below."""
    return F.coalesce((col >= threshold).cast("int"), F.lit(0))


def flag_eq(col: Column, value) -> Column:
    """True when equal, False otherwise, null included."""
    return F.coalesce(col == value, F.lit(False))


def bucket(score: Column, steps: list[tuple[str, float]], rest: str) -> Column:
    """Name of the first step whose lower bound the score reaches."""
    expr = None
    for name, bound in steps:
        expr = F.when(score >= bound, name) if expr is None else expr.when(score >= bound, name)
    return expr.otherwise(rest)


def qa_bucket(score: Column) -> Column:
    return bucket(score, S.QA_BUCKETS, S.QA_BUCKET_REST)


def monitoring_tier(score: Column) -> Column:
    return bucket(score, S.MONITORING_TIERS, S.MONITORING_TIER_REST)


def risk_tier(rate: Column, average: Column) -> Column:
    return (
        F.when(rate > average * S.HIGH_RISK_TIMES, "HIGH RISK")
        .when(rate > average, "MODERATE")
        .otherwise("LOW")
    )


def regression_status(current: Column, previous: Column) -> Column:
    return (
        F.when(current > previous * S.REGRESSION_TIMES, "REGRESSION")
        .when(current < previous * S.IMPROVEMENT_TIMES, "IMPROVEMENT")
        .otherwise("STABLE")
    )


def release_period(day: Column, release: Column, days: int = S.RELEASE_WINDOW_DAYS) -> Column:
    """``pre`` for the days before the release, ``post`` for day 0 and after."""
    return F.when(
        day.between(F.date_add(release, -days), F.date_add(release, -1)), "pre"
    ).when(day.between(release, F.date_add(release, days)), "post")


def year_week(ts: Column) -> Column:
    """``YYYY-WW``; weeks start on Monday, days before the first Monday are week 00."""
    day = F.to_date(ts)
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")
    year = F.lpad(F.year(day).cast("string"), 4, "0")
    return F.concat_ws("-", year, F.lpad(week.cast("string"), 2, "0"))


def is_midnight(ts: Column) -> Column:
    return ts == F.to_date(ts).cast("timestamp_ntz")


def days_toward_zero(day: Column, midnight: Column, release: Column) -> Column:
    """Whole days from a release date to a time, truncated toward zero.

    The time is given by its day and whether it falls exactly on midnight, so
    that events may be counted per day before they meet their release.
    """
    days = F.datediff(day, release)
    return F.when((days < 0) & ~midnight, days + 1).otherwise(days)


def version_key(version: Column) -> Column:
    """Array that orders ``10.9.0`` before ``10.10.0``: of each part, its leading number
    (null sorts first) and the text after it."""

    def part(text: Column) -> Column:
        number = F.regexp_extract(text, "^[0-9]+", 0)
        return F.struct(number.try_cast("decimal(38,0)").alias("number"), F.substring(text, F.length(number) + 1, F.length(text)).alias("rest"))

    return F.transform(F.split(version, "[.]"), part)


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key; plain SQL can compute it too."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def churn_score(lines: Column, files: Column, gap_days: Column) -> Column:
    per_day = lines.cast("double") / F.greatest(gap_days.cast("double"), F.lit(1.0))
    return (per_day + files.cast("double")) / F.lit(S.CHURN_SCALE)


def smoothed_ratio(post: Column, pre: Column) -> Column:
    return (post + 1).cast("double") / (pre + 1).cast("double")


def suffix_key(col: Column, suffix: str = ".NEW") -> Column:
    return F.concat(col.cast("string"), F.lit(suffix))
