"""Interval joins on days, turned into equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def days_around(dates: DataFrame, date: str, before: int, after: int) -> DataFrame:
    """One row per distinct date and day of its window, as ``day``."""
    span = F.sequence(F.date_add(date, -before), F.date_add(date, after))
    return dates.select(date).distinct().select(date, F.explode(span).alias("day"))
