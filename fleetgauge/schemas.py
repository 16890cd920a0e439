"""Typed schemas of the source tables, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_B, _DAY, _TS = T.BooleanType(), T.DateType(), T.TimestampNTZType()

SCHEMAS: dict[str, T.StructType] = {
    "device_events": _table(
        ("event_id", _L, True),
        ("device_id", _S, False),
        ("error_code", _S, False),
        ("timestamp", _TS, False),
        ("firmware_version", _S, False),
        ("severity", _S, True),
        ("model", _S, False),
        ("region", _S, False),
    ),
    "firmware_releases": _table(
        ("firmware_version", _S, False),
        ("release_date", _DAY, False),
        ("previous_version", _S, True),
        ("days_since_previous_release", _D, True),
        ("notes", _S, True),
    ),
    "support_tickets": _table(
        ("ticket_id", _S, False),
        ("device_id", _S, False),
        ("error_code", _S, False),
        ("created_at", _TS, False),
        ("tier", _I, True),
        ("issue_type", _S, True),
        ("firmware_version", _S, True),
        ("resolution", _S, False),
        ("rma_issued", _I, False),
    ),
    "device_inventory": _table(
        ("device_id", _S, False),
        ("model", _S, True),
        ("region", _S, True),
        ("manufacture_date", _DAY, True),
        ("hardware_revision", _S, True),
        ("cpu_class", _S, True),
    ),
    "firmware_metadata": _table(
        ("firmware_version", _S, False),
        ("release_date", _DAY, True),
        ("previous_version", _S, True),
        ("days_since_previous_release", _D, True),
        ("patch_type", _S, True),
        ("patch_size_mb", _D, True),
        ("files_changed", _L, True),
        ("lines_changed", _L, True),
        ("is_hotfix", _I, True),
        ("code_churn_score", _D, True),
    ),
    "patch_features": _table(
        ("firmware_version", _S, False),
        ("release_date", _DAY, True),
        ("previous_version", _S, True),
        ("days_since_previous_release", _D, True),
        ("patch_size_mb", _D, True),
        ("files_changed", _L, True),
        ("lines_changed", _L, True),
        ("is_hotfix", _B, True),
        ("patch_security", _B, True),
        ("code_churn_score", _D, True),
        ("avg_device_age_days", _D, True),
        ("previous_version_error_rate", _D, True),
        ("error_rate_per_10k", _D, True),
        ("pre_errors", _L, True),
        ("post_errors", _L, True),
        ("delta_errors", _L, True),
        ("post_pre_ratio", _D, True),
        ("tickets", _L, True),
        ("rmas", _L, True),
        ("rma_rate", _D, True),
        ("error_events", _L, True),
    ),
    "error_rates": _table(
        ("firmware_version", _S, False),
        ("error_events", _L, True),
        ("error_rate_per_10k", _D, True),
    ),
    "rma_by_error": _table(
        ("error_code", _S, False),
        ("ticket_count", _L, True),
        ("rma_count", _L, True),
        ("rma_rate", _D, True),
    ),
    "rma_by_firmware": _table(
        ("firmware_version", _S, False),
        ("tickets", _L, True),
        ("rmas", _L, True),
        ("rma_rate", _D, True),
    ),
    "error_spikes": _table(
        ("error_code", _S, False),
        ("day", _DAY, True),
        ("error_count", _L, True),
        ("trailing_7d_avg", _D, True),
        ("spike_ratio", _D, True),
    ),
    "pre_post_errors": _table(
        ("release_version", _S, False),
        ("error_code", _S, False),
        ("pre_errors", _L, True),
        ("post_errors", _L, True),
        ("delta_errors", _L, True),
        ("post_pre_ratio", _D, True),
    ),
    "stability_curves": _table(
        ("firmware_version", _S, False),
        ("days_since_release", _I, True),
        ("error_count", _L, True),
    ),
}

RAW_TABLES = ["device_events", "firmware_releases", "support_tickets"]
FEATURE_TABLES = [
    "error_rates",
    "rma_by_error",
    "rma_by_firmware",
    "error_spikes",
    "pre_post_errors",
    "stability_curves",
]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``table`` in order and typed; absent ones become typed nulls.

    Text that does not parse becomes null rather than failing the whole scan;
    ``required_nulls`` counts what was lost.
    """
    cols = []
    for field in SCHEMAS[table].fields:
        if field.name in df.columns:
            col = F.col(field.name).try_cast(field.dataType)
        else:
            col = F.lit(None).cast(field.dataType)
        cols.append(col.alias(field.name))
    return df.select(*cols)


def required_nulls(df: DataFrame, table: str) -> DataFrame:
    """One row: how many nulls each non-nullable column of ``table`` holds."""
    needed = [f.name for f in SCHEMAS[table].fields if not f.nullable]
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed])


def require_columns(df: DataFrame, columns: list[str], what: str = "input") -> DataFrame:
    """The frame itself, or a ``ValueError`` that lists every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns in {what}: {missing}")
    return df


def normalise_version_col(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rename ``version`` to ``firmware_version`` when that is what is missing."""
    short = any(c not in df.columns for c in columns)
    if short and "version" in df.columns and "firmware_version" not in df.columns:
        return df.withColumnRenamed("version", "firmware_version")
    return df


def rename_key(df: DataFrame, old: str = "release_version", new: str = "firmware_version") -> DataFrame:
    return df.withColumnRenamed(old, new)


def select_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns; booleans do not count as numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Replace nulls column by column; columns the frame lacks are ignored."""
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})
