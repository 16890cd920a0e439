"""Reading and writing the tables. Parquet by default, CSV where people look at it."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.schemas import FEATURE_TABLES, RAW_TABLES, conform, require_columns
from fleetgauge.sources import csv


def read_csv(spark: SparkSession, path: str, trim_headers: bool = False) -> DataFrame:
    """A CSV file as text columns; only the header is looked at, nothing is inferred.

    Quoted cells may hold line breaks, and a doubled quote stands for one; see ``csv.read``.
    """
    df = csv.read(spark, path)
    if trim_headers:
        df = df.toDF(*[c.strip() for c in df.columns])
    return df


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``, or ``<name>.csv`` when there is none, typed."""
    try:
        df = spark.read.parquet(posixpath.join(folder, f"{name}.parquet"))
    except AnalysisException as error:
        if not _missing(error):
            raise
        df = read_csv(spark, posixpath.join(folder, f"{name}.csv"))
    return conform(df, name)


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in RAW_TABLES}


def read_features(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in FEATURE_TABLES}


def read_device_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "device_inventory")


def read_firmware_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "firmware_metadata")


PATCH_TYPES = {
    "code_churn_score": "double",
    "previous_version_error_rate": "double",
    "avg_device_age_days": "double",
    "risk_score": "double",
    "churn_norm": "double",
    "QA_priority_score": "double",
    "high_risk_flag": "int",
}


def typed_patches(df: DataFrame, lost: str | None = None) -> DataFrame:
    """Numbers as double, booleans (True, 1, yes) as 0/1; other columns as they are.

    ``lost`` names a further column: how many filled cells of a row did not parse.
    """
    casts = {c: F.col(c).try_cast(t) for c, t in PATCH_TYPES.items() if c in df.columns}
    kinds = dict(df.dtypes)
    for name in ("is_hotfix", "patch_security"):
        if name in kinds:
            col = F.col(name)
            flag = col.try_cast("boolean") if kinds[name] == "string" else col.cast("boolean")
            casts[name] = flag.cast("int")
    if lost:
        gone = [(F.trim(F.col(c).cast("string")) != "") & x.isNull() for c, x in casts.items()]
        casts[lost] = sum((F.coalesce(g, F.lit(False)).cast("int") for g in gone), F.lit(0))
    return df.withColumns(casts) if casts else df


def read_scored(spark: SparkSession, path: str, trim_headers: bool = True) -> DataFrame:
    return typed_patches(read_csv(spark, path, trim_headers))


def read_patches(spark: SparkSession, path: str, lost: str | None = None) -> DataFrame | None:
    """Patches for the gate, or None when the file does not exist; ``lost`` as above."""
    try:
        return typed_patches(read_csv(spark, path), lost)
    except AnalysisException as error:
        if _missing(error):
            return None
        raise


def register(df: DataFrame, name: str, persist: bool = False) -> None:
    """Make a frame known to SQL, in place of what had the name before."""
    if persist:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)


def q(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """Events partitioned by day, so that date ranges read their days only.

    Rows are first spread by day and a part of the device hash: a day has a few
    files of about equal size and no single task writes a whole busy day.
    """
    day = F.to_date("timestamp")
    part = F.pmod(F.xxhash64("device_id"), F.lit(8))
    dated = events.withColumn("event_day", day)
    dated.repartition("event_day", part).write.mode("overwrite").partitionBy("event_day").parquet(path)


def write_features(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_table(df, posixpath.join(folder, f"{name}.parquet"))


def write_sheet(df: DataFrame, path: str) -> None:
    """CSV with a header, for dashboards."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_scored(df: DataFrame, folder: str, input_path: str) -> str:
    """CSV named ``scored_<input name>``; returns its path."""
    path = posixpath.join(folder, f"scored_{posixpath.basename(input_path.rstrip('/'))}")
    write_sheet(df, path)
    return path


def export_projection(df: DataFrame, columns: Iterable[str], path: str) -> None:
    columns = list(columns)
    write_sheet(require_columns(df, columns, "export").select(columns), path)
