"""Versioned models in a shared folder, with a log of promotions."""

from __future__ import annotations

import posixpath

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fleetgauge import settings as S

_LOG = "seq bigint, version string, at timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(posixpath.join(path, "metadata")).schema
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def save_model(model: PipelineModel, root: str, version: str = S.MODEL_V1) -> str:
    path = posixpath.join(root, version)
    model.write().overwrite().save(path)
    return path


def load_model(
    spark: SparkSession, root: str, version: str = S.MODEL_V1, fallback: str = "models"
) -> PipelineModel:
    """Load a version from ``root``, else from ``fallback``."""
    tried = [posixpath.join(folder, version) for folder in (root, fallback)]
    for path in tried:
        if _exists(spark, path):
            return PipelineModel.load(path)
    raise FileNotFoundError(f"Model not found at {' or '.join(tried)}")


def next_version(spark: SparkSession, root: str) -> str:
    """The first version name, from ``v001`` on, under which no model is saved."""
    number = 1
    while _exists(spark, posixpath.join(root, f"v{number:03d}")):
        number += 1
    return f"v{number:03d}"


def _claim(spark: SparkSession, root: str, name: str) -> bool:
    """Create a file that nobody else has created: true for one caller only."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(posixpath.join(root, "claims", name))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    if fs.getUri().getScheme() == "file":  # where Hadoop's create looks first and then writes
        return jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        fs.create(path, False).close()
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def reserve_version(spark: SparkSession, root: str) -> str:
    """As ``next_version``, and nobody else is given this name."""
    number = int(next_version(spark, root)[1:])
    while not _claim(spark, root, f"v{number:03d}"):
        number += 1
    return f"v{number:03d}"


def promotions(spark: SparkSession, root: str):
    """The log: one folder for each entry, so that writers don't meet."""
    return spark.read.schema(_LOG).option("recursiveFileLookup", True).json(posixpath.join(root, "promotions"))


def active_version(spark: SparkSession, root: str) -> str | None:
    """The version promoted last, or None."""
    try:
        latest = promotions(spark, root).agg(F.max_by("version", F.struct("seq", "at", "version")).alias("version"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return latest.first()["version"]


def promote(spark: SparkSession, root: str, version: str) -> int:
    """Make a saved version the active one; promote an older one to roll back. The number of
    the promotion, which no other has: a number is claimed before its entry is written, and a
    claim that came too late takes the next one. A promoter that dies in between leaves a gap.
    """
    if not _exists(spark, posixpath.join(root, version)):
        raise FileNotFoundError(f"Model not found at {posixpath.join(root, version)}")
    seq = 1
    if active_version(spark, root) is not None:
        seq += promotions(spark, root).agg(F.max("seq")).first()[0]
    while not _claim(spark, root, f"promotion-{seq:08d}"):
        seq += 1
    log = spark.range(1).select(
        F.lit(seq).cast("bigint").alias("seq"), F.lit(version).alias("version"), F.current_timestamp().alias("at")
    )
    log.write.mode("append").json(posixpath.join(root, "promotions", f"{seq:08d}"))
    return seq
