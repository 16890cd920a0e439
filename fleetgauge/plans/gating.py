"""The release gate over a file of patches."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetgauge import settings as S
from fleetgauge.plans.models import score_patches
from fleetgauge.plans.scoring import gate, summary_json
from fleetgauge.schemas import normalise_version_col, require_columns
from fleetgauge.sources.files import read_patches, write_scored

PASS, FAIL, UNDECIDED = 0, 1, 2


def score_file(
    spark: SparkSession,
    path: str,
    model: Transformer,
    out_folder: str,
    threshold: float = S.RISK_THRESHOLD,
) -> tuple[int, str]:
    """Score a file, keep the scored copy and decide.

    Returns 0 when no patch is flagged, 1 when any is and 2 when no decision can be made,
    with a JSON summary or the reason: the file does not exist, a filled cell does not
    parse, or a patch has no score. A file without patches passes.
    """
    patches = read_patches(spark, path, lost="_lost")
    if patches is None:
        return UNDECIDED, f"Input features file not found at {path}"
    needed = [*S.RISK_FEATURES, "firmware_version"]
    patches = require_columns(normalise_version_col(patches, needed), needed, path)
    lost = patches.agg(F.coalesce(F.sum("_lost"), F.lit(0))).first()[0]
    if lost:
        return UNDECIDED, f"{lost} cells of {path} do not parse"
    # Written and summarised: score once.
    scored = score_patches(patches, model, threshold).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        write_scored(scored, out_folder, path)
        row = gate(scored).select("exit_code", "n_unscored", summary_json(path).alias("summary")).first()
    finally:
        scored.unpersist()
    if row["exit_code"] == UNDECIDED:
        return UNDECIDED, f"{row['n_unscored']} patches of {path} have no score"
    return row["exit_code"], row["summary"]
