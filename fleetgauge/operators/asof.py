"""As-of join: for each left row, the newest right row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.functions.expressions import present
from fleetgauge.operators.ranges import Slots


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    tie: str,
    values: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Left rows with ``right_time``, ``tie`` and ``values`` of their match.

    Pairs are never formed. Both sides are laid out in one order of key and time, cut into
    slots and dealt out once; the newest right row so far is the match. Left rows of one time
    are told apart by a hash of all their columns and right rows by ``tie``, so that slots
    stay even where a key, or a time of it, has a great share of all rows.
    """
    on = list(on)
    match = F.struct(F.col(right_time), F.col(tie), *values)
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(on)]
    keys = [f"_k{i}" for i in range(len(on))]
    points = right.where(present(*on, right_time)).select(
        *own, F.col(right_time).alias("_t"), F.lit(False).alias("_probe"), F.col(tie).alias("_tie"), F.lit(0).cast("long").alias("_tail"), match.alias("_match")
    )
    some = left.where(present(*on, left_time)) if how == "inner" else left
    probes = some.select(
        *own, F.col(left_time).alias("_t"), F.lit(True).alias("_probe"), F.xxhash64(*left.columns).alias("_tail"), F.struct(*left.columns).alias("_row")
    )
    both = points.unionByName(probes, allowMissingColumns=True)
    slots = Slots(both, keys, [F.col(c) for c in ("_t", "_probe", "_tie", "_tail")])
    so_far = slots.inside("_t", "_probe", "_tie").rowsBetween(W.unboundedPreceding, 0)
    found = slots.dealt(both).withColumn("_match", F.last("_match", ignorenulls=True).over(so_far)).where("_probe")

    # a slot without right rows of the open key hands on what it was handed
    newest = F.max_by(F.when(~F.col("_probe"), F.col("_match")), F.when(~F.col("_probe"), F.struct("_t", "_tie")))
    handed = slots.handed_on(both, _newest=newest)
    carried = slots.carry(handed, _carried=F.last("_newest", ignorenulls=True).over(slots.over_slots()))
    found = slots.join(found, carried).withColumn("_match", F.coalesce("_match", "_carried"))
    if how == "inner":
        found = found.where(F.col("_match").isNotNull())
    out = [F.col("_match")[c].alias(c) for c in (right_time, tie, *values)]
    return found.select(*[F.col("_row")[c].alias(c) for c in left.columns], *out)
