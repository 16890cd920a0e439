"""Pairs of items, without joining the raw rows to themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.expressions import present


def pair_support(df: DataFrame, holder: str, item: str, minimum: int) -> DataFrame:
    """Item pairs and the number of holders that have both, from ``minimum`` up.

    Holders with the same set of items are counted together before any pair is
    written, so the pairs grow with the distinct sets and not with the holders.
    An item with fewer than ``minimum`` holders cannot be in a result pair and
    leaves before the sets are built.
    """
    held = df.select(holder, item).where(present(holder, item)).distinct()
    frequent = (
        held.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    )
    sets = (
        held.join(frequent.select(item), item, "left_semi")
        .groupBy(holder)
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .where(F.size("_items") > 1)
        .groupBy(F.xxhash64("_items").alias("_set"), "_items")
        .agg(F.count(F.lit(1)).alias("_holders"))
    )
    firsts = sets.select("_set", "_items", "_holders", F.posexplode("_items").alias("_at", "item_1"))
    rest = F.slice("_items", F.col("_at") + 2, F.size("_items"))
    # dealt out by set and place, so that no task writes all pairs of a large set
    firsts = firsts.select("_set", "_at", "item_1", rest.alias("_rest"), "_holders").repartition("_set", "_at")
    pairs = firsts.select("item_1", F.explode("_rest").alias("item_2"), "_holders")
    return (
        pairs.groupBy("item_1", "item_2")
        .agg(F.sum("_holders").alias("holders"))
        .where(F.col("holders") >= minimum)
    )


def blocked_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, condition: Column, blocks: int = 8
) -> DataFrame:
    """Theta join as an equi-join of ``blocks`` x ``blocks`` tiles.

    Each row goes to one block and to every tile of that block's row or column,
    so each pair meets in exactly one tile. The work spreads over all tiles and
    neither side has to fit in memory; raise ``blocks`` with the number of rows.
    """
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    tall = left.withColumn("_row", F.pmod(F.xxhash64(left_key), F.lit(blocks)).cast("int"))
    wide = right.withColumn("_col", F.pmod(F.xxhash64(right_key), F.lit(blocks)).cast("int"))
    tall = tall.withColumn("_col", F.explode(every))
    wide = wide.withColumn("_row", F.explode(every))
    return tall.join(wide, ["_row", "_col"]).where(condition).drop("_row", "_col")
