"""Ordered scans over ranges of (key, order).

A plain window over a big group sorts that group in one task. Here rows are cut into slots
at borders sampled from their own positions, so that every slot holds a bounded share of the
rows whatever their keys: a small key lies within one slot, a hot one goes through many. Rows
are dealt out once, by slot; windows run inside a slot. What a hot key's slots hand on, one
small row each, is found beside it without moving the rows, carried over the slots and
joined back. Between one slot and the next at most the key at their border is open, so there
are no more such rows than slots and they may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions that are sampled for each slot.
SAMPLED = 32
_UNIT = 1 << 30


class Slots:
    """Borders of the ranges of (``key``, ``order``) over the rows of ``df``.

    Rows are sampled by their hash, so the borders are those of the same rows however they are
    dealt out. Rows that agree in key and all of ``order`` share a slot. All passes look at all
    columns and filter no earlier than at their end, so that those before the last one share
    the shuffles by which ``df`` is computed.
    """

    def __init__(self, df: DataFrame, key: Sequence[str], order: Sequence[Column]):
        self.number = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.key, self.whole = list(key), F.xxhash64(*df.columns)
        self.position = F.struct(F.xxhash64(*self.key, F.lit(0)).alias("key"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
        total = df.agg(F.count_if(self.whole != 0)).scalar()
        chance = F.try_divide(F.lit(float(SAMPLED * self.number * _UNIT)), total)
        drawn = df.where(F.pmod(self.whole, F.lit(_UNIT)) < chance).select(self.position.alias("p"))
        ranked = drawn.agg(F.array_sort(F.collect_set("p")).alias("s"))
        places = F.sequence(F.lit(1), F.lit(self.number - 1))
        cut = F.transform(places, lambda i: F.get("s", F.floor(i * F.size("s") / self.number).cast("int")))
        self.borders = ranked.select(F.array_distinct(F.filter(cut, lambda b: b.isNotNull()))).scalar()

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` with its ``_slot`` and whether its key is that of the next slot's first row."""
        halves = [1 << k for k in reversed(range((self.number - 1).bit_length()))]
        known = df.withColumn("_borders", self.borders)
        at = lambda i: F.get("_borders", i)

        # the position goes along, as in the function's body it would be computed each time
        def halve(state: Column, step: Column) -> Column:
            above = at(state["low"] + step - 1) <= state["position"]
            return F.struct(F.when(above, state["low"] + step).otherwise(state["low"]).alias("low"), state["position"].alias("position"))

        start = F.struct(F.lit(0).alias("low"), self.position.alias("position"))
        found = F.aggregate(F.array(*[F.lit(h) for h in halves]), start, halve)
        placed = known.withColumn("_found", found).withColumn("_slot", F.col("_found.low"))
        open_ = F.coalesce(at(F.col("_slot"))["key"] == F.col("_found.position")["key"], F.lit(False))
        return placed.withColumn("_open", open_).drop("_borders", "_found")

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` with its ``_slot``, one task for the rows of a slot."""
        return self.add(df).drop("_open").repartition("_slot")

    def handed_on(self, df: DataFrame, **states: Column) -> DataFrame:
        """(``_slot``, key, states): aggregates over the rows of a slot whose key is open at its
        end, under the number of the next slot."""
        # one product, as the parts of a conjunction would be moved apart
        open_ = self.whole.bitwiseOR(F.lit(1)) * F.col("_open").cast("long") != 0
        summed = self.add(df).where(open_).groupBy("_slot", *self.key).agg(*[s.alias(name) for name, s in states.items()])
        return summed.withColumn("_slot", F.col("_slot") + 1)

    def carry(self, handed: DataFrame, **states: Column) -> DataFrame:
        """``handed`` with states over all slots of the key up to this one; broadcast, see above."""
        return F.broadcast(handed.select("_slot", *self.key, *[s.alias(name) for name, s in states.items()]))

    def over_slots(self) -> W:
        """The window over a key's slots so far."""
        return W.partitionBy(*self.key, F.lit(0)).orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)

    def inside(self, *order: Column | str) -> W:
        return W.partitionBy("_slot", *self.key).orderBy(*order)

    def join(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        return rows.join(carried, ["_slot", *self.key], "left")
