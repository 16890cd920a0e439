"""Ordered computations that never gather a whole group in one task.

Running totals and ranks are scans over ranges (``ranges.Slots``), quantiles are selected
inside brackets that sketches give. For the row before, a date is cut into ordered cells; a
small summary per cell carries the state across. The results are those of plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.functions.expressions import present
from fleetgauge.operators.ranges import Slots

SEQ_BLOCK = 1 << 20
#: Accuracy of the rank sketches: ranks are right to one in so many rows.
SKETCH = 10_000


def running_totals(
    values: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``<s>_before``: the sum of ``s`` over all rows ordered before this one.

    ``values`` holds one row per (``by``, ``value``), so equal values are already
    collapsed; count or sum them first. Rows without a value or group, and NaN, are left out.
    """
    by = list(by)
    number = F.col(value).cast("double")
    rows = values.where(present(*by, value) & ~F.isnan(number))
    slots = Slots(rows, by, [-number if descending else number])
    key = F.desc(value) if descending else F.asc(value)
    earlier = slots.inside(key).rowsBetween(W.unboundedPreceding, -1)
    inner = slots.dealt(rows).select(
        "*", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in sums]
    )
    handed = slots.handed_on(rows, **{f"_{s}_slot": F.sum(s) for s in sums})
    carried = slots.carry(handed, **{f"_{s}_carried": F.sum(f"_{s}_slot").over(slots.over_slots()) for s in sums})
    return slots.join(inner, carried).select(
        *[F.col(c) for c in values.columns],
        *[(F.col(f"{s}_before") + F.coalesce(f"_{s}_carried", F.lit(0))).alias(f"{s}_before") for s in sums],
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value: its count ``n`` and the mean rank of its ties."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, value, ["n"], by)
    return ranked.select(
        *by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank")
    )


def _brackets(df: DataFrame, columns: Sequence[str], qs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """One row per group: for each column its count ``n`` and, per quantile, a ``low`` and a
    ``high`` between which the wanted ranks lie, from mergeable rank sketches."""
    wide = 2.0 / SKETCH
    shares = [min(max(q + side, 0.0), 1.0) for q in qs for side in (-wide, wide)]
    found = []
    for c in columns:
        number = F.nanvl(F.col(c).cast("double"), F.lit(None))
        n, least, most, marks = F.count(number), F.min(number), F.max(number), F.percentile_approx(number, shares, SKETCH)
        # below so many rows a sketch's error is less than one rank
        small = n <= SKETCH
        ends = [
            F.struct(
                F.when(small | F.lit(q <= 0), least).otherwise(marks[2 * i]).alias("low"),
                F.when(small | F.lit(q >= 1), most).otherwise(marks[2 * i + 1]).alias("high"),
            )
            for i, q in enumerate(qs)
        ]
        found.append(F.struct(n.alias("n"), F.array(*ends).alias("ends")))
    return df.groupBy(*by).agg(F.array(*found).alias("_known"))


def quantiles_of(df: DataFrame, columns: Sequence[str], qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (``by``, ``column``, ``q``).

    Two reads, however many columns and quantiles: sketches bracket the wanted ranks, then
    each value is below a bracket, in it or above. Only values in a bracket, a share of
    ``4 / SKETCH`` of the rows, are told apart; all others are counted. Null and NaN are left
    out, and groups with a null key; a column without values has no rows.
    """
    by = list(by)
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    rows = rows.where(present(*by)) if by else rows
    numbers = [f"_c{i}" for i in range(len(columns))]
    known = _brackets(rows, numbers, qs, by)
    if by:
        marked = rows.join(known, by)
    else:
        marked = rows.withColumn("_known", known.scalar())

    def entry(i: int, k: int) -> Column:
        v, end = F.col(numbers[i]), F.col("_known")[i]["ends"][k]
        within = F.when(v >= end["low"], v)  # null for what is below
        keep = v.isNotNull() & ~F.isnan(v) & (v <= end["high"])
        return F.when(keep, F.struct(F.lit(i).alias("_i"), F.lit(k).alias("_k"), F.col("_known")[i]["n"].alias("_n"), within.alias("_v")))

    entries = F.array_compact(F.array(*[entry(i, k) for i in range(len(columns)) for k in range(len(qs))]))
    place = [*by, "_i", "_k"]
    counts = marked.select(*by, F.inline(entries)).groupBy(*place, "_n", "_v").agg(F.count(F.lit(1)).alias("_rows"))
    # nulls first: what is below the bracket
    through = F.sum("_rows").over(W.partitionBy(*place).orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0))
    last = F.col("_n") - 1
    pos = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_k") + 1) * last
    hit = lambda rank: (rank >= F.col("_through") - F.col("_rows")) & (rank < F.col("_through"))
    ends = counts.withColumn("_through", through).groupBy(*place, "_n").agg(
        F.max(F.struct(hit(F.floor(pos)).alias("hit"), F.col("_v").alias("v"))).alias("_low"),
        F.max(F.struct(hit(F.ceil(pos)).alias("hit"), F.col("_v").alias("v"))).alias("_high"),
    )
    low, high = F.col("_low.v"), F.col("_high.v")
    # equal ends first: the difference of two infinite ones is no number
    between = F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos)))
    sound = F.col("_low.hit") & F.col("_high.hit") & low.isNotNull() & high.isNotNull()
    value = F.when(sound, between).otherwise(F.raise_error(F.lit("a sketch missed a quantile's rank")).cast("double"))
    names, shares = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(float(q)) for q in qs])
    return ends.select(
        *by, F.element_at(names, F.col("_i") + 1).alias("column"), F.element_at(shares, F.col("_k") + 1).alias("q"), value.alias("value")
    )


def quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``quantiles_of`` for one column: one row per (``by``, ``q``)."""
    return quantiles_of(df, [value], qs, by).select(*by, "q", "value")


def previous_row(
    df: DataFrame,
    line: str,
    date: str,
    seq: str,
    columns: Sequence[str],
    block: int = SEQ_BLOCK,
) -> DataFrame:
    """Add ``_previous``: a struct of ``columns`` of the row just before this one.

    Order within ``line`` is (``date``, ``seq``), ``seq`` being a unique integer.
    Cells are (line, date, block of seq), so one holds at most ``block`` rows;
    the last row of a cell is carried to the next cell of that date, the last
    row of a date to the next date. Rows without line, date or ``seq`` stay, with
    no row before them and none after.
    """
    payload = F.struct(*columns)
    placed = present(line, date, seq)
    # rows without a place are spread by their content
    rows = df.withColumn(
        "_block", F.when(placed, F.floor(F.col(seq) / F.lit(block))).otherwise(F.xxhash64(*df.columns))
    )
    cells = rows.where(placed).groupBy(line, date, "_block").agg(F.max_by(payload, F.col(seq)).alias("_last"))
    dates = cells.groupBy(line, date).agg(F.max_by("_last", "_block").alias("_last"))
    dates = dates.select(
        line, date, F.lag("_last").over(W.partitionBy(line).orderBy(date)).alias("_day_before")
    )
    in_date = F.lag("_last").over(W.partitionBy(line, date).orderBy("_block"))
    carried = (
        cells.select(line, date, "_block", in_date.alias("_block_before"))
        .join(dates, [line, date])
        .select(
            line, date, "_block", F.coalesce("_block_before", "_day_before").alias("_carried")
        )
    )
    in_cell = F.lag(payload).over(W.partitionBy(line, date, "_block").orderBy(seq))
    return (
        rows.select("*", in_cell.alias("_in_cell"))
        .join(carried, [line, date, "_block"], "left")
        .select(*df.columns, F.when(placed, F.coalesce("_in_cell", "_carried")).alias("_previous"))
    )


def previous_in_cells(
    df: DataFrame, cells: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Add ``_previous``: a struct of ``columns`` of the row before this one in the order of
    ``cells``, then ``order``, over the whole frame.

    A window runs inside the innermost cells; the last row of each cell is carried to the
    next one of the same outer cell, level by level. Only the outermost cells, one row
    each, meet in one window.
    """
    payload, cells = F.struct(*columns), list(cells)
    place = F.struct(*order)
    out = df.withColumn("_previous", F.lag(payload).over(W.partitionBy(*cells).orderBy(*order)))
    lasts = df.groupBy(*cells).agg(F.max_by(payload, place).alias("_last"))
    for depth in range(len(cells), 0, -1):
        outer, own = cells[: depth - 1], cells[depth - 1]
        before = F.lag("_last").over(W.partitionBy(*outer or [F.lit(0)]).orderBy(own))
        carried = lasts.select(*cells[:depth], before.alias("_carried"))
        same = reduce(and_, [out[c].eqNullSafe(carried[c]) for c in cells[:depth]])
        kept = [out[c] for c in out.columns if c != "_previous"]
        out = out.join(carried, same, "left").select(*kept, F.coalesce(out["_previous"], carried["_carried"]).alias("_previous"))
        if outer:
            lasts = lasts.groupBy(*outer).agg(F.max_by("_last", own).alias("_last"))
    return out
