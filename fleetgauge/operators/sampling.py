"""Samples of a fixed size that no single task has to order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells of [0, 1) in which shares are counted.
CELLS = 1 << 16


def bottom_k(df: DataFrame, share: Column, key: str, k: int) -> DataFrame:
    """The ``k`` rows of least (``share``, ``key``), a share being a number in [0, 1).

    Rows are counted per cell of the share. Cells below the one that holds the k-th row stay
    whole; only that cell's rows are ordered, 1 in ``CELLS`` of all for a hash. Of rows that
    agree in share and key any may be the last. Rows without a share come last.
    """
    rows = df.withColumn("_share", share).withColumn("_cell", F.coalesce(F.floor(F.col("_share") * CELLS), F.lit(CELLS)))
    counts = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_cell"))
    # the first cell with which there are k rows, and the rows before it
    reached = counts.withColumn("_through", so_far).where(F.col("_through") >= k)
    last = reached.agg(F.min(F.struct("_cell", (F.col("_through") - F.col("_n")).alias("_before"))).alias("_last")).scalar()
    marked = rows.withColumn("_last", last)
    cell, place = F.col("_last._cell"), F.row_number().over(W.partitionBy("_cell").orderBy(F.asc_nulls_last("_share"), key))
    whole = marked.where(cell.isNull() | (F.col("_cell") < cell))
    cut = marked.where(F.col("_cell") == cell).withColumn("_place", place).where(F.col("_place") <= k - F.col("_last._before"))
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))
