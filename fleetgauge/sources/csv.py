"""CSV files with quoted line breaks, read by many tasks.

A line break ends a row only outside quotes, that is after an even number of them. Each byte
range of a file counts its quotes; sums of these over the ranges before tell whether a range
begins within a quoted cell. Its lines are then put together to rows from the first true row
start on. What a range has of a row that began in an earlier one is joined to it, a few pieces
per range; no other text moves.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Functions of this module travel with the job, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPTIONS = {"escape": '"', "multiLine": "true"}
#: A whole row; the rest of a row of an earlier range; the beginning of one that goes on.
WHOLE, REST, START = 0, 1, 2
PIECES = "file string, block long, kind int, first boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and the start of their byte range, in order within a task."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _open_ranges(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a range begins within a quoted cell."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class _Range:
    """The lines of a range so far that end no row."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.kind, self.held = REST if inside else WHOLE, []
        self.at_header = block == 0

    def add(self, lines: pa.Array) -> tuple[list[int], list[str]]:
        """(kinds, rows) that end in ``lines``."""
        odd = pc.bit_wise_and(pc.count_substring(lines, '"'), 1).to_numpy(zero_copy_only=False).astype(bool)
        ends = np.logical_xor.accumulate(np.concatenate([[self.inside], odd]))[1:] == 0
        self.inside = not ends[-1] if len(ends) else self.inside
        kinds, rows, texts = [], [], lines.to_pylist()
        if not self.held and self.kind == WHOLE and ends.all():
            return [WHOLE] * len(texts), texts
        at = 0
        for end in np.flatnonzero(ends):
            rows.append("\n".join([*self.held, *texts[at : end + 1]]))
            kinds.append(self.kind)
            self.held, self.kind, at = [], WHOLE, end + 1
        self.held += texts[at:]
        return kinds, rows

    def finish(self) -> tuple[list[int], list[str]]:
        """What is left at the end of the range. A range that lies within one row is all rest."""
        if not self.held:
            return [], []
        return [REST if self.kind == REST else START], ["\n".join(self.held)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: _Range | None = None

    def told(kinds: list[int], texts: list[str]) -> pa.RecordBatch:
        n, first = len(kinds), [False] * len(kinds)
        filled = next((i for i, t in enumerate(texts) if t.strip()), None) if own.at_header else None
        if filled is not None:
            first[filled], own.at_header = True, False
        arrays = [pa.array(x, t) for x, t in (([own.file] * n, pa.string()), ([own.block] * n, pa.int64()), (kinds, pa.int32()), (first, pa.bool_()), (texts, pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "kind", "first", "text"])

    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        names = files.dictionary_encode()
        codes = names.indices.to_numpy()
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if at == end:
                continue
            file, block = files[at].as_py(), int(blocks[at])
            if own is None or (own.file, own.block) != (file, block):
                if own is not None:
                    yield told(*own.finish())
                own = _Range(file, block, batch.column("inside")[at].as_py())
            yield told(*own.add(batch.column("value").slice(at, end - at)))
    if own is not None:
        yield told(*own.finish())


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The text of every row of the files but their headers."""
    lines = _lines(spark, path)
    # one row for each byte range; the lines stay in their order
    marked = lines.join(F.broadcast(_open_ranges(lines)), ["file", "block"])
    pieces = marked.select("value", "file", "block", "inside").mapInArrow(_pieces, PIECES)
    parts = pieces.where(F.col("kind") != WHOLE)
    # a row is its start and what follows up to the next start
    order = W.partitionBy("file").orderBy("block", "kind").rowsBetween(W.unboundedPreceding, 0)
    numbered = parts.withColumn("row", F.sum((F.col("kind") == START).cast("long")).over(order))
    joined = numbered.groupBy("file", "row").agg(F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
    texts = F.array_join(F.col("parts.text"), "\n").alias("text")
    return pieces.where((F.col("kind") == WHOLE) & ~F.col("first")).select("text").unionByName(joined.where("not first").select(texts))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files with one header as text columns, as Spark's own reader has them with ``multiLine``.

    Quotes stand around whole cells, a quote within is doubled; line breaks in cells are kept
    as they are. Empty lines are no rows. Row order is not kept. The header is read at once.
    """
    whole = spark.read.options(header=True, **OPTIONS).csv(path)
    header = whole.columns
    if not header:
        return whole
    text = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    rows = _rows(spark, path).select(text.alias("text")).where("text <> ''")
    cells = rows.select(F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(header))), OPTIONS).alias("c"))
    return cells.select("c.*").toDF(*header)
