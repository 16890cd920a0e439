"""Tables that several passes read, in the folder all executors share; word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.sources.shared import remove_shared, shared_folder, write_shared  # noqa: F401

#: Rows that a task's Python function gets at a time.
ROWS = 500

#: White space between words, and the other side of it, as the operators' contracts fix them.
SPACES = r"[\x20\x09-\x0D]+"


def add_columns(df: DataFrame, column: str, start: Callable[[], Callable], schema: str) -> DataFrame:
    """``df`` and the columns of ``schema``. Each task calls ``start`` once; what it returns
    gets the Arrow array ``column`` of some rows and returns the new columns' arrays."""
    added = T.StructType.fromDDL(schema)
    place, names = df.columns.index(column), [*df.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(place))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def fold(of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; rows without an id are in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(0)).cast("int")
