"""Licences by canonical digest: whole texts and whole lines against known ones.

A text is brought to a canonical form (lower case, no punctuation, no copyright lines, one
of equivalent spellings), and the digest of that form is joined to the digests of known
licences. Only digests meet; texts never move.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm.license_texts import DIGESTS, SPELLINGS, TEXTS
from fleetgauge.llm.shared import add_columns

#: Known digests, 100 bytes each, that are sent to the tasks at most.
MOST_SENT = 100_000

_MARKS = re.compile(r"[^\w\s]|_")
_COPYRIGHT = re.compile(r"[^\w\n©]*(?:copyright\b.*(?:\d{4}|©|\(c\)|<year>|\[year\]|\[yyyy\])|©|\(c\)\s).*|[^\w\n]*all rights reserved\W*")


def canonical(text: str) -> str:
    """The canonical form; empty if nothing but copyright lines and punctuation is there."""
    kept = [x for x in text.lower().splitlines() if not (("copyright" in x or "©" in x or "(c)" in x or "all rights" in x) and _COPYRIGHT.fullmatch(x.strip()))]
    words = _MARKS.sub(" ", "\n".join(kept)).split()
    return " ".join([SPELLINGS.get(w, w) for w in words])


def digest(form: str) -> str | None:
    return hashlib.sha256(form.encode()).hexdigest() if form else None


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, line, digest): of the whole text (line 0) and, if it has several lines, of
    each line that is not empty, counted from 1."""

    def work(column: pa.Array) -> list[pa.Array]:
        out = []
        for text in column.to_pylist():
            lines = (text or "").split("\n")
            found = [(0, digest(canonical(text or "")))]
            if len(lines) > 1:
                found += [(i + 1, digest(canonical(x))) for i, x in enumerate(lines) if x]
            out.append([{"line": i, "digest": d} for i, d in found if d])
        return [pa.array(out, pa.list_(pa.struct([("line", pa.int64()), ("digest", pa.string())])))]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return add_columns(rows, "text", lambda: work, "parts array<struct<line: bigint, digest: string>>").select("doc_id", F.inline("parts"))


def known_licenses(spark: SparkSession, texts=TEXTS, listed=DIGESTS) -> DataFrame:
    """(license_id, digest) of given (identifier, text) pairs and of listed digests.

    The rows come from the driver, so their number is known: up to ``MOST_SENT`` they are sent
    to the tasks, which look digests up where they are made."""
    rows = sorted({*((name, digest(canonical(text))) for name, text in texts if canonical(text)), *listed})
    known = spark.createDataFrame(rows, "license_id string, digest string")
    return F.broadcast(known) if len(rows) <= MOST_SENT else known


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, license_id, digest) of every text and line that is a known licence.

    Line 0 is the whole text. Null, empty and blank texts match nothing; repeated rows are
    reported each, null ids as null. Several identifiers with one digest are all reported.
    Other columns are not looked at; no rows give no rows. Without ``known``, the listed
    licences are sent to the tasks; else Spark chooses the join by its size.
    """
    known = known_licenses(docs.sparkSession) if known is None else known.distinct()
    return digests(docs).join(known, "digest").select("doc_id", "line", "license_id", "digest")
