"""Exact duplicates by progressive refinement.

Texts are equal when they are the same without white space. Equal texts have equal lengths,
then equal beginnings, then equal hashes: each row first gets the length of its text and a
hash of its beginning, a small table. Rows whose length no other row has are done; of the
rest, those whose beginning no other row of that length has. Only the texts that are left
are read again and hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import write_shared

#: Characters of a text's beginning.
HEAD = 64


def normalised(text: Column) -> Column:
    """``text`` without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest(text: Column) -> Column:
    """The hash by which whole texts are compared."""
    return F.sha2(normalised(text), 256)


def find_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, keep_id, group_size, kept) of every row of ``docs``; ``row`` has its columns but
    the text.

    Of equal texts, the row whose text has the most characters stays, then that of the least
    id, and of rows that agree in both the first one met. ``keep_id`` is the id of the row
    that stays. A null text is an empty one and equals all blank ones. An id that is null
    comes after all others and may be the one that stays. Repeated rows are rows of their
    own. No rows give no rows.
    """
    others = [c for c in docs.columns if c != text]
    plain, whole = normalised(F.col("text")), F.col("text")
    given = docs.select(F.struct(*others).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    signed = given.withColumns({"points": F.char_length(whole), "size": F.length(plain), "head": F.xxhash64(F.substring(plain, 1, HEAD))})
    rows = write_shared(signed.drop("text"))
    # written, so that rows of a frequent length are summed before they are dealt out by it
    heads = write_shared(rows.groupBy("size", "head").agg(F.count("*").alias("n")))
    lengths = heads.groupBy("size").agg(F.sum("n").alias("rows")).where("rows > 1")
    heads = write_shared(heads.where("n > 1").join(lengths, "size", "left_semi").select("size", "head"))
    alone = rows.join(heads, ["size", "head"], "left_anti").select(
        "row", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    left = signed.join(heads, ["size", "head"], "left_semi")
    hashed = write_shared(left.select("row", "doc_id", "points", "size", digest(whole).alias("digest"), F.monotonically_increasing_id().alias("place")))
    best = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("place"))
    groups = write_shared(hashed.groupBy("size", "digest").agg(F.count("*").alias("group_size"), F.min(best).alias("best")))
    named = hashed.join(groups, ["size", "digest"]).select(
        "row", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.place") == F.col("place")).alias("kept")
    )
    return named.unionByName(alone)


#: ``op13_exact`` in DuckDB's SQL.
ORACLE = r"""
with plain as (
    select doc_id, length(coalesce(text, '')) as points,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
    from documents
),
placed as (
    select doc_id, body,
        first_value(doc_id) over (partition by body order by points desc, doc_id) as keep_id,
        count(*) over (partition by body) as group_size
    from plain
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256
from placed
"""
