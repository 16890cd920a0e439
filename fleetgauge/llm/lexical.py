"""Ranked lexical search with hashed max-sketches.

A document's sketch has a fixed number of coordinates; each of its terms falls on one by its
hash, and the coordinate keeps the greatest impact among its terms. The weights of an item's
terms, laid on the same coordinates, times the sketches of a block of documents bound the
scores of all items from above in one product. In the order of falling bounds documents are
then scored exactly, until no bound is left that could enter the item's best.

Two passes over the documents: lengths and document counts of the items' terms, then the
sketches, block by block; only the best of each task leave it. Items are taken in passes of
bounded size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Documents returned for an item.
BEST = 50
#: Coordinates of a sketch, a power of two.
COORDINATES = 1024
#: Share of a document's length in its impacts, in percent.
LENGTH = 50
#: Documents of a block and terms after which it ends, documents scored exactly at a time.
BLOCK_DOCS, BLOCK_TERMS, STEP = 4096, 1_000_000, 64
#: Items, and characters of them, that are looked for in one pass over the documents.
PASS_ITEMS, PASS_CHARS = 2000, 1_000_000
#: Parts into which the best of the tasks are dealt before an item's are brought together.
PARTS = 64

_TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_TERM_BYTES).split() if raw else []


def weight(documents: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def _statistics(docs: DataFrame, wanted: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """(documents with a term, terms of all, documents that hold each wanted term)."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, documents, terms = sent.value, Counter(), 0, 0
        for batch in batches:
            for text in batch.column("text").cast(pa.large_binary()):
                own = terms_of(text.as_py())
                documents += bool(own)
                terms += len(own)
                held.update(known.intersection(own))
        # no term is empty: the two totals have names that no term has
        cells = {b"": documents, b" ": terms, **held}
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.binary()), pa.array(list(cells.values()), pa.int64())], names=["term", "n"])

    # one row for each wanted term, which the pass bounds
    sums = {bytes(r[0]): r[1] for r in docs.mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n")).collect()}
    return sums.pop(b"", 0), sums.pop(b" ", 0), sums


class Searcher:
    """The items of a pass, and what their scores need to know of the corpus."""

    def __init__(self, items: list[tuple[int | None, str]], documents: int, terms: int, held: dict[bytes, int]):
        self.ids = [i for i, _ in items]
        self.documents, self.terms = documents, terms
        own = [sorted(set(terms_of(text)) & held.keys()) for _, text in items]
        self.numbers = {t: k for k, t in enumerate(sorted({t for ts in own for t in ts}))}
        self.queries = [np.array([self.numbers[t] for t in ts], np.int64) for ts in own]
        self.weights = np.array([weight(documents, held[t]) for t in self.numbers], np.int64)
        self.table = np.zeros((COORDINATES, len(items)))
        for k, ts in enumerate(own):
            for t in ts:
                self.table[coordinate(t), k] += self.weights[self.numbers[t]]

    def impacts(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = 100 - LENGTH + LENGTH * lengths * self.documents // max(self.terms, 1)
        return 1_000_000_000 * counts // (1000 * counts + 20 * m)


def coordinate(term: bytes) -> int:
    return zlib.crc32(term) & (COORDINATES - 1)


class _Vocabulary(dict):
    """Terms of a block by number."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class Block:
    """Documents of a task that are bounded together."""

    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.vocabulary = _Vocabulary()
        self.size = 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        self.doc_ids.append(doc_id)
        self.tokens.append(np.fromiter(map(self.vocabulary.__getitem__, terms), np.int64, len(terms)))
        self.size += len(terms)

    def finish(self, own: Searcher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sketches, keys, impacts): a key is the document's place and the number of an item's
        term in it, in order."""
        docs, kinds = len(self.tokens), len(self.vocabulary)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        cells = np.repeat(np.arange(docs), lengths) * kinds + np.concatenate(self.tokens)
        cells, counts = np.unique(cells, return_counts=True)
        place, term = cells // kinds, cells % kinds
        impacts = own.impacts(counts, lengths[place])
        coordinates = np.fromiter(map(coordinate, self.vocabulary), np.int64, kinds)
        sketches = np.zeros(docs * COORDINATES)
        np.maximum.at(sketches, place * COORDINATES + coordinates[term], impacts.astype(float))
        number = np.fromiter((own.numbers.get(t, -1) for t in self.vocabulary), np.int64, kinds)[term]
        asked = number >= 0
        keys = place[asked] * len(own.numbers) + number[asked]
        order = np.argsort(keys)
        return sketches.reshape(docs, COORDINATES), keys[order], impacts[asked][order]


class Best:
    """An item's best documents so far in a task: higher scores first, then lesser ids."""

    def __init__(self):
        self.rows: list[tuple[int, bool, int]] = []  # -score, whether without id, id

    def least(self) -> int:
        """The score below which nothing can enter."""
        return -self.rows[-1][0] if len(self.rows) == BEST else 1

    def add(self, scores: np.ndarray, doc_ids: list[int | None]) -> None:
        new = [(-s, d is None, d or 0) for s, d in zip(scores.tolist(), doc_ids, strict=True) if s > 0]
        self.rows = sorted(self.rows + new)[:BEST]


def _rescore(block: Block, own: Searcher, best: list[Best]) -> int:
    """Bring ``best`` up to date with a block; the number of exact scores it took."""
    sketches, keys, impacts = block.finish(own)
    if not len(keys):
        return 0
    bounds, scored = sketches @ own.table, 0
    for k, query in enumerate(own.queries):
        mine = best[k]
        possible = np.flatnonzero(bounds[:, k] >= mine.least())
        possible = possible[np.argsort(-bounds[possible, k], kind="stable")]
        for at in range(0, len(possible), STEP):
            some = possible[at : at + STEP]
            some = some[bounds[some, k] >= mine.least()]
            if not len(some):
                break
            wanted = some[:, None] * len(own.numbers) + query
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            held = np.where(keys[found] == wanted, impacts[found], 0)
            mine.add(held @ own.weights[query], [block.doc_ids[i] for i in some])
            scored += len(some)
    return scored


def _search(docs: DataFrame, own: Searcher) -> DataFrame:
    """The best of each task for each item of ``own``, by the item's place."""
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, block = sent.value, Block()
        best = [Best() for _ in searcher.ids]
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                terms = terms_of(text.as_py())
                if terms:
                    block.add(doc_id, terms)
                if block.size >= BLOCK_TERMS or len(block.doc_ids) == BLOCK_DOCS:
                    _rescore(block, searcher, best)
                    block = Block()
        if block.size:
            _rescore(block, searcher, best)
        rows = [(k, None if none else d, -s) for k, b in enumerate(best) for s, none, d in b.rows]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item int, doc_id long, score long")


def _top(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` and the ``rank`` of each among those equal in ``by``, up to ``BEST``."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def rank_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``BEST`` documents of the highest scores for each
    item, none with score zero, equal scores by ascending id.

    Each distinct (id, text) of ``benchmark`` is an item; items without a term that a document
    holds give no rows. Repeated documents each count for themselves, documents without an id
    come after others of their score. Null and empty texts have no terms. Other columns are
    not looked at; empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    number, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes, out = max(1, -(-number // PASS_ITEMS), -(-chars // PASS_CHARS)), []
    for k in range(passes):
        some = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()]
        wanted = {t for _, text in some for t in terms_of(text)}
        own = Searcher(some, *_statistics(rows, wanted))
        names = F.array(*[F.lit(i).cast("long") for i in own.ids]) if some else F.array(F.lit(None).cast("long"))
        dealt = _search(rows, own).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
        ranked = _top(_top(dealt, "item", "part").drop("rank"), "item")
        out.append(ranked.select(F.element_at(names, F.col("item") + 1).alias("item_id"), "rank", "doc_id", "score"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

#: ``op11_lexical`` in DuckDB's SQL.
ORACLE = f"""
with listed as (select doc_id, {_TERMS} as terms from documents where text is not null),
docs as (select doc_id, terms, len(terms) as n from listed where len(terms) > 0),
corpus as (select count(*) as docs, sum(n)::bigint as terms from docs),
wanted as (select distinct item_id, unnest({_TERMS}) as term from benchmark where text is not null),
asked as (select distinct term from wanted),
held as (
    select doc_id, n, term, count(*) as tf
    from (select doc_id, n, unnest(terms) as term from docs) semi join asked using (term)
    group by doc_id, n, term
),
weights as (
    select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
    from held, corpus group by term, docs
),
impacts as (
    select doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)) as impact
    from held, corpus
),
scores as (
    select item_id, doc_id, sum(w * impact)::bigint as score
    from wanted join impacts using (term) join weights using (term)
    group by item_id, doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scores where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= {BEST}
"""
