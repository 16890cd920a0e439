"""Language-model scores by deleted interpolation of word n-grams.

The probability of a word after a context mixes three maximum-likelihood estimates: of the
word after this context, of the word alone, and of any word. The context is the word before,
or a text's start. The weights depend on the context's frequency (a power of two makes a
bucket) and are learned by expectation-maximisation on the counts of a held-out part of the
training rows, with estimates from the rest; scores then use the counts of all training rows.

Three passes over the documents: words are counted; pairs are counted, which gives the
held-out counts and the most frequent pairs; all places where a pair occurs are scored.
A pass turns blocks of documents into packed arrays, one for each part of the words' hashes.
The ``LISTED`` most frequent words are known to all tasks and dealt out by their pairs, so
that no part grows with one word, and pairs that are frequent themselves are scored where they
stand. A part has the counts of its pairs and words; the count of a context that is not listed
comes from the table of all words, to which its pairs are dealt once more. So the list decides
what is shuffled, never a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import fold, write_shared

#: The most frequent words, whose counts all tasks know; with two other contexts, one for
#: all unlisted words and one for a text's start, they fit 16 bits.
LISTED = 60_000
#: Numbers from here on stand for a part's unlisted contexts.
UNLISTED = 1 << 16
#: A pair with more than this share of all training tokens is frequent.
FREQUENT = 1 / 5000
#: Tokens of a block, and tokens of a part that one task merges, on average.
BLOCK, PART = 2_500_000, 4_000_000
#: Documents of a block at most, so that a place and a flag fit 16 bits.
BLOCK_DOCS = 32_767
HELD_OUT, TUNING, FOLDS = 0, 1, 10
ROUNDS = 60
#: Width of the cells in which held-out counts are summed, in natural log.
CELL = 0.05
#: The cell of estimates of zero.
NEVER = -99_999
ADDED = 0.1
#: The end of a text, as a word; no word has this hash but by chance.
END = -1


class _Numbers(dict):
    """Words by a number of the block's own, in order of appearance; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Block:
    """Tokens of some documents."""

    def __init__(self):
        self.numbers = _Numbers({b"": 0})
        self.tokens: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.folds: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, fold: int, text: bytes | None) -> None:
        words = text.lower().split() if text else []
        self.tokens.append(np.array([*map(self.numbers.__getitem__, words), 0], np.int32))
        self.doc_ids.append(doc_id)
        self.folds.append(fold)
        self.size += len(words) + 1

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, word, document and fold of each token); word 0 is the end."""
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.numbers], np.uint64).view(np.int64)
        hashes[0] = END
        lengths = [len(t) for t in self.tokens]
        docs = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
        words = np.concatenate(self.tokens)
        self.tokens, self.numbers = [], _Numbers()
        return hashes, words, docs, np.repeat(np.array(self.folds, np.int8), lengths)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of the rows (doc_id, fold, text) of a task."""
    block = Block()
    for batch in batches:
        for doc_id, row_fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
            block.add(doc_id, row_fold, text.as_py())
            if block.size >= BLOCK or len(block.doc_ids) == BLOCK_DOCS:
                yield block
                block = Block()
    if block.size:
        yield block


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n, tuning): training count of each word's hash, and its part in the tuning fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes, words, _, folds = block.finish()
            n = np.bincount(words[folds != HELD_OUT], minlength=len(hashes))
            tuning = np.bincount(words[folds == TUNING], minlength=len(hashes))
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (hashes, n, tuning)], names=["word", "n", "tuning"])

    counted = rows.mapInArrow(run, "word long, n long, tuning long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("tuning").alias("tuning"))


class Model:
    """What all tasks know: totals, the frequent words and pairs, the weights."""

    def __init__(self, totals: tuple[int, int, int], texts: tuple[int, int], words: np.ndarray):
        self.tokens, self.tuning, self.kinds = totals
        order = np.argsort(words[:, 0])
        self.words, self.n, self.n_tuning = words[order].T
        # by context: the words, any unlisted one (counted elsewhere), the start
        self.context_n = np.concatenate([self.n, [0, texts[0]]])
        self.context_tuning = np.concatenate([self.n_tuning, [0, texts[1]]])
        self.pairs = np.zeros((0, 3), np.int64)
        self.weights: np.ndarray | None = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the frequent words, or their number."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        return np.where(self.words[at] == hashes, at, len(self.words)) if len(self.words) else np.zeros(len(hashes), np.int64)

    def contexts(self, words: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word before, context) of each token; ``place`` has the listed word's place of each
        of the block's words."""
        before = np.concatenate([[0], words[:-1]]).astype(words.dtype)  # a text follows the end of another
        return before, np.where(before == 0, len(self.words) + 1, place[before]).astype(np.uint16)

    def bucket(self, seen: np.ndarray) -> np.ndarray:
        """0 for a context never seen, else 1 and the whole binary log of its frequency."""
        return np.frexp(seen.astype(float))[1]

    def score(self, pair: np.ndarray, word: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """log10 of the mixture for counts of pairs, of their words and of their contexts."""
        mix = self.weights[self.bucket(seen)]
        high, low, any_word = pair / np.maximum(seen, 1), word / max(self.tokens, 1), 1 / (self.kinds + 1)
        return np.log10(mix[:, 0] * high + mix[:, 1] * low + mix[:, 2] * any_word)

    def base(self, word: np.ndarray) -> np.ndarray:
        return np.log10((word + ADDED) / (self.tokens + ADDED * (self.kinds + 1)))

    def pair_keys(self) -> np.ndarray:
        return self.pairs[:, 0] * 65_536 + self.pairs[:, 1]  # place of the word, context


def _parts(hashes: np.ndarray, before: np.ndarray, listed: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair: by its word's hash, or by both words' if its own is listed."""
    mixed = hashes.astype(np.uint64) ^ np.where(listed, (before.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values (or rows of values) start."""
    rows = x if x.ndim == 2 else x[:, None]
    return np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(x) else np.zeros(0, np.int64)


def _by_part(part: np.ndarray, word: np.ndarray, hashes: np.ndarray, place: np.ndarray, listed: int) -> np.ndarray:
    """An order by part, then the listed words by their place, then the others by their hashes."""
    rank = np.empty(len(hashes), np.int64)
    rank[np.argsort(hashes)] = np.arange(listed, listed + len(hashes))
    rank = np.where(place < listed, place, rank)
    return np.argsort(part * (listed + len(hashes)) + rank[word])


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers by their first bytes, then their second ones, so that small ones compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).view(kind).ravel()


#: Packed pairs: steps between places of the listed words (planes), hashes of the others and how often each follows,
#: contexts of all pairs, hashes of the unlisted contexts.
PAIRS = ["places", "words", "lengths", "contexts", "unlisted"]


def _packed(word: np.ndarray, before: np.ndarray, context: np.ndarray, hashes: np.ndarray, place: np.ndarray, listed: int) -> list[bytes]:
    """Pairs in the order of ``_by_part`` as the columns ``PAIRS``."""
    first = np.count_nonzero(place[word] < listed)
    others = word[first:]
    starts = _runs(others)
    lengths = np.diff(np.append(starts, len(others))).astype(np.uint32)
    steps = np.diff(place[word[:first]], prepend=0).astype(np.uint16)
    return [_planes(steps), *(x.tobytes() for x in (hashes[others[starts]], lengths, context, hashes[before[context == listed]]))]


def _split(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    borders = [*_runs(part), len(part)]
    for a, b in pairwise(borders):
        yield int(part[a]), slice(a, b)


def pair_counts(rows: DataFrame, sent, parts: int) -> DataFrame:
    """(part, ``PAIRS``, rest, tuning): packed training counts of pairs."""
    names = ["part", *PAIRS, "rest", "tuning"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        listed = len(model.words)
        for block in blocks(batches):
            hashes, words, _, folds = block.finish()
            place = model.find(hashes)
            before, _ = model.contexts(words, place)
            train = folds != HELD_OUT
            # one number for word, word before and fold: equal pairs lie together once sorted
            key = np.sort((words[train].astype(np.int64) << 32 | before[train]) << 1 | (folds[train] == TUNING))
            starts = _runs(key >> 1)
            n = np.diff(np.append(starts, len(key)))
            tuning = (np.add.reduceat(key & 1, starts) if len(key) else n).astype(np.uint32)
            rest = n.astype(np.uint32) - tuning
            word, before = key[starts] >> 33, key[starts] >> 1 & 0xFFFFFFFF
            context = np.where(before == 0, listed + 1, place[before]).astype(np.uint16)
            part = _parts(hashes[word], hashes[before], place[word] < listed, parts)
            order = _by_part(part, word, hashes, place, listed)
            part, word, before, context, tuning, rest = (x[order] for x in (part, word, before, context, tuning, rest))
            for p, s in _split(part):
                cells = [*_packed(word[s], before[s], context[s], hashes, place, listed), rest[s].tobytes(), tuning[s].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([p])] + [pa.array([c], pa.binary()) for c in cells], names=names)

    return rows.mapInArrow(run, "part long, " + ", ".join(f"{n} binary" for n in names[1:]))


def _unpacked(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _from_rows(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_from_planes(x, kind) for x in table.column(name).to_pylist())])


def _pair_keys(table: pa.Table, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of word and context of each packed pair, hashes of the unlisted contexts).

    A listed word's number is its place, others follow; so do unlisted contexts from
    ``UNLISTED`` on, in the order of their hashes.
    """
    _, number = np.unique(_unpacked(table, "words", "<i8"), return_inverse=True)
    words, at = [np.zeros(0, np.int64)], 0
    for places, lengths in zip(table.column("places").to_pylist(), table.column("lengths").to_pylist(), strict=True):
        lengths = np.frombuffer(lengths, "<u4")
        words += [np.cumsum(_from_planes(places, "<u2"), dtype=np.int64), np.repeat(listed + number[at : at + len(lengths)], lengths)]
        at += len(lengths)
    contexts = _unpacked(table, "contexts", "<u2").astype(np.int64)
    unlisted, number = np.unique(_unpacked(table, "unlisted", "<i8"), return_inverse=True)
    contexts[contexts == listed] = UNLISTED + number
    return np.concatenate(words) << 32 | contexts, unlisted


def _merge_pairs(sent):
    """Rows (kind, a, b, c, n) from all packed counts of a part: held-out counts by cells
    (kind 0), frequent pairs (1), and held-out counts n of pairs whose context has the hash a,
    which is not listed, with the counts b of the pair and c of its word (2)."""

    def merge(table: pa.Table) -> pa.Table:
        model = sent.value
        key, unlisted = _pair_keys(table, len(model.words))
        order = np.argsort(key)
        key = key[order]
        starts = _runs(key)
        rest, tuning = (np.add.reduceat(_unpacked(table, c, "<u4")[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64) for c in ("rest", "tuning"))
        kind, contexts = key[starts] >> 32, key[starts] & 0xFFFFFFFF
        listed = kind < len(model.words)
        alone = _totals(kind, rest)
        alone[listed] = (model.n - model.n_tuning)[kind[listed]]
        later = (tuning > 0) & (contexts >= UNLISTED)
        held = (tuning > 0) & ~later
        seen = model.context_n[contexts[held]]
        high = rest[held] / np.maximum(seen - model.context_tuning[contexts[held]], 1)
        low = alone[held] / max(model.tokens - model.tuning, 1)
        with np.errstate(divide="ignore"):
            cells = [np.maximum(np.round(np.log(x * (model.kinds + 1)) / CELL), NEVER).astype(np.int64) for x in (high, low)]
        often = (rest + tuning > FREQUENT * model.tokens) & listed & (contexts < UNLISTED)
        columns = {
            "kind": np.repeat([0, 1, 2], [held.sum(), often.sum(), later.sum()]),
            "a": np.concatenate([model.bucket(seen), kind[often], unlisted[contexts[later] - UNLISTED]]),
            "b": np.concatenate([cells[0], contexts[often], rest[later]]),
            "c": np.concatenate([cells[1], np.zeros(often.sum(), np.int64), alone[later]]),
            "n": np.concatenate([tuning[held], (rest + tuning)[often], tuning[later]]),
        }
        return pa.table({k: v.astype(np.int64) for k, v in columns.items()}).group_by(["kind", "a", "b", "c"]).aggregate([("n", "sum")]).rename_columns(["kind", "a", "b", "c", "n"])

    return merge


def _later_cells(found: DataFrame, counted: DataFrame, model: Model) -> DataFrame:
    """The rows of kind 2 as cells, with their contexts' counts from the table of all words."""

    def cell(ratio):
        return F.coalesce(F.round(F.log(ratio * (model.kinds + 1)) / CELL), F.lit(NEVER)).cast("long")

    seen = counted.select(F.col("word").alias("a"), F.col("n").alias("seen"), F.col("tuning").alias("seen_tuning"))
    return found.where("kind = 2").join(seen, "a").select(
        F.lit(0).cast("long").alias("kind"), F.length(F.bin("seen")).cast("long").alias("a"),
        cell(F.col("b") / F.greatest(F.col("seen") - F.col("seen_tuning"), F.lit(1))).alias("b"),
        cell(F.col("c") / max(model.tokens - model.tuning, 1)).alias("c"), "n",
    )


def _totals(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For sorted words, the sum of ``n`` over each word's rows, at every row."""
    starts = _runs(words)
    if not len(starts):
        return n
    return np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, len(words))))


def learn_weights(cells: np.ndarray, buckets: int = 65) -> np.ndarray:
    """Weights (bucket, estimate) from cells (bucket, log ratios of both estimates to that of
    any word, n). A bucket without counts gets the weights of all buckets together; in bucket
    0, of contexts never seen, the pair's estimate has none."""

    def fit(own: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        mix = allowed / allowed.sum()
        ratios = np.stack([np.exp(own[:, 1] * CELL), np.exp(own[:, 2] * CELL), np.ones(len(own))], axis=1)
        for _ in range(ROUNDS if len(own) else 0):
            share = ratios * mix
            mix = (share / share.sum(axis=1, keepdims=True) * own[:, 3:]).sum(axis=0) / own[:, 3].sum()
            mix = np.maximum(mix, 1e-9 * allowed) / np.maximum(mix, 1e-9 * allowed).sum()
        return mix

    every = np.array([1.0, 1.0, 1.0])
    general = fit(cells, every)
    out = np.stack([fit(own, every) if len(own := cells[cells[:, 0] == b]) else general for b in range(buckets)])
    out[0] = fit(cells[cells[:, 0] == 0], np.array([0.0, 1.0, 1.0]))
    return out


def place_pairs(rows: DataFrame, sent, parts: int) -> DataFrame:
    """Packed places of pairs by part; sums of the frequent pairs go with the block's first."""
    names = ["part", "block", "doc_ids", *PAIRS, "docs", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        listed = len(model.words)
        keys = model.pair_keys()
        order = np.argsort(keys)
        keys, pair_n = keys[order], model.pairs[order, 2]
        first = TaskContext.get().partitionId() << 24
        for number, block in enumerate(blocks(batches)):
            hashes, words, docs, folds = block.finish()
            place = model.find(hashes)
            before, contexts = model.contexts(words, place)
            done = np.zeros(len(words), bool)
            sums = np.zeros((len(block.doc_ids), 3))
            if len(keys):
                key = place[words] * 65_536 + contexts
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                done = (keys[at] == key) & (place[words] < listed)
                word = model.n[place[words[done]]]
                score = model.score(pair_n[at[done]], word, model.context_n[contexts[done]])
                for i, x in enumerate((score, model.base(word), word > 0)):
                    sums[:, i] = np.bincount(docs[done], x, len(sums))
            left = np.flatnonzero(~done)
            word, follows, context, doc = words[left], before[left], contexts[left], docs[left]
            part = _parts(hashes[word], hashes[follows], place[word] < listed, parts)
            order = _by_part(part, word, hashes, place, listed)
            part, word, follows, context, doc = (x[order] for x in (part, word, follows, context, doc))
            train = (np.array(block.folds) != HELD_OUT).astype(np.uint16)
            lengths = np.bincount(docs, minlength=len(sums))
            pieces = [(p, s, None) for p, s in _split(part)]
            pieces.append((((first >> 24) + number) % parts, slice(0, 0), np.column_stack([sums, lengths])))
            for p, s, own in pieces:
                cells = [*_packed(word[s], follows[s], context[s], hashes, place, listed), (doc[s] << 1 | train[doc[s]]).tobytes()]
                ids = pa.array([block.doc_ids if own is not None else None], pa.list_(pa.int64()))
                columns = [pa.array([p]), pa.array([first + number]), ids]
                columns += [pa.array([c], pa.binary()) for c in cells]
                columns.append(pa.array([own.tobytes() if own is not None else None], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "part long, block long, doc_ids array<long>, " + ", ".join(f"{n} binary" for n in names[3:]))


SUMS = "block long, doc_ids array<long>, own binary, docs binary, sums binary, known binary"
#: Places of pairs whose context is not listed, by block and document: the context's hash, the
#: counts of pair and word, the document; the blocks and how many places each has (all as planes).
LATER = ["unlisted", "pairs", "counts", "places", "blocks", "lengths"]
PLACED = f"part long, {SUMS}, " + ", ".join(f"{n} binary" for n in LATER)


def _named(names: str) -> list[str]:
    return [f.split()[0] for f in names.split(", ")]


def _score_part(sent, parts: int = 1, salts: int = 1):
    """Packed sums (score, base score) and known tokens of those documents of a block that have
    tokens in a part; a block's own row goes through as it is. Places of pairs whose context is
    not listed have no score yet: they go, as ``LATER``, to the part of that context."""

    def score(table: pa.Table) -> pa.Table:
        model = sent.value
        own_part = table.column("part")[0].as_py()
        lengths = [len(x) // 2 for x in table.column("contexts").to_pylist()]
        flagged = _unpacked(table, "docs", "<u2").astype(np.int64)
        docs = np.repeat(np.arange(len(lengths)), lengths) << 16 | flagged >> 1
        key, unlisted = _pair_keys(table, len(model.words))
        order = np.argsort(key)
        key, docs, train = key[order], docs[order], flagged[order] & 1
        starts = _runs(key)
        kind, contexts = key[starts] >> 32, key[starts] & 0xFFFFFFFF
        pair = np.add.reduceat(train, starts) if len(starts) else starts
        listed, later = kind < len(model.words), contexts >= UNLISTED
        word = _totals(kind, pair)
        word[listed] = model.n[kind[listed]]
        times = np.diff(np.append(starts, len(key)))
        met, number = np.unique(docs, return_inverse=True)
        scored = np.where(later, 0.0, model.score(pair, word, model.context_n[np.where(later, 0, contexts)]))
        totals, base, known = (np.bincount(number, np.repeat(x, times), len(met)) for x in (scored, model.base(word), word > 0))
        borders = np.searchsorted(met, np.arange(len(lengths) + 1) << 16)
        cells = [(met & 0xFFFF).astype(np.uint16), np.column_stack([totals, base]), known.astype(np.uint32)]
        packed = [pa.array([c[a:b].tobytes() for a, b in pairwise(borders)], pa.binary()) for c in cells]
        block_ids = table.column("block").to_numpy()
        whole = [pa.array(np.full(len(lengths), own_part)), table.column("block"), table.column("doc_ids"), table.column("sums"), *packed]
        whole = pa.table(whole, names=["part", *_named(SUMS)])
        # places of later pairs, by the part of their context
        hashes = unlisted[contexts[later] - UNLISTED]
        part = np.repeat((hashes % parts + own_part % salts) % parts, times[later])
        hashes, pairs, counts = (np.repeat(x, times[later]) for x in (hashes, pair[later].astype(np.uint32), word[later]))
        docs = docs[np.repeat(later, times)]
        order = np.lexsort((docs, part))
        part, docs, *cells = (x[order] for x in (part, docs, hashes, pairs, counts))
        rows = []
        for p, s in _split(part):
            starts = _runs(docs[s] >> 16)
            blocks_met = block_ids[docs[s][starts] >> 16], np.diff(np.append(starts, s.stop - s.start)).astype(np.uint32)
            rows.append([p, *(_planes(x) for x in (*(c[s] for c in cells), (docs[s] & 0xFFFF).astype(np.uint16), *blocks_met))])
        columns = [pa.array([row[i] for row in rows], pa.binary() if i else pa.int64()) for i in range(1 + len(LATER))]
        return pa.concat_tables([whole, pa.table(columns, names=["part", *LATER])], promote_options="default")

    return score


def _score_later(sent):
    """The rows ``SUMS`` of a part: those that come, and those of the places ``LATER``, whose
    contexts' counts are in ``counts``."""

    def score(table: pa.Table, counts: pa.Table) -> pa.Table:
        model = sent.value
        ready = table.filter(pc.is_valid(table.column("block"))).select(_named(SUMS))
        table = table.filter(pc.is_null(table.column("block")))
        hashes, pair, word, docs, block_ids, lengths = (_from_rows(table, c, k) for c, k in zip(LATER, ("<i8", "<u4", "<i8", "<u2", "<i8", "<u4"), strict=True))
        block_ids = np.repeat(block_ids, lengths)
        known, n = (counts.column(c).to_numpy() for c in ("word", "n"))
        order = np.argsort(known)
        # a context that no training row has is not in the table
        known, n = np.append(known[order], 0), np.append(n[order], 0)
        at = np.searchsorted(known[:-1], hashes)
        seen = np.where((known[at] == hashes) & (at < len(known) - 1), n[at], 0)
        kinds, number = np.unique(block_ids, return_inverse=True)
        met, number = np.unique(number << 16 | docs, return_inverse=True)
        totals = np.bincount(number, model.score(pair, word, seen), len(met))
        borders = np.searchsorted(met, np.arange(len(kinds) + 1) << 16)
        cells = [(met & 0xFFFF).astype(np.uint16), np.column_stack([totals, np.zeros(len(met))]), np.zeros(len(met), np.uint32)]
        packed = [pa.array([c[a:b].tobytes() for a, b in pairwise(borders)], pa.binary()) for c in cells]
        nothing = [pa.nulls(len(kinds), ready.schema.field(c).type) for c in ("doc_ids", "own")]
        added = pa.table([pa.array(kinds, pa.int64()), *nothing, *packed], names=_named(SUMS))
        return pa.concat_tables([ready, added], promote_options="permissive")

    return score


def _add_parts(table: pa.Table) -> pa.Table:
    """The documents of a block with the sums over all parts."""
    at = next(i for i, x in enumerate(table.column("doc_ids").to_pylist()) if x is not None)
    out = np.frombuffer(table.column("own")[at].as_py()).reshape(-1, 4).copy()  # score, base, known, tokens
    docs = _unpacked(table, "docs", "<u2")
    for i, x in enumerate((*_unpacked(table, "sums", "<f8").reshape(-1, 2).T, _unpacked(table, "known", "<u4"))):
        out[:, i] += np.bincount(docs, x, len(out))
    counts = out[:, 2:].round().astype(np.int64)
    columns = [counts[:, 1], counts[:, 0], out[:, 1], out[:, 0]]
    return pa.table([table.column("doc_ids")[at].values, *(pa.array(np.ascontiguousarray(x)) for x in columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, text); a row without an id is in the held-out fold."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(FOLDS).alias("fold"), F.col("text").cast("string").alias("text"))


def _parts_for(rows: DataFrame, model: Model) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-model.tokens // PART))


def learn_model(rows: DataFrame, counted: DataFrame | None = None) -> Model:
    """Totals, listed words, frequent pairs and weights, from the training rows of ``rows``;
    ``counted`` are their counted words, if these are at hand."""
    context = rows.sparkSession.sparkContext
    counted = write_shared(count_words(rows)) if counted is None else counted
    totals = counted.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.sum("tuning"), F.count("*"))]).first()
    ends = counted.where(F.col("word") == END).select("n", "tuning").first() or (0, 0)
    most = counted.orderBy(F.desc("n"), "word").limit(LISTED).toArrow()
    frequent = np.stack([most.column(c).to_numpy() for c in ("word", "n", "tuning")], axis=1)
    model = Model(tuple(totals), tuple(ends), frequent.astype(np.int64))
    sent = _Sent(context.broadcast(vars(model)))
    pairs = pair_counts(rows, sent, _parts_for(rows, model))
    found = write_shared(pairs.groupBy("part").applyInArrow(_merge_pairs(sent), "kind long, a long, b long, c long, n long"))
    found = found.where("kind < 2").unionByName(_later_cells(found, counted, model))
    # cells of fixed width and pairs above a share of all tokens: both are bounded in number
    found = found.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")).toArrow()
    table = np.stack([found.column(c).to_numpy() for c in ("kind", "a", "b", "c", "n")], axis=1) if found.num_rows else np.zeros((0, 5), np.int64)
    model.weights = learn_weights(table[table[:, 0] == 0, 1:].astype(float))
    if not model.tokens:
        model.weights[:] = [0, 0, 1]
    model.pairs = table[table[:, 0] == 1][:, [1, 2, 4]]
    return model


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learned from rows whose id has another fold than the held-out one. A null or empty text
    has one token, its end. A row without an id is held out. Repeated rows are learned from
    and scored each. Where nothing can be learned from, every token has the probability of
    any word. Other columns are not looked at; no rows give no rows.
    """
    rows = rows_of(docs)
    counted = write_shared(count_words(rows))
    model = learn_model(rows, counted)
    sent = _Sent(rows.sparkSession.sparkContext.broadcast(vars(model)))
    parts = _parts_for(rows, model)
    # an unlisted word has at most this share of all tokens, which go to so many parts
    salts = 1 + model.tokens // (LISTED * PART)
    placed = place_pairs(rows, sent, parts).groupBy("part").applyInArrow(_score_part(sent, parts, salts), PLACED)
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    counts = counted.select("word", "n", salt).select(F.expr(f"pmod(pmod(word, {parts}L) + salt, {parts}L)").alias("part"), "word", "n")
    sums = placed.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(_score_later(sent), SUMS)
    whole = sums.groupBy("block").applyInArrow(_add_parts, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return whole.select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


class _Sent:
    """A model from the values that were sent to the tasks."""

    def __init__(self, sent):
        self.sent = sent

    @property
    def value(self) -> Model:
        model = Model.__new__(Model)
        model.__dict__.update(self.sent.value)
        return model
