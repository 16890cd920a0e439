"""Benchmark passages in documents, by edit distance over words.

The CGK embedding reads a string with a random walk: step j writes the current word and
moves on if a random bit of (j, word) says so. Walks over two strings that differ by few
edits fall back into step, so that edit distance becomes Hamming distance. Some sampled
positions of the embedding make the key of a hash table. Walks with several tables each are
added until ``RECALL`` of randomly edited copies, at the edit limit, are met, of those with
replaced, added, missing and all kinds of words each; this is done for each
class of lengths. An item longer than ``PIECE`` words is looked for by its pieces: one of
them has no greater share of the edits than the whole. Windows as long as the pieces, from
every word on, are looked up, and around what is met the best place of the whole item is found
by the exact edit distance. Windows that cannot pass, as they hold too few of the pieces' rare
words, are not embedded.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import add_columns

#: Shorter items are no evidence: their words meet by chance.
MIN_WORDS = 5
#: Share of an item's words that may be replaced, added or missing.
EDITS = 0.2
#: Share of the copies at the edit limit that the tables of a class of lengths meet, and the
#: edited copies on which this is measured.
RECALL, COPIES = 0.99, 800
#: The least number of walks, the tables of each and the steps that a table samples.
WALKS, TABLES, SAMPLED = 8, 6, 3
#: Walks of a class at most. Where the copies still are not met, rare words alone choose the
#: pieces that are verified around a window, which misses none.
MOST_WALKS = 200
#: Keys that a task holds at a time.
KEYS = 2_000_000
#: Words of a piece at most.
PIECE = 60
#: Items whose lengths differ by less than this factor share a window size.
CLASS = 1.2
#: Words of items that are looked for in one pass over the documents.
PASS_WORDS = 500_000

_BLANK = bytes(32 if chr(c) in string.punctuation else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation parts them as white space does."""
    return text.lower().encode().translate(_BLANK).split() if text else []


def edits_allowed(words: int) -> int:
    return int(EDITS * words)


def edit_distance(item: list[int], window: list[int]) -> tuple[int, int]:
    """(least edit distance between ``item`` and a beginning of ``window``, its length).

    Bit-parallel columns: bit i of ``up`` / ``down`` says that the distance rises / falls
    from item word i-1 to i.
    """
    n = len(item)
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = (n, 0)
    for j, word in enumerate(window):
        same = masks.get(word, 0)
        zero = ((((same & up) + up) ^ up) | same | down) & full
        gain = (down | ~(zero | up)) & full
        loss = zero & up
        if gain & top:
            score += 1
        elif loss & top:
            score -= 1
        gain = (gain << 1 | 1) & full
        loss = (loss << 1) & full
        up = (loss | ~(zero | gain)) & full
        down = gain & zero
        if score < best[0]:
            best = (score, j + 1)
    return best


def start_distances(item: list[int], words: list[int]) -> list[int]:
    """For each place of ``words``, the least edit distance between ``item`` and the words
    from there on, up to any end: the columns of ``edit_distance`` backwards, with a free end."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, word in enumerate(reversed(item)):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, out = full, 0, n, []
    for word in reversed(words):
        same = masks.get(word, 0)
        zero = ((((same & up) + up) ^ up) | same | down) & full
        gain = (down | ~(zero | up)) & full
        loss = zero & up
        if gain & top:
            score += 1
        elif loss & top:
            score -= 1
        gain, loss = gain << 1 & full, loss << 1 & full
        up = (loss | ~(zero | gain)) & full
        down = gain & zero
        out.append(score)
    return out[::-1]


class _Symbols(dict):
    """Words of items by number; any other word is 0, which no item holds."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Items:
    """The items of one pass: symbols of their words, pieces, window classes and hash tables."""

    def __init__(self, items: list[tuple[int, list[bytes]]], seed: int = 11):
        held = Counter(w for _, words in items for w in set(words))
        self.symbols = _Symbols((w, i + 1) for i, w in enumerate(sorted(held)))
        self.pad = len(self.symbols) + 1
        self.ids = [i for i, _ in items]
        self.words = [[self.symbols[w] for w in words] for _, words in items]
        self.pieces, self.piece_of = [], []  # words; (item, first word)
        for i, words in enumerate(self.words):
            borders = np.linspace(0, len(words), -(-len(words) // PIECE) + 1).astype(int).tolist()
            for at, end in pairwise(borders):
                self.pieces.append(words[at:end])
                self.piece_of.append((i, at))
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(0, 1 << 64, self.pad + 1, dtype=np.uint64)
        spread = np.zeros(self.pad + 1, np.int64)
        for w, n in held.items():
            spread[self.symbols[w]] = n
        self.classes, left = [], sorted(range(len(self.pieces)), key=lambda i: len(self.pieces[i]))
        while left:
            shortest = len(self.pieces[left[0]])
            own = [i for i in left if len(self.pieces[i]) < max(shortest + 1, CLASS * shortest)]
            self.classes.append(self._class(own, spread, [seed, len(self.classes)]))
            left = left[len(own) :]

    def _class(self, own: list[int], spread: np.ndarray, seed: list[int]) -> dict:
        """Rare words, walks and tables of the pieces ``own``.

        Of a piece's ``edits + few`` rarest places, ``few`` at least are met by words of a
        window that passes.
        """
        lengths = [len(self.pieces[i]) for i in own]
        rare: dict[int, set[int]] = {}  # the pieces of a word that is rare in them
        few = max(1, min(lengths) // 5)
        for i in own:
            places = sorted(self.pieces[i], key=lambda s: spread[s])
            for word in places[: edits_allowed(len(places)) + few]:
                rare.setdefault(word, set()).add(i)
        out = {
            "least": min(lengths), "most": max(lengths), "few": few,
            "rare": np.bincount(list(rare), minlength=self.pad + 1) > 0,
            "members": np.bincount(np.concatenate([self.pieces[i] for i in own]), minlength=self.pad + 1) > 0,
        }
        flat = np.concatenate([[*self.pieces[i], self.pad] for i in own])
        ends = np.cumsum([n + 1 for n in lengths]) - 1
        starts, steps = ends - lengths, 2 * min(lengths)
        copies, stops, of, met = self._copies(own, out, np.random.default_rng([*seed, 1]))
        rows = np.repeat(stops, np.diff(np.concatenate([[-1], stops])))
        rng, walks = np.random.default_rng([*seed, 2]), []
        while len(walks) < WALKS or (len(walks) < MOST_WALKS and met.reshape(-1, 4).mean(axis=0).min() < RECALL):
            bits = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            at = np.stack([np.sort(rng.choice(steps, SAMPLED, replace=False)) for _ in range(TABLES)])
            walks.append((bits, at))
            for start, piece in self._search_class(out | self._tables(walks[-1:], own, flat, starts, ends), copies, rows):
                copy = np.searchsorted(stops, start)
                met[copy] |= of[copy] == piece
        if met.reshape(-1, 4).mean(axis=0).min() < RECALL:
            return out | {"pieces_of": rare}
        return out | self._tables(walks, own, flat, starts, ends)

    def _tables(self, walks: list, own: list[int], flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict:
        """All tables of ``walks`` as one sorted array of keys and the piece of each."""
        bits, at = (np.stack(x) for x in zip(*walks, strict=True))
        keys = self.embed(flat, starts, ends, bits, at)
        order = np.argsort(keys, axis=None, kind="stable")
        pieces = np.tile(np.array(own, np.int32), len(keys))
        return {"walks": (bits, at), "keys": keys.ravel()[order], "pieces": pieces[order]}

    def _copies(self, own: list[int], c: dict, rng: np.random.Generator) -> tuple:
        """(words, their ends, pieces, whether met) of copies of the pieces ``own`` with as many
        random edits as are allowed, each before words that no item holds. By turns, words are replaced, added,
        missing, or all of it."""
        of, texts = rng.choice(own, COPIES), []
        for turn, i in enumerate(of):
            words = list(self.pieces[i])
            for _ in range(edits_allowed(len(words))):
                kind = turn % 4 if turn % 4 < 3 else int(rng.integers(3))
                at, word = int(rng.integers(len(words))), int(rng.integers(self.pad) * rng.integers(2))
                words[at : at + (kind != 1)] = [word] * (kind != 2)
            texts.append([*words, *[0] * (2 * c["most"]), self.pad])
        return np.concatenate(texts).astype(np.int64), np.cumsum([len(t) for t in texts]) - 1, of, np.zeros(COPIES, bool)

    def embed(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys (walks x tables, windows): the words that a walk writes at the sampled steps of
        a table, and its number. A step moves on by the highest bit of the word's code times
        the step's odd number. ``bits`` is (walks, steps), ``at`` (walks, tables, samples)."""
        tables, last = at.shape[1], int(at.max())
        sampled = at.reshape(-1, at.shape[2])
        here = np.repeat(starts[None], len(bits), axis=0)
        keys = np.zeros((len(sampled), len(starts)), np.int64)
        for j in range(last + 1):
            word = flat[here]
            own = np.flatnonzero((sampled == j).any(axis=1))
            if len(own):
                keys[own] = (keys[own] * 0x5851F42D4C957F2D + word[own // tables] + 1) ^ (keys[own] >> 29)
            if j < last:
                here = np.minimum(here + (self.codes[word] * bits[:, j, None] >> np.uint64(63)).astype(np.int64), ends)
        return keys + (np.arange(len(keys), dtype=np.int64) * 0x1E3779B97F4A7C15)[:, None]

    def search(self, flat: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(start, piece) of the windows that meet a piece in a table."""
        met: set[tuple[int, int]] = set()
        for c in self.classes:
            met |= self._search_class(c, flat, ends)
        return met

    def _search_class(self, c: dict, flat: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        met: set[tuple[int, int]] = set()
        n = len(flat)
        # a passing window starts with a word of a piece and holds `few` rare ones
        wide = min(c["most"] + edits_allowed(c["most"]), n)
        scarce = np.zeros(n + wide, np.int32)
        np.cumsum(c["rare"][flat], out=scarce[:n])
        scarce[n:] = scarce[n - 1]
        before = np.concatenate([scarce[:1] * 0, scarce[: n - 1]])
        starts = np.flatnonzero(scarce[wide - 1 : wide - 1 + n] - before >= c["few"])
        starts = starts[c["members"][flat[starts]]]
        if "walks" not in c:
            for start in starts.tolist():
                words = flat[start : min(start + wide, int(ends[start]))].tolist()
                held = Counter(i for w in words for i in c["pieces_of"].get(w, ()))
                met.update((start, i) for i, k in held.items() if k >= c["few"])
            return met
        bits, at = c["walks"]
        block = max(1, KEYS // (len(bits) * at.shape[1]))
        for k in range(0, len(starts), block):
            some = starts[k : k + block]
            keys = self.embed(flat, some, ends[some], bits, at)
            first = np.searchsorted(c["keys"], keys, "left")
            # most keys are in no table
            hit = np.argwhere(c["keys"][np.minimum(first, len(c["keys"]) - 1)] == keys)
            for row, col in hit.tolist():
                last = np.searchsorted(c["keys"], keys[row, col], "right")
                met.update((int(some[col]), int(i)) for i in c["pieces"][first[row, col] : last])
        return met


def _regions(met: set[tuple[int, int]], items: Items, stops: np.ndarray) -> dict[tuple[int, int], list[list[int]]]:
    """For each document and item, the stretches in which the item may lie."""
    out: dict[tuple[int, int], list[list[int]]] = {}
    spans = []
    for start, piece in met:
        i, at = items.piece_of[piece]
        d, n = int(np.searchsorted(stops, start)), len(items.words[i])
        # up to its edits, words are missing or added before the piece, and again in it
        spare = 2 * edits_allowed(n)
        spans.append((d, i, max(start - at - spare, int(stops[d - 1]) + 1 if d else 0), min(start - at + n + spare, int(stops[d]))))
    for d, i, a, b in sorted(spans):
        own = out.setdefault((d, i), [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return out


def _matches(docs: list[list[bytes]], items: Items) -> Iterator[tuple[int, dict]]:
    """(document, match): the best place of each item in each document, if near enough. Of
    places that need as few edits, it is the first that begins with a word of the item."""
    get = items.symbols.__getitem__
    flat = np.concatenate([np.array([*map(get, words), items.pad], np.int32) for words in docs])
    stops = np.cumsum([len(words) + 1 for words in docs]) - 1
    ends = np.repeat(stops, np.diff(np.concatenate([[-1], stops])))
    for (d, i), stretches in sorted(_regions(items.search(flat, ends), items, stops).items()):
        item = items.words[i]
        own, least, place = set(item), edits_allowed(len(item)) + 1, None
        for a, b in stretches:
            words = flat[a:b].tolist()
            for k, distance in enumerate(start_distances(item, words)):
                if distance < least and words[k] in own:
                    least, place = distance, a + k
        if place is not None:
            distance, length = edit_distance(item, flat[place : min(place + len(item) + least, int(stops[d]))].tolist())
            yield d, dict(zip(FIELDS, (items.ids[i], distance, len(item), place - (int(stops[d - 1]) + 1 if d else 0), length), strict=True))


FIELDS = ("item_id", "distance", "item_words", "start_word", "n_words")
MATCHES = pa.list_(pa.struct([(f, pa.int64()) for f in FIELDS]))
MATCHES_DDL = "array<struct<" + ", ".join(f"{f}: bigint" for f in FIELDS) + ">>"


def add_passages(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` and the array ``passages`` of what each row holds of the items.

    Items go to the tasks in passes of ``PASS_WORDS`` words, each a pass over the rows.
    """
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = own.agg(F.coalesce(F.sum(F.size(F.split("text", r"[\s\p{Punct}]+"))), F.lit(0))).first()[0]
    passes = -(-total // PASS_WORDS) or 1
    rows = docs
    for k in range(passes):
        some = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        items = [(r[0], words_of(r[1])) for r in some]
        items = [x for x in items if len(x[1]) >= MIN_WORDS]
        sent = docs.sparkSession.sparkContext.broadcast(Items(items))
        rows = add_columns(rows, column, _start(sent), f"passages_{k} {MATCHES_DDL}")
    found = F.concat(*[f"passages_{k}" for k in range(passes)])
    return rows.select(*docs.columns, found.alias("passages"))


def _start(sent):
    def start():
        items = sent.value

        def work(column: pa.Array) -> list[pa.Array]:
            docs = [words_of(t) for t in column.to_pylist()]
            found: list[list[dict]] = [[] for _ in docs]
            for d, match in _matches(docs, items):
                found[d].append(match)
            return [pa.array(found, MATCHES)]

        return work

    return start


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start_word, n_words): for each row of ``docs``
    and each item in it, the place that needs the fewest edits (then the first).

    A place matches if ``EDITS`` of the item's words are replaced, added or missing at most.
    Null and empty texts match nothing, nor do items of fewer than ``MIN_WORDS`` words.
    Items with equal texts are all reported, repeated documents each for themselves, null
    ids as null. Other columns are not looked at; empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return add_passages(rows, benchmark).select("doc_id", F.inline("passages"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return add_passages(rows, benchmark).where(F.size("passages") == 0).select("row.*")
