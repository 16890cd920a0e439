"""Byte-pair encoding and decoding with a public vocabulary, by forced boundaries.

A merge only makes tokens of the vocabulary. Where two neighbouring bytes stand inside no
token, no merge can join them: the word is cut there for certain. The fragments between
such cuts are encoded one by one, and their ids are put together again. Words and fragments
that come again are looked up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import add_columns

VOCABULARY = "word_bpe_49k.json"
#: Words and fragments a task remembers; it starts anew when there are more.
CACHED = 300_000
#: Fragments up to so many bytes are merged without a queue.
SHORT = 32

# Fixed values of the vocabulary's file: its word pattern and the ending of a word's last token.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = "</w>"
#: Text of these characters is normalised and split alike in every Unicode version.
_PLAIN = re.compile(r"[\t-\r -~\xa1-ɏ‐-‧‰-⁞€]*")
_BLANKS = re.compile(r"[\t-\r ]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Coder:
    """Encodes and decodes texts as the vocabulary's own library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = f.read()
        parts = json.loads(content)
        self.content = content
        self.characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(self.characters)}
        self.ids: dict[str, int] = parts["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.joined = [bytearray(256) for _ in range(256)]  # [a][b]: b follows a in some token
        for token in self.ids:
            held = [byte_of[c] for c in token.removesuffix(END)]
            for a, b in zip(held, held[1:]):
                self.joined[a][b] = 1
        self.single = [self.ids.get(c) for c in self.characters]
        self.last = [self.ids.get(c + END) for c in self.characters]
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}
        self.words: dict[str, bytes] = {}
        self.library = None

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments between the forced boundaries of a word."""
        at = [i for i in range(1, len(word)) if not self.joined[word[i - 1]][word[i]]]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)])] if at else [word]

    def fragment(self, part: bytes, ends: bool) -> list[int]:
        """Merge by rank, the leftmost first among equals; ``ends``: the word ends with it."""
        ids = [self.single[b] for b in part]
        if ends:
            ids[-1] = self.last[part[-1]]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Look at all pairs again for every merge."""
        get, none = self.merges.get, (len(self.merges), 0)
        found = [get(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int | None]) -> list[int]:
        """Keep the pairs in a queue."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        waiting = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                merge = self.merges.get((ids[i], ids[after[i]]))
                if merge:
                    heapq.heappush(waiting, (merge[0], i, ids[i], ids[after[i]], merge[1]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, left, right, merged = heapq.heappop(waiting)
            j = after[i] if ids[i] is not None else -1
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j] = merged, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [i for i in ids if i is not None]

    def word(self, word: str) -> bytes:
        """The packed ids of a word."""
        parts = self.cuts(word.encode())
        ids: list[int] = []
        for k, part in enumerate(parts):
            key = part, k == len(parts) - 1
            own = self.fragments.get(key)
            if own is None:
                if len(self.fragments) > CACHED:
                    self.fragments.clear()
                own = self.fragment(*key)
                if len(part) <= 64:
                    self.fragments[key] = own
            ids += own
        return _packed(ids)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if _PLAIN.fullmatch(text):
            plain = _BLANKS.sub(" ", unicodedata.normalize("NFC", text))
            return WORDS.findall("".join([c.lower() for c in plain]) if "İ" in plain else plain.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content)
            self.byte_of = {c: b for b, c in enumerate(self.characters)}
        # characters whose classes differ between Unicode versions: the file's own rules
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.byte_of[c] for c in w]).decode() for w, _ in found]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        ids, at = [], 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            self._plain(text[at : m.start()], ids)
            ids.append(_packed([self.special[m[0]]]))
            at = m.end()
        self._plain(text[at:] if at else text, ids)
        return b"".join(ids)

    def _plain(self, text: str, ids: list[bytes]) -> None:
        known = self.words
        for word in self.split(text):
            own = known.get(word)
            if own is None:
                if len(known) > CACHED:
                    known.clear()
                own = self.word(word)
                if len(word) <= 64:
                    known[word] = own
            ids.append(own)

    def decode(self, ids: bytes) -> str:
        """The tokens of packed ids with a blank between them, as the file has no decoder."""
        return " ".join([self.tokens[i] for i in _numbers(ids)])


def _packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def _numbers(ids: bytes) -> array:
    numbers = array("I")
    numbers.frombytes(ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers


def _over(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    """doc_id and what ``row(coder, text)`` gives, by a coder that each task makes."""

    def start():
        coder = Coder(path)
        return lambda column: [pa.array(c) for c in zip(*[row(coder, t.as_py() or "") for t in column], strict=True)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return add_columns(rows, "text", start, schema).drop("text")


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian unsigned 32-bit numbers.

    A null text counts as empty: no ids, an empty decoded text. Special tokens written in a
    text become their ids, as with the library. Repeated rows and null ids stay; other
    columns are not looked at. Long texts are encoded whole. The path of the vocabulary
    must exist on every executor.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return _over(docs, path, "ids binary, decoded string", _both)


def _both(coder: Coder, text: str) -> tuple[bytes, str]:
    ids = coder.encode(text)
    return ids, coder.decode(ids)


def _digests(coder: Coder, text: str) -> tuple[int, str, str]:
    ids = coder.encode(text)
    decoded = coder.decode(ids)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, as ``encode`` has them."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return _over(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)
