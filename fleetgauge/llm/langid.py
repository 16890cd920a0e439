"""Language identification by unigrams over pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum, over all ways to cut it into pieces, of the products of their
probabilities; the forward algorithm adds these up without listing them. A text's is the
product over its words. The probabilities are learned by expectation-maximisation
(forward-backward) from counted words of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.llm.shared import add_columns, fold, write_shared

VOCABULARY = "piece_bpe_32k.model"
#: The mark that the vocabulary puts before a word.
START = "▁"
UNKNOWN = "und"
#: Labelled rows per language that the probabilities are learned from.
SAMPLE = 500
ROUNDS = 3
#: Parts in which a language's rows are ordered before the sample is taken.
PARTS = 64
#: Added to each piece's expected count.
SMOOTHING = 0.01
#: Chance of a letter that no piece covers, and least chance of a single letter.
LETTER = 1e-7
#: Longer runs of letters are scored in blocks of so many; LETTER ** BLOCK is still a double.
BLOCK = 32
#: Words whose scores a task keeps; it starts anew when there are more.
CACHED = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15)

_RUNS = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, each in blocks; those that begin a run bear the mark."""
    found = _RUNS.findall(text.lower()) if text else []
    out = []
    for run in found:
        if len(run) <= BLOCK and run.isalpha():
            out.append(START + run)
        else:
            for part in _LETTERS.findall(run):
                out += [START * (i == 0) + part[i : i + BLOCK] for i in range(0, len(part), BLOCK)]
    return out


def letter_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters in the vocabulary, with and without the mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    own = {p for p in pieces if p == p.lower() and p.lstrip(START).isalpha() and p.rfind(START) <= 0}
    return sorted(own | {START})


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


class Pieces:
    """Finds where pieces lie in many words at once; prefixes tell which searches go on."""

    def __init__(self, pieces: list[str]):
        table: dict[int, int] = {}
        self.size = len(pieces)
        for k, piece in enumerate(pieces):
            h = np.uint64(0)
            mixed = _mixed(np.frombuffer(piece.encode("utf-32-le"), "<u4"))
            with np.errstate(over="ignore"):
                for i, m in enumerate(mixed):
                    h = h * BASE + m
                    if i + 1 == len(mixed):
                        table[int(h)] = k
                    else:
                        table.setdefault(int(h), -1)
        self.keys = np.array(sorted(table), np.uint64)
        self.ids = np.array([table[int(k)] for k in self.keys], np.int64)

    def within(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, length) -> (rows of ``codes``, piece of each)."""
        rows, n = codes.shape
        mixed, out = _mixed(codes), {}
        for i in range(n):
            live, h = np.arange(rows), np.zeros(rows, np.uint64)
            for j in range(i, n):
                h = h * BASE + mixed[live, j]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                known = self.keys[at] == h
                live, h, ids = live[known], h[known], self.ids[at[known]]
                whole = ids >= 0
                if whole.any():
                    out[i, j - i + 1] = live[whole], ids[whole]
                if not len(live):
                    break
        return out


def _forward(found: dict, rows: int, n: int, chance: np.ndarray) -> np.ndarray:
    """alpha[row, i, language]: probability of the first i letters."""
    alpha = np.zeros((rows, n + 1, chance.shape[1]))
    alpha[:, 0] = 1
    for i in range(n):
        alone = np.full((rows, chance.shape[1]), LETTER)
        for length in range(1, n - i + 1):
            if (i, length) in found:
                at, ids = found[i, length]
                if length == 1:
                    alone[at] += chance[ids]
                else:
                    alpha[at, i + length] += alpha[at, i] * chance[ids]
        alpha[:, i + 1] += alpha[:, i] * alone
    return alpha


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, matrix of their code points) for words of one length."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), 20_000):
            some = at[k : k + 20_000]
            codes = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), "<u4")
            yield some, codes.reshape(len(some), n)


def word_scores(words: list[str], pieces: Pieces, chance: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability in each language."""
    out = np.zeros((len(words), chance.shape[1]))
    for at, codes in _by_length(words):
        rows, n = codes.shape
        out[at] = np.log(_forward(pieces.within(codes), rows, n, chance)[:, n])
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, chance: np.ndarray) -> np.ndarray:
    """Of each piece, over all segmentations of all words, in one language (``chance`` has one column)."""
    total = np.zeros(pieces.size)
    for at, codes in _by_length(words):
        rows, n = codes.shape
        found = pieces.within(codes)
        alpha = _forward(found, rows, n, chance)[:, :, 0]
        beta = np.zeros((rows, n + 1))
        beta[:, n] = 1
        for i in range(n - 1, -1, -1):
            beta[:, i] += beta[:, i + 1] * LETTER
            for length in range(1, n - i + 1):
                if (i, length) in found:
                    row, ids = found[i, length]
                    beta[row, i] += chance[ids, 0] * beta[row, i + length]
        for (i, length), (row, ids) in found.items():
            share = alpha[row, i] * chance[ids, 0] * beta[row, i + length] / alpha[row, n]
            np.add.at(total, ids, share * counts[at[row]])
    return total


def sample_rows(docs: DataFrame, labelled: Column, sample: int) -> DataFrame:
    """(lang, text) of ``sample`` labelled rows per language, chosen by a hash of the id."""
    ids = docs.where(labelled & F.col("lang").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    # first within parts of a language, so that no task orders all of its rows
    chosen = ids.withColumn("part", F.pmod("hash", F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        order = W.partitionBy(*keys).orderBy("hash", "doc_id")
        chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    few = chosen.select("doc_id", "lang").distinct()
    return docs.join(F.broadcast(few), ["doc_id", "lang"]).select("lang", "text")


def learn(docs: DataFrame, labelled: Column, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, chance of each piece in each).

    Words of the sample are counted once; each round sums expected piece counts over the
    tasks, so that the driver only sees one number for each piece and language.
    """
    names = letter_pieces(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(words_of(text)).items():
                    tally[lang, word] += n
            langs, words = [k[0] for k in tally], [k[1] for k in tally]
            yield pa.RecordBatch.from_pydict({"lang": langs, "word": words, "n": list(tally.values())}, pa.schema({"lang": pa.string(), "word": pa.string(), "n": pa.int64()}))

    rows = sample_rows(docs, labelled, sample).mapInArrow(count, "lang string, word string, n long")
    counted = write_shared(rows.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    chance = np.full((len(names), len(languages)), 1 / len(names))
    for _ in range(rounds if languages else 0):
        sent = docs.sparkSession.sparkContext.broadcast((names, languages, chance))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, languages, chance = sent.value
            pieces, total = Pieces(names), np.zeros(chance.shape)
            for batch in batches:
                frame = batch.to_pandas()
                for lang, part in frame.groupby("lang"):
                    k = languages.index(lang)
                    total[:, k] += expected_counts(part["word"].tolist(), part["n"].to_numpy(), pieces, chance[:, k : k + 1])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

        sums = counted.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        chance = np.full(chance.shape, SMOOTHING)
        chance[sums["piece"], sums["lang"]] += sums["n"]
        chance /= chance.sum(axis=0)
    return languages, chance


def identify(docs: DataFrame, languages: list[str], chance: np.ndarray, path: str) -> DataFrame:
    """``docs`` with lang_pred and score; the score is the language's share among all."""
    sent = docs.sparkSession.sparkContext.broadcast((letter_pieces(path), languages, chance))

    def start():
        names, languages, chance = sent.value
        pieces, place, known = Pieces(names), {}, np.zeros((0, len(languages)))

        def work(column: pa.Array) -> list[pa.Array]:
            nonlocal known
            texts = [words_of(t) for t in column.to_pylist()]
            fresh = list({w for words in texts for w in words if w not in place})
            if len(place) + len(fresh) > CACHED and place:
                place.clear()
                known = known[:0]
                fresh = list({w for words in texts for w in words})
            if fresh and languages:
                place.update((w, len(known) + i) for i, w in enumerate(fresh))
                known = np.concatenate([known, word_scores(fresh, pieces, chance)])
            best, share = [], []
            for words in texts:
                if not words or not languages:
                    best.append(UNKNOWN)
                    share.append(0.0)
                    continue
                total = known[[place[w] for w in words]].sum(axis=0)
                odds = np.exp(total - total.max())
                best.append(languages[int(total.argmax())])
                share.append(float(odds.max() / odds.sum()))
            return [pa.array(best, pa.string()), pa.array(share, pa.float64())]

        return work

    return add_columns(docs, "text", start, "lang_pred string, score double")


def predict_languages(docs: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    Learned from rows outside the held-out fold that have a language. A text that is null
    or has no letter is ``und`` with score 0, as are all texts where no row can be learned
    from. Ties go to the language that sorts first. Repeated rows each get their row; a
    null id stays null and is not held out. Other columns play no part.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    languages, chance = learn(docs.select("doc_id", "text", "lang"), fold(4) != 2, path, sample)
    found = identify(docs.select("doc_id", "text"), languages, chance, path)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def with_letters(rows: DataFrame) -> DataFrame:
    """The rows whose text has a word to identify."""

    def start():
        return lambda column: [pa.array([bool(words_of(t)) for t in column.to_pylist()], pa.bool_())]

    return add_columns(rows, "text", start, "has_letters boolean").where("has_letters")


def keep_identified(docs: DataFrame, vocabulary: str | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``least`` at least.

    Where no language can be learned, as no row outside the held-out fold has one, the rows
    whose text has letters stay.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    languages, chance = learn(docs.select("doc_id", "text", "lang"), fold(4) != 2, path)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    if not languages:
        return with_letters(rows).select("row.*")
    found = identify(rows, languages, chance, path)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
