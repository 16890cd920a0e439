"""Personal data: fixed patterns, and spans that a character tagger adds.

The tagger (bidirectional LSTM with CRF transitions) learns from the spans that the
patterns find in a bounded sample of documents. Overlapping windows of a text are scored,
the scores of a character are averaged with a weight that falls towards a window's edges,
and one best tag sequence is decoded over all windows that touch one another, so that no
span is cut or doubled at an edge. A window without any digit or ``@`` is not scored: every
span must hold one of these, so none can come of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import add_columns
from fleetgauge.llm.tagger import Tagger, char_classes

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Documents whose pattern spans the tagger learns from, and windows of them at most.
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 3000
#: Windows scored at a time.
ROWS = 256

# The contract's patterns. Those that could start anywhere in a run of digits
# start at the run's first; an address is sought from its @.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGNS = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns, in the order of kinds, then of starts."""
    spans = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                spans.append((0, start, m.end()))
                end = m.end()
    if _SIGNS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                spans.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if 16 <= len(m[0]) <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                spans.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    spans.append((3, *m.span()))
    return spans


def spelled(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by kind, then start, with commas between."""
    return ",".join([f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans)])


def _tags(spans: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """0 outside, 2k+1 where a span of kind k begins, 2k+2 inside; the first span wins."""
    tags = np.zeros(n, np.int64)
    for k, s, e in spans:
        if not tags[s:e].any():
            tags[s:e] = 2 * k + 2
            tags[s] = 2 * k + 1
    return tags


def _padded(classes: np.ndarray, start: int) -> np.ndarray:
    part = classes[start : start + WINDOW]
    return np.pad(part, (0, WINDOW - len(part)))


def starts_of(text: str) -> list[int]:
    """Starts of the windows, every ``STRIDE`` characters, that hold a digit or an @."""
    out: set[int] = set()
    reach = WINDOW // STRIDE
    for m in _SIGNS.finditer(text):
        last = m.start() // STRIDE
        out.update(k * STRIDE for k in range(max(0, last - reach + 1), last + 1))
    return sorted(out)


def sample_windows(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(place, chars, tags) of windows with digits or an @ from the documents whose ids hash
    lowest, and of one other window from each document that has a span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, chars, tags = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                spans, starts = base_spans(text), starts_of(text)
                if not starts:
                    continue
                classes, marks = char_classes(text), np.pad(_tags(spans, len(text)), (0, WINDOW))
                for s in [*starts, 0] if spans else starts[:2]:
                    order.append(hashlib.md5(f"{doc_id}:{s}".encode()).hexdigest())
                    chars.append(_padded(classes, s).astype(np.uint8).tobytes())
                    tags.append(marks[s : s + WINDOW].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.string()), pa.array(chars, pa.binary()), pa.array(tags, pa.binary())], names=["place", "chars", "tags"])

    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text").mapInArrow(run, "place string, chars binary, tags binary")
    return rows.orderBy("place", "chars", "tags").limit(SAMPLE_WINDOWS)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Tagger | None:
    """A tagger for the kinds, fitted in one task on the bounded sample; None where it has
    no span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if any(any(tags) for _, tags in rows):
            chars, tags = (np.array([np.frombuffer(r[i], np.uint8) for r in rows], np.int64) for i in (0, 1))
            tagger = Tagger(2 * len(KINDS) + 1).fit(chars, tags)
            yield pa.RecordBatch.from_arrays([pa.array(list(tagger.p)), pa.array([v.tolist() for v in map(np.ravel, tagger.p.values())], pa.list_(pa.float32()))], names=["name", "cells"])

    windows = sample_windows(docs, sample_docs).coalesce(1)
    found = windows.mapInArrow(run, "name string, cells array<float>").collect()
    tagger = Tagger(2 * len(KINDS) + 1)
    for name, cells in found:
        tagger.p[name] = np.array(cells, np.float32).reshape(tagger.p[name].shape)
    return tagger if found else None


def allowed(kind: int, text: str) -> bool:
    """What an added span must be like, whatever the tagger says."""
    digits = len(_digits(text))
    if kind == 0:
        return 0 < text.find("@") < len(text) - 3 and "." in text
    if kind == 1:
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= digits <= 19 and luhn(_digits(text)) and not re.search(r"[^0-9 .-]", text)
    return 8 <= digits <= 15 and bool(re.search(r"[-().+ ]", text)) and not re.search(r"[^0-9+() .-]", text)


def _stretches(starts: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, windows) of windows that touch one another."""
    group: list[int] = []
    for s in starts:
        if group and s > group[-1] + WINDOW:
            yield group[0], min(length, group[-1] + WINDOW), group
            group = []
        group.append(s)
    if group:
        yield group[0], min(length, group[-1] + WINDOW), group


def added_spans(texts: list[str], tagger: Tagger, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger finds in each text beside those in ``base``."""
    starts = [starts_of(t) for t in texts]
    classes = [char_classes(t) if s else None for t, s in zip(texts, starts, strict=True)]
    windows = [(d, s) for d, own in enumerate(starts) for s in own]
    weight = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    scores: dict[tuple[int, int], np.ndarray] = {}
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    done = 0
    for at in range(0, len(windows), ROWS):
        some = windows[at : at + ROWS]
        found = tagger.emissions(np.stack([_padded(classes[d], s) for d, s in some]))
        scores.update((w, found[:, k]) for k, w in enumerate(some))
        # texts all of whose windows are scored
        until = windows[at + ROWS][0] if at + ROWS < len(windows) else len(texts)
        for d in range(done, until):
            for first, end, group in _stretches(starts[d], len(texts[d])):
                total, held = np.zeros((end - first, found.shape[2])), np.zeros((end - first, 1))
                for s in group:
                    n = min(WINDOW, end - s)
                    total[s - first : s - first + n] += scores.pop((d, s))[:n] * weight[:n, None]
                    held[s - first : s - first + n] += weight[:n, None]
                out[d] += _spans(tagger.decode(total / held), first, texts[d], base[d])
        done = until
    return out


def _spans(tags: np.ndarray, first: int, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    spans, start, kind = [], -1, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        if start >= 0 and tag != 2 * kind + 2:
            s, e = first + start, first + i
            while e > s and text[e - 1].isspace():
                e -= 1
            while s < e and text[s].isspace():
                s += 1
            if allowed(kind, text[s:e]) and all(e <= b or s >= f for _, b, f in base):
                spans.append((kind, s, e))
            start = -1
        if tag and start < 0:
            start, kind = i, (tag - 1) // 2
    return spans


def _finder(docs: DataFrame, sample_docs: int, columns):
    """``start`` of ``add_columns``: ``columns(texts, base, added)`` makes the new columns."""
    tagger = learn(docs, sample_docs)
    sent = docs.sparkSession.sparkContext.broadcast(tagger and tagger.p)

    def start():
        tagger = Tagger(2 * len(KINDS) + 1) if sent.value else None
        if tagger:
            tagger.p = sent.value

        def work(column: pa.Array) -> list[pa.Array]:
            given = column.to_pylist()
            texts = [t or "" for t in given]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, tagger, base) if tagger else [[] for _ in texts]
            return columns(given, base, more)

        return work

    return start


def find(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base, spans) of every row of ``docs``.

    The counts and ``base`` are the patterns' spans; ``spans`` has the added ones too.
    Positions are code points, ends exclusive. A null text counts as empty and has none.
    Repeated rows and null ids stay (a null id is not learned from); other columns are not
    looked at. Texts are searched whole. Where no sampled document has a span, none is added.
    """

    def columns(texts: list, base: list, more: list) -> list[pa.Array]:
        counts = [[sum(k == kind for kind, _, _ in b) for b in base] for k in range(len(KINDS))]
        out = [pa.array(c, pa.int64()) for c in (*counts, list(map(len, more)))]
        return [*out, pa.array(map(spelled, base), pa.string()), pa.array([spelled(b + m) for b, m in zip(base, more, strict=True)], pa.string())]

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join([*[f"n_{k} long" for k in KINDS], "n_added long, base string, spans string"])
    return add_columns(own, "text", _finder(own, sample_docs, columns), schema).drop("text")


def clean(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """All rows of ``docs``, each span in ``text`` replaced by its kind; where there is a
    column ``n_chars`` it follows. Null texts stay null."""

    def columns(texts: list, base: list, more: list) -> list[pa.Array]:
        return [pa.array([t and redact(t, b + m) for t, b, m in zip(texts, base, more, strict=True)], pa.string())]

    own = docs.select("doc_id", "text")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    done = add_columns(rows, "text", _finder(own, sample_docs, columns), "clean string")
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("clean") != F.col("text"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in angle brackets; spans that overlap as the first one."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])
