"""Near-duplicates by SimHash, found through the generalised pigeonhole principle.

Two fingerprints within ``limit`` bits agree, on one of ``m`` groups of bits at least, to
within that group's threshold, whenever the thresholds sum to ``limit - m + 1`` (a group
at -1 is not looked at). Correlated bits share a group. Each fingerprint picks its own
thresholds by dynamic programming over the rows it would probe and the rows it is expected
to meet, so that a value shared by very many fingerprints is passed over in favour of other
groups. Every group value of every fingerprint is indexed; probes and index meet in one
join that checks the distance, and only real links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.components import connected_components
from fleetgauge.llm.shared import add_columns, write_shared

BITS = 64
SEED = 42
#: A probe is sorted and sent over the network, an expected partner is only compared.
PROBE_COST = 5.0
#: Shingles whose bits are counted at a time, so that a long text needs no more memory.
BLOCK = 8192


def fingerprint(text: bytes | None, size: int = 4) -> int:
    """The majority of each bit over the hashes of all shingles of ``size`` words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - size + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[i : i + BLOCK], stops[i : i + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; a null or blank text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [fingerprint(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have bits i and j both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column(0).to_numpy().astype("<i8")
            for i in range(0, len(fps), BLOCK):
                bits = np.unpackbits(fps[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                bits = bits.astype(np.float32)
                both += bits.T @ bits
            n += len(fps)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(cells)], names=["cell", "n"])

    sums = np.zeros(BITS * BITS + 1)
    for row in classes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        sums[row[0]] = row[1]
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of about equal size; each is grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for k in range(m):
        group = [max(left, key=lambda b: (tied[b, sorted(left)].sum(), -b))]
        left.remove(group[0])
        while len(group) < BITS // m + (k < BITS % m):
            best = max(left, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def chance_within(n: int, both: np.ndarray, group: list[int], limit: int) -> np.ndarray:
    """For t = 0..limit, the chance that two fingerprints differ in t bits of ``group`` at
    most, from the share of set bits."""
    p = np.diag(both)[group] / max(n, 1)
    odds = np.array([1.0])
    for q in 2 * p * (1 - p):
        odds = np.convolve(odds, [1 - q, q])
    return np.cumsum(np.append(odds, np.zeros(limit + 1))[: limit + 1])


def probes(width: int, t: int) -> int:
    """Values within ``t`` bits of a value of ``width`` bits."""
    return sum(int(np.prod([(width - i) / (i + 1) for i in range(k)]).round()) for k in range(t + 1))


def allocate(widths: list[int], meets: np.ndarray, limit: int) -> np.ndarray:
    """Thresholds (rows, m) of the least cost that sum to ``limit - m + 1``.

    ``meets[r, i, t]`` is how many fingerprints row r is expected to meet in group i at
    threshold t. Dynamic programming over the groups, for all rows at once.
    """
    rows, m, _ = meets.shape
    units = limit + 1  # thresholds -1..limit as 0..limit+1; these sum to limit + 1
    cost = np.full((rows, m, units + 1), 0.0)
    for i, w in enumerate(widths):
        for t in range(limit + 1):
            cost[:, i, t + 1] = PROBE_COST * probes(w, t) + meets[:, i, t]
    best, choice = cost[:, 0, :], []
    for i in range(1, m):
        options = np.full((rows, units + 1, units + 1), np.inf)
        for u in range(units + 1):  # given to group i
            options[:, u:, u] = best[:, : units + 1 - u] + cost[:, i, u, None]
        choice.append(options.argmin(axis=2))
        best = options.min(axis=2)
    left, out = np.full(rows, units), np.zeros((rows, m), np.int64)
    for i in range(m - 1, 0, -1):
        out[:, i] = choice[i - 1][np.arange(rows), left]
        left -= out[:, i]
    out[:, 0] = left
    return out - 1


def choose_parts(n: int, limit: int) -> int:
    """The number of groups whose expected cost for one of ``n`` fingerprints is least."""

    def cost(m: int) -> float:
        widths = [BITS // m + (k < BITS % m) for k in range(m)]
        within = np.array([[[n * probes(w, t) / 2.0**w for t in range(limit + 1)] for w in widths]])
        given = allocate(widths, within, limit)[0]
        return sum(PROBE_COST * probes(w, t) + within[0, i, t] for i, (w, t) in enumerate(zip(widths, given, strict=True)) if t >= 0)

    return min(range(2, limit + 2), key=cost)


def _part(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of ``group`` as one number."""
    out = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(group):
        out |= ((fps >> bit) & 1) << k
    return out


def links(classes: DataFrame, limit: int = 4) -> DataFrame:
    """(a, b) for all fingerprints a < b of ``classes`` that differ in ``limit`` bits at most.

    A pair may appear once for each group of bits that finds it.
    """
    n, both = bit_counts(classes)
    m = choose_parts(n, limit)
    groups = group_bits(n, both, m)
    widths = [len(g) for g in groups]
    chances = np.array([chance_within(n, both, g, limit) for g in groups])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i, group in enumerate(groups):
                arrays = [np.full(len(fps), i, np.int32), _part(fps, group), fps]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["part", "value", "fp"])

    masks = [[[sum(1 << x for x in c) for k in range(t + 1) for c in combinations(range(w), k)] for t in range(limit + 1)] if w <= 22 else None for w in widths]

    def flips(i: int, t: int) -> np.ndarray:
        if masks[i] is None:
            masks[i] = {}
        if isinstance(masks[i], dict) and t not in masks[i]:
            masks[i][t] = [sum(1 << x for x in c) for k in range(t + 1) for c in combinations(range(widths[i]), k)]
        return np.array(masks[i][t], np.int64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                fps = batch.column(0).to_numpy()
                same = np.stack([batch.column(1 + i).to_numpy() for i in range(m)], axis=1).astype(float)
                meets = same[:, :, None] + (n - same)[:, :, None] * np.maximum(chances - chances[:, :1], 0)[None]
                given = allocate(widths, meets, limit)
                for i, group in enumerate(groups):
                    values = _part(fps, group)
                    for t in range(limit + 1):
                        mine = given[:, i] == t
                        if mine.any():
                            near = (values[mine][:, None] ^ flips(i, t)[None, :]).ravel()
                            arrays = [np.full(len(near), i, np.int32), near, np.repeat(fps[mine], len(near) // mine.sum())]
                            yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["part", "value", "fp"])

    entries = classes.select("fp").mapInArrow(index, "part int, value long, fp long")
    counts = entries.groupBy("part", "value").agg(F.count("*").alias("same"))
    # how many fingerprints share its value, for each fingerprint and group
    met = (
        entries.join(counts, ["part", "value"]).groupBy("fp")
        .agg(*[F.max(F.when(F.col("part") == i, F.col("same"))).alias(f"same{i}") for i in range(m)])
    )
    asked = met.mapInArrow(probe, "part int, value long, fp long").withColumnRenamed("fp", "a")
    there = entries.withColumnRenamed("fp", "b")
    return (
        asked.join(there, ["part", "value"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit))
        .select("a", "b")
    )


def _least_of_components(classes: DataFrame, limit: int) -> DataFrame:
    """(fp, least): the least ``first`` of all classes that can be reached from ``fp``."""
    parts = connected_components(links(classes, limit))
    linked = classes.join(parts, classes.fp == parts.node).select("fp", "first", "component")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    labels = linked.join(least, "component").select("fp", "least")
    return classes.join(labels, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))


def near_duplicates(docs: DataFrame, limit: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row of ``docs``.

    Rows are linked whose fingerprints differ in ``limit`` bits at most; ``component_id``
    is the least id that can be reached. Null, empty and blank texts share fingerprint zero
    and are linked like others. Repeated rows and ids stay as they are. A row without an id
    belongs to its component but names none: a component of such rows only has a null id.
    Other columns of ``docs`` are not looked at. No rows give no rows.
    """
    rows = write_shared(fingerprints(docs, doc_id, text))
    classes = write_shared(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # written first, so that the join below has two plain exchanges and the rows of a hot
    # fingerprint can be split
    named = write_shared(_least_of_components(classes, limit).withColumnRenamed("least", "component_id"))
    return rows.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_firsts(docs: DataFrame, limit: int = 4) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that of the least id, and of rows
    that share it the first one met.

    Groups are those of ``near_duplicates``. A row without an id stays only where no row of
    its group has one. All columns are kept, whatever their names. No rows give no rows.
    """

    def start():
        return lambda texts: [pa.array([fingerprint(t.as_py()) for t in texts.cast(pa.large_binary())], pa.int64())]

    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    marked = add_columns(whole, "text", start, "fp long").select("row", "fp", F.monotonically_increasing_id().alias("place"))
    rows = write_shared(marked)  # so that places stay what they are
    first = F.min(F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("place"))).alias("first")
    classes = write_shared(rows.groupBy("fp").agg(first))
    kept = _least_of_components(classes, limit).select("least.place").distinct()
    return rows.join(kept, "place", "left_semi").select("row.*")
