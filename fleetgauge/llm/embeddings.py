"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated several times at random; its code is the signs, and a correction
factor is stored with it: the inner product of the signs with the rotated vector itself.
The inner product of one vector's signs with another rotated vector, over that factor, is an
unbiased estimate of the cosine, and its error has a known spread. Only where the upper
confidence bound reaches the threshold is the cosine computed exactly, in double precision.

Pairs come from tables whose keys are sampled code bits, for vectors of one label. How many
bits a key has follows from the label's number of vectors, how many tables there are from
the recall aimed at for vectors just at the threshold. Equal vectors are one class with a
count. A bucket is cut into tiles of bounded size, and a tile gives sums of links and the
edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.components import connected_components
from fleetgauge.llm.shared import write_shared

ROTATIONS = 4
#: Chance that a pair just at the threshold shares a key in some table.
RECALL = 0.9999
#: Vectors that a key has on average in a label, by which its bits are chosen.
BUCKET = 32
MOST_BITS = 24
#: Rows of a bucket that are compared with as many others in one tile.
TILE = 1000
#: Standard deviations of the estimate that count as possible.
SURE = 4.0
SEED = 17


def rotations(dim: int) -> np.ndarray:
    """``ROTATIONS`` random rotations of ``dim`` dimensions, one below the other."""
    rng = np.random.default_rng([SEED, dim])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(ROTATIONS)])


def key_bits(rows: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(rows, 1) / BUCKET)), 1, MOST_BITS))


def tables(bits: int, threshold: float) -> int:
    """Tables needed so that a pair at the threshold meets with the chance ``RECALL``."""
    same = (1 - np.arccos(threshold) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(1 - RECALL) / np.log(1 - same))))


def sampled(dim: int, table: int) -> np.ndarray:
    """The code bits, in order, of which a table's key takes the first few."""
    return np.random.default_rng([SEED, dim, table]).permutation(ROTATIONS * dim)[:MOST_BITS]


def _codes(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return unit @ turn.T > 0


def estimates(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cosine estimates [a, b] from a's code and b, their standard deviations)."""
    rotated = unit @ turn.T
    signs = np.where(rotated > 0, 1.0, -1.0)
    factor = (signs * rotated).sum(axis=1, keepdims=True)  # the stored correction
    cosine = signs @ rotated.T / factor
    dim = unit.shape[1]
    share = np.clip(factor / (ROTATIONS * np.sqrt(dim)), 1e-9, 1)
    spread = np.sqrt((1 - share**2) / (max(dim - 1, 1) * ROTATIONS)) / share
    return cosine, spread * np.sqrt(np.clip(1 - np.clip(cosine, -1, 1) ** 2, 0.05, 1))


def sound() -> Column:
    """Whether a row can be linked; never null."""
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return F.expr(f"coalesce(label is not null and vec_id is not null and size(embedding) > 0 and {finite} and exists(embedding, x -> x <> 0), false)")


def rows_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, digest) of the rows that can be linked."""
    rows = vectors.where(sound()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    spelled = F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string")))
    return rows.withColumn("digest", F.sha2(spelled, 256))


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Runs of rows whose first ``width`` columns are equal, from sorted batches."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        held = held.combine_chunks()
        cut = np.flatnonzero(np.any([_changes(held.column(i)) for i in range(width)], axis=0)) + 1
        for a, b in zip([0, *cut[:-1]], cut):
            yield held.slice(a, b - a)
        held = held.slice(cut[-1] if len(cut) else 0)
    if held is not None and held.num_rows:
        yield held


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values[1:] != values[:-1]


def tile_links(unit: np.ndarray, exact: np.ndarray, keys: np.ndarray, table: int, ids: np.ndarray, counts: np.ndarray, sides: np.ndarray | None, turn: np.ndarray, bits: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, a linked id of the tile for each, links added) for the pairs of one tile.

    A pair that shares a key in an earlier table is left to that table. ``sides`` parts the
    rows of a tile between two chunks of a bucket, where only mixed pairs count.
    """
    cosine, spread = estimates(unit, turn)
    near = np.maximum(cosine + SURE * spread, (cosine + SURE * spread).T) >= threshold
    a, b = np.nonzero(np.triu(near, 1))
    if sides is not None:
        mixed = sides[a] != sides[b]
        a, b = a[mixed], b[mixed]
    norm = np.sqrt((exact * exact).sum(axis=1))
    a, b = (x[(exact[a] * exact[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold] for x in (a, b))
    fresh = np.ones(len(a), bool)
    for t in range(table):
        at = sampled(unit.shape[1], t)[:bits]
        fresh &= (keys[a][:, at] != keys[b][:, at]).any(axis=1)
    a, b = a[fresh], b[fresh]
    added = np.bincount(a, counts[b], len(ids)) + np.bincount(b, counts[a], len(ids))
    root = np.arange(len(ids))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        root[max(x, y)] = min(x, y)
    for x in range(len(root)):
        root[x] = root[root[x]]
    met = np.flatnonzero(added)
    return ids[met], ids[root[met]], added[met].astype(np.int64)


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): a class is linked to class b, and n rows were found to be linked to it."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    rows = classes.join(sizes, ["label", "dim"])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, orders = {}, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                dims, sizes = batch.column("dim").to_numpy(), batch.column("rows").to_numpy()
                for dim, bits in sorted({(d, key_bits(n)) for d, n in zip(dims.tolist(), sizes.tolist(), strict=True)}):
                    some = np.flatnonzero((dims == dim) & (np.array([key_bits(n) for n in sizes]) == bits))
                    own = batch.take(pa.array(some))
                    cells = own.column("embedding").flatten().to_numpy().reshape(-1, dim)
                    unit = cells / np.abs(cells).max(axis=1, keepdims=True)
                    turn = turns.setdefault(dim, rotations(dim))
                    code = _codes(unit, turn)
                    for t in range(tables(bits, threshold)):
                        order = orders.setdefault((dim, t), sampled(dim, t))
                        key = code[:, order[:bits]] @ (1 << np.arange(len(order[:bits]), dtype=np.int64))
                        columns = [own.column("label"), own.column("dim"), pa.array(np.full(len(some), t, np.int32)), pa.array(key), pa.array(np.full(len(some), bits, np.int32)), own.column("first"), own.column("n"), own.column("embedding")]
                        yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "tab", "bucket", "bits", "first", "n", "embedding"])

    schema = "label string, dim int, tab int, bucket long, bits int, first long, n long, embedding array<double>"
    keyed = rows.select("label", "dim", "rows", "first", "n", "embedding").mapInArrow(bucket, schema)
    key = ["label", "dim", "tab", "bucket"]
    full = keyed.groupBy(*key).agg(F.count("*").alias("rows")).where(f"rows > {TILE}")
    cut = keyed.join(full, key, "left").withColumn("chunks", F.coalesce(F.ceil(F.col("rows") / TILE), F.lit(1)).cast("int")).drop("rows")
    chunk = F.pmod(F.xxhash64("first"), F.col("chunks")).cast("int")
    cut = cut.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    tile = [*key, "low", "high"]
    placed = cut.select(*tile, "chunk", "bits", "first", "n", "embedding").repartition(*tile).sortWithinPartitions(*tile)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {}
        for group in _groups(batches, len(tile)):
            if group.num_rows < 2:
                continue
            dim, table, bits = (group.column(c)[0].as_py() for c in ("dim", "tab", "bits"))
            exact = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            scaled = exact / np.abs(exact).max(axis=1, keepdims=True)
            unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
            turn = turns.setdefault(dim, rotations(dim))
            two = group.column("low")[0].as_py() != group.column("high")[0].as_py()
            sides = group.column("chunk").to_numpy() if two else None
            found = tile_links(unit, scaled, _codes(scaled, turn), table, group.column("first").to_numpy(), group.column("n").to_numpy(), sides, turn, bits, threshold)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["a", "b", "n"])

    return placed.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Rows with equal labels are linked if their cosine is ``threshold`` at least; what is
    found is exact, and ``RECALL`` is the share found of pairs just at the threshold (nearer
    ones are found more surely, equal vectors always). ``component_id`` is the least id that
    can be reached, ``kept`` tells whether it is the row's own. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do rows without a label
    or an id (their component is null and they are not kept). Vectors of different lengths
    link with nothing. Repeated rows count as rows of their own. Other columns are not
    looked at; no rows give no rows.
    """
    rows = write_shared(rows_of(vectors))
    grouped = rows.groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    # a number of its own for each class, as two may share their least id
    classes = write_shared(grouped.withColumns({"dim": F.size("embedding"), "first": F.monotonically_increasing_id()}))
    found = write_shared(_links(classes, threshold))
    parts = connected_components(found.select("a", "b"))
    sums = found.groupBy("a").agg(F.sum("n").alias("links"))
    known = classes.select("label", "digest", "first", "least", "n").join(sums, F.col("first") == F.col("a"), "left").join(parts, F.col("first") == F.col("node"), "left")
    known = known.select("label", "digest", "least", "n", "links", F.coalesce("component", "first").alias("part"))
    named = known.groupBy("part").agg(F.min("least").alias("component_id"))
    known = write_shared(known.join(named, "part").select("label", "digest", "n", "links", "component_id"))
    linked = rows.select("vec_id", "label", "digest").join(known, ["label", "digest"]).select(
        "vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    alone = vectors.where(~sound()).select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
