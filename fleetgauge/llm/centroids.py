"""Centroid clustering in whole numbers over subvector dictionaries.

Vectors are cut into blocks of dimensions. A chunk of vectors holds, for each block, the
distinct subvectors once and a code per vector, without loss. A round computes the distances
of these subvectors to the centroids once; a vector's distance is the sum over its codes, and
the sums for the new centroids are those of the subvectors times their counts. Only the sums
of each cluster and dimension leave a task. All numbers are whole, so that the result does
not depend on how the rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import write_shared

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Dimensions of a block, and vectors of a chunk.
BLOCK, CHUNK = 8, 4096
#: Numbers of this size or more could give distances that are no 64-bit integers.
TOO_LARGE = 1 << 27

CHUNKS = "ids binary, idless binary, sizes array<int>, words binary, codes binary"


def whole_numbers(cells: np.ndarray, scale: int) -> np.ndarray:
    """(rows, dim) of floor(scale * x)."""
    out = np.floor(cells * scale)
    if (np.abs(out) >= TOO_LARGE).any():
        raise ValueError(f"a component times {scale} is {TOO_LARGE} or more: distances would not fit 64 bits")
    return out.astype(np.int32)


def encode(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """The chunks of ``vectors`` (vec_id, embedding) as rows of ``CHUNKS``."""

    def chunk(ids: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        words, codes = [], []
        for at in range(0, dim, BLOCK):
            own, code = np.unique(values[:, at : at + BLOCK], axis=0, return_inverse=True)
            words.append(own)
            codes.append(code.reshape(-1).astype(np.uint16))
        known = ids.fill_null(0).to_numpy().astype("<i8")
        idless = ids.is_null().to_numpy(zero_copy_only=False)
        arrays = [
            pa.array([known.tobytes()], pa.binary()),
            pa.array([np.packbits(idless).tobytes() if idless.any() else b""], pa.binary()),
            pa.array([[len(w) for w in words]], pa.list_(pa.int32())),
            pa.array([b"".join(w.astype("<i4").tobytes() for w in words)], pa.binary()),
            pa.array([np.stack(codes).astype("<u2").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "idless", "sizes", "words", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def joined() -> tuple[pa.Array, np.ndarray]:
            return pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])

        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            held.append((batch.column(0), whole_numbers(values, scale)))
            while sum(len(h[0]) for h in held) >= CHUNK:
                ids, values = joined()
                yield chunk(ids[:CHUNK], values[:CHUNK])
                held = [(ids[CHUNK:], values[CHUNK:])]
        ids, values = joined() if held else (pa.array([], pa.int64()), np.zeros((0, dim), np.int32))
        if len(ids):
            yield chunk(ids, values)

    return vectors.mapInArrow(run, CHUNKS)


class Chunk:
    """The decoded columns of a row of ``CHUNKS``."""

    def __init__(self, batch: pa.RecordBatch, row: int, dim: int):
        ids, idless, sizes, words, codes = (c[row].as_py() for c in batch.columns)
        self.ids = np.frombuffer(ids, "<i8")
        n = len(self.ids)
        self.idless = np.unpackbits(np.frombuffer(idless, np.uint8))[:n].astype(bool) if idless else None
        self.codes = np.frombuffer(codes, "<u2").reshape(len(sizes), n)
        flat, self.words, at = np.frombuffer(words, "<i4").astype(np.int64), [], 0
        for k, size in enumerate(sizes):
            width = min(BLOCK, dim - k * BLOCK)
            self.words.append(flat[at : at + size * width].reshape(size, width))
            at += size * width

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each vector; of equal ones the first cluster."""
        total = np.zeros((len(centroids), len(self.ids)), np.int64)
        for k, words in enumerate(self.words):
            own = centroids[:, k * BLOCK : k * BLOCK + words.shape[1]]
            for c, centre in enumerate(own):
                off = words - centre
                total[c] += (off * off).sum(axis=1)[self.codes[k]]
        cluster = total.argmin(axis=0)
        return cluster, total[cluster, np.arange(len(cluster))]

    def sums(self, cluster: np.ndarray, clusters: int) -> np.ndarray:
        """(clusters, dim): the sum of each cluster's vectors, from the counts of the codes."""
        out = []
        for k, words in enumerate(self.words):
            counts = np.bincount(cluster * len(words) + self.codes[k], minlength=clusters * len(words))
            out.append(counts.reshape(clusters, len(words)) @ words)
        return np.concatenate(out, axis=1)


def _decoded(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Chunk]:
    return (Chunk(batch, row, dim) for batch in batches for row in range(batch.num_rows))


def _totals(chunks: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(members, sums, inertia) of each cluster under ``centroids``."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((k, dim + 2), np.int64)
        for chunk in _decoded(batches, dim):
            cluster, distance = chunk.nearest(centroids)
            cells[:, :dim] += chunk.sums(cluster, k)
            cells[:, dim] += np.bincount(cluster, minlength=k)
            np.add.at(cells[:, dim + 1], cluster, distance)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.size)), pa.array(cells.ravel())], names=["cell", "n"])

    added = chunks.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = np.zeros(k * (dim + 2), object)
    for row in added.collect():  # one row for each cluster and dimension
        out[row.cell] = int(row.n)
    out = out.reshape(k, dim + 2)
    return out[:, dim], out[:, :dim], out[:, dim + 1].tolist()


def first_centroids(vectors: DataFrame, clusters: int, seed: int, scale: int) -> np.ndarray:
    """The vectors of the least hashes of ``seed:id``, then by their components; those without
    an id come last."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.orderBy(hashed.asc_nulls_last(), "embedding").limit(clusters).collect()
    return np.array([whole_numbers(np.array([r.embedding], np.float64), scale)[0] for r in chosen], np.int64)


def cluster_vectors(
    vectors: DataFrame, dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector
    of ``dim`` components, none of them null or non-finite; others are left out.

    Components become ``floor(scale * x)``. The first centroids are the vectors of the least
    hashes of their ids; each round assigns every vector to the nearest centroid (of equal
    ones the first) and moves each centroid that has vectors to the floor of their mean; then
    vectors are assigned once more. Fewer vectors than ``clusters`` give fewer centroids, and
    no vectors no rows. Repeated rows count as rows of their own; vectors without an id count,
    but are the last to be first centroids. Components so large that a distance might not fit
    64 bits raise an error. Other columns are not looked at.
    """
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(f"size(embedding) = {dim} and {finite}")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(kept, clusters, seed, scale)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    chunks = write_shared(encode(kept, dim, scale))
    for _ in range(rounds):
        members, sums, _ = _totals(chunks, centroids)
        moved = [[s // n for s in row] if n else old.tolist() for n, row, old in zip(members, sums, centroids, strict=True)]
        centroids = np.array(moved, np.int64)
    inertia = _totals(chunks, centroids)[2]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _decoded(batches, dim):
            cluster, distance = chunk.nearest(centroids)
            columns = [
                pa.array(chunk.ids, mask=chunk.idless), pa.array(cluster.astype(np.int32)), pa.array(distance),
                pa.array(np.array(inertia, np.int64)[cluster]), pa.array(np.full(len(cluster), sum(inertia), np.int64)),
                pa.array(names).take(pa.array(cluster)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return chunks.mapInArrow(assign, schema)


def _oracle() -> str:
    """``op12_centroids`` in DuckDB's SQL, its rounds spelled out."""

    def assigned(r: int) -> str:
        return f"""
a{r} as materialized (
    select vec_id, c, distance from (
        select vec_id, c, sum((x - m) * (x - m))::bigint as distance
        from cells join c{r} using (i) group by vec_id, c
    ) qualify row_number() over (partition by vec_id order by distance, c) = 1
)"""

    rounds = [
        f"""{assigned(r)},
s{r} as (select c, i, sum(x)::bigint as s, count(*)::bigint as n from cells join a{r} using (vec_id) group by c, i),
c{r + 1} as materialized (
    select c, i, coalesce((s - ((s % n) + n) % n) // n, m) as m from c{r} left join s{r} using (c, i)
)"""
        for r in range(ROUNDS)
    ]
    return f"""
with vectors as (
    select vec_id, embedding from embeddings
    where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM}
),
cells as materialized (
    select vec_id, i, floor({SCALE} * x::double)::bigint as x
    from (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as x from vectors)
),
firsts as (
    select vec_id, row_number() over (order by sha256('{SEED}:' || vec_id))::int - 1 as c from vectors
    qualify c < {CLUSTERS}
),
c0 as materialized (select c, i, x as m from cells join firsts using (vec_id)),
{",".join(rounds)},{assigned(ROUNDS)},
named as (select c, sha256(string_agg(m::varchar, ',' order by i)) as centroid_sha256 from c{ROUNDS} group by c)
select vec_id, c as cluster, distance,
    sum(distance) over (partition by c)::bigint as cluster_inertia,
    sum(distance) over ()::bigint as inertia, centroid_sha256
from a{ROUNDS} join named using (c)
"""


ORACLE = _oracle()
