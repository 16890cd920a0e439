"""Random forests over binned features, whose trees are finished where their cells fit a task.

Rows that agree in all bins are one cell, and a split never parts them. All rows are dealt out
by cell and packed into blocks; rows of a cell that agree in the label too are kept as one, with
their number. Each tree draws its own bootstrap weights, Poisson(1) for each row, as Poisson(n)
for n rows that are kept as one; what it grows on is the sums of weight and weighted label of
the cells. Nodes of many cells are split by histograms that are summed per tree over the
blocks. The cells of a node that is small enough go to one task, which grows everything below
it. So rows are passed over once per tree, and what is moved is each cell once per tree.
"""

from __future__ import annotations

import base64
import io
import math
import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, TaskContext, cloudpickle, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetgauge.operators.boosting import BINS, by_cell, codes_of, unpacked, walked, with_codes
from fleetgauge.sources.shared import remove_shared, write_shared

# Functions of this module travel with the job, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block, cells of a node that one task finishes, and trees finished by one job.
BLOCK, LOCAL, TREES_A_JOB = 100_000, 1_000_000, 50
#: Cells of more rows than a block are dealt out by their rows' keys, so many of them at most.
HOT = 1_000
#: Nodes whose histograms a task holds at once.
NODES = 512


class Options(NamedTuple):
    trees: int
    depth: int
    features: int  # tried by a node, drawn anew for each
    seed: int


class Tree(NamedTuple):
    """Nodes as a heap: the children of i are 2 i + 1 and 2 i + 2. A leaf has feature -1."""

    feature: np.ndarray
    border: np.ndarray  # last bin on the left
    value: np.ndarray  # mean label
    gains: np.ndarray  # by feature


def drawn(options: Options, features: int, tree: int, level: int) -> np.ndarray:
    """(nodes of the level, features): which features a node tries."""
    random = np.random.default_rng([options.seed, tree, level]).random((2**level, features))
    return random.argsort(axis=1).argsort(axis=1) < options.features


#: A number in [0, 1) is at or above as many of these as its Poisson(1) weight; the same for the ends
#: of 65,536 equal parts, and which parts hold one of them.
ONCE = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
PARTS = np.searchsorted(ONCE, np.arange(1 << 16) / (1 << 16), "right").astype(np.uint8)
CUT = PARTS != np.searchsorted(ONCE, np.arange(1, (1 << 16) + 1) / (1 << 16), "left")


def poisson(random: np.random.Generator, n: np.ndarray) -> np.ndarray:
    """A draw from Poisson(n) for each n; most are 1, for which a table is faster."""
    out = np.empty(len(n))
    once, more = np.flatnonzero(n == 1), np.flatnonzero(n != 1)
    share = random.random(len(once))
    part = (share * (1 << 16)).astype(np.int64)
    drawn, cut = PARTS[part], np.flatnonzero(CUT[part])
    drawn[cut] = np.searchsorted(ONCE, share[cut], "right")
    out[once], out[more] = drawn, random.poisson(n[more])
    return out


class Block(NamedTuple):
    """Rows by cell: of each cell its bins and first row, of each row its label and number."""

    name: tuple[int, int]
    bins: np.ndarray  # features x cells
    starts: np.ndarray
    y: np.ndarray
    n: np.ndarray

    def drawn(self, options: Options, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Weight and weighted label of each cell in the tree's bootstrap of all rows."""
        w = poisson(np.random.default_rng([options.seed, 1 + tree, *self.name]), self.n)
        return np.add.reduceat(w, self.starts), np.add.reduceat(w * self.y, self.starts)


def histogram(bins: np.ndarray, place: np.ndarray, nodes: int, *values: np.ndarray) -> np.ndarray:
    """(nodes, features, bins, values): sums over cells by the place of their node."""
    out = np.empty((len(values), len(bins), nodes * BINS))
    for f, own in enumerate(bins):
        at = place * BINS + own
        for k, value in enumerate(values):
            out[k, f] = np.bincount(at, value, nodes * BINS)
    return out.reshape(len(values), len(bins), nodes, BINS).transpose(2, 1, 3, 0)


def best_splits(sums: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, last bin on the left, gain, sums of the children) of each node; feature -1 where
    nothing is gained. The gain is the fall of the squared error, for labels of 0 and 1 half the
    fall of the Gini impurity, times the weight."""
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    quality = lambda x: np.divide(x[..., 1] ** 2, x[..., 0], out=np.zeros(x.shape[:-1]), where=x[..., 0] > 0)
    gain = quality(left) + quality(right) - quality(whole)
    gain[(left[..., 0] < 1) | (right[..., 0] < 1) | ~tried[:, :, None]] = 0
    flat = gain.reshape(len(gain), -1)
    best, rows = flat.argmax(axis=1), np.arange(len(gain))
    feature, border, gained = best // BINS, best % BINS, flat[rows, best]
    children = np.stack([left[rows, feature, border], right[rows, feature, border]], axis=1)
    least = 1e-12 * np.maximum(1.0, quality(whole)[:, 0, 0])
    return np.where(gained > least, feature, -1), border, gained, children


class Grown(NamedTuple):
    """Nodes that were looked at: heap numbers, splits (feature -1: a leaf), values and gains."""

    node: np.ndarray
    feature: np.ndarray
    border: np.ndarray
    value: np.ndarray
    gain: np.ndarray


def grow(options: Options, tree: int, root: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> Grown:
    """All nodes below ``root``, from its rows, or its cells with their mean labels."""
    parts, wy = [], w * y
    nodes, ends = np.array([root]), np.array([0, len(y)])
    for level in range((root + 1).bit_length() - 1, options.depth + 1):
        if not len(y):
            break
        # rows stand by node, from one of the ends to the next
        n, total, squares = (np.add.reduceat(v, ends[:-1]) for v in (w, wy, wy * y))
        found = Grown(nodes, np.full(len(nodes), -1), np.zeros(len(nodes), np.int64), total / n, np.zeros(len(nodes)))
        parts.append(found)
        # equal labels need no split
        mixed = (n > 1) & (squares - total * total / n > 1e-12 * np.maximum(1.0, squares))
        if level == options.depth or not mixed.any():
            break
        tried = drawn(options, len(bins), tree, level)
        place = np.repeat(np.arange(len(nodes)), np.diff(ends))
        for first in range(0, len(nodes), NODES):
            last = min(first + NODES, len(nodes))
            own = slice(ends[first], ends[last])
            if not mixed[first:last].all():
                own = ends[first] + np.flatnonzero(mixed[place[own]])
                if not len(own):
                    continue
            sums = histogram(bins[:, own], place[own] - first, last - first, w[own], wy[own])
            feature, border, gain, _ = best_splits(sums, tried[nodes[first:last] - (2**level - 1)])
            found.feature[first:last], found.border[first:last], found.gain[first:last] = feature, border, np.where(feature >= 0, gain, 0)
        on = np.flatnonzero(found.feature[place] >= 0)
        place = place[on]
        child = 2 * place + (bins[found.feature[place], on] > found.border[place])
        # by child: numbers of 16 bits are put in order without comparing them
        order = np.argsort(child.astype(np.uint16) if 2 * len(nodes) < 1 << 16 else child, kind="stable")
        on, sizes = on[order], np.bincount(child, minlength=2 * len(nodes)).reshape(-1, 2)[found.feature >= 0].ravel()
        bins, y, w, wy = bins.take(on, axis=1), y[on], w[on], wy[on]
        split = nodes[found.feature >= 0]
        nodes, ends = np.stack([2 * split + 1, 2 * split + 2], axis=1).ravel(), np.concatenate([[0], np.cumsum(sizes)])
    return Grown(*[np.concatenate(side) for side in zip(*parts, strict=True)])


def located(splits: dict[int, tuple[int, int]], bins: np.ndarray) -> np.ndarray:
    """The node of each row below the splits of a tree so far."""
    at = np.zeros(bins.shape[1], np.int64)
    for node in sorted(splits):
        feature, border = splits[node]
        at = np.where(at == node, 2 * at + 1 + (bins[feature] > border), at)
    return at


def _blocks(df: DataFrame, features: Sequence[str], borders: list[list[float]], label: str, key: str) -> tuple[DataFrame, int, int]:
    """All rows as blocks in the shared folder, so that each pass sees the same, their number
    and that of the cells."""
    y = F.col(label).cast("double")
    sound = F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit(f"{label} holds null or NaN")).cast("double")).otherwise(y)
    binned = write_shared(with_codes(df, features, borders, sound.alias("y"), F.xxhash64(key).alias("key")))
    codes = codes_of(len(features))
    cells = write_shared(binned.groupBy(*codes).agg(F.count("*").alias("n")))
    rows, different = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = cells.where(F.col("n") > max(BLOCK, rows // HOT)).select(F.xxhash64(*codes).alias("c")).collect()
    remove_shared(cells)
    cell = F.xxhash64(*codes)
    tasks = max(1, df.sparkSession.sparkContext.defaultParallelism, -(-rows // BLOCK))
    salt = F.when(cell.isin([r.c for r in hot]), F.pmod("key", F.lit(tasks))) if hot else F.lit(0)
    width = len(features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            code, y = np.stack([table.column(c).to_numpy() for c in codes]), table.column("y").to_numpy()
            if not len(y):
                return []
            new = np.concatenate([[True], (code[:, 1:] != code[:, :-1]).any(axis=0)])
            differs = np.flatnonzero(new | np.concatenate([[True], y[1:] != y[:-1]]))
            starts = np.searchsorted(differs, np.flatnonzero(new))
            n = np.diff(np.append(differs, len(y)))
            sides = {"bins": unpacked(code[:, new], width), "starts": starts, "y": y[differs], "n": n}
            return [pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), **{k: [v.tobytes()] for k, v in sides.items()}}
            )]

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield from block()
                number, held = number + 1, []
        if held:
            yield from block()

    dealt = binned.withColumn("salt", salt).repartition(tasks, *codes, "salt").sortWithinPartitions(*codes, "y")
    packed = write_shared(dealt.select(*codes, "y").mapInArrow(pack, "part int, number int, bins binary, starts binary, y binary, n binary"))
    remove_shared(binned)
    return packed, rows, different


def _split_large(blocks: RDD, options: Options, features: int, known: list[dict], large: dict[int, list[int]], level: int) -> list:
    """(tree, splits of its large nodes), from the sums over all blocks."""

    def sums(block: Block) -> Iterator[tuple[int, np.ndarray]]:
        for tree, nodes in large.items():
            at, (w, wy) = located(known[tree], block.bins), block.drawn(options, tree)
            place = np.searchsorted(nodes, at)
            own = (np.append(nodes, -1)[place] == at) & (w > 0)
            yield tree, histogram(block.bins[:, own], place[own], len(nodes), w[own], wy[own], np.ones(own.sum()))

    def split(told: tuple[int, np.ndarray]) -> tuple:
        tree, summed = told
        tried = drawn(options, features, tree, level)[np.array(large[tree]) - (2**level - 1)]
        whole = summed[:, 0].sum(axis=1)
        feature, border, gain, children = best_splits(summed[..., :2], tried)
        rows, left = np.arange(len(feature)), summed[..., 2].cumsum(axis=2)
        first = left[rows, feature, border]
        return tree, whole, feature, border, gain, children, np.stack([first, left[rows, feature, -1] - first], axis=1)

    return blocks.flatMap(sums).reduceByKey(np.add, max(1, min(len(large), 2 * blocks.context.defaultParallelism))).map(split).collect()


def _grow_small(blocks: RDD, options: Options, known: list[dict], small: list[tuple[int, int]]) -> RDD:
    """(tree, everything below a small node), each grown by the task that gets its cells."""
    wanted: dict[int, list[int]] = {}
    for tree, node in small:
        wanted.setdefault(tree, []).append(node)

    def dealt(block: Block) -> Iterator[tuple]:
        for tree, nodes in wanted.items():
            at, (w, wy) = located(known[tree], block.bins), block.drawn(options, tree)
            for node in nodes:
                own = np.flatnonzero((at == node) & (w > 0))
                if len(own):
                    yield (tree, node), (block.name, block.bins[:, own], wy[own] / w[own], w[own].astype(np.uint32))

    def grown(group: tuple) -> tuple[int, Grown]:
        (tree, node), parts = group
        parts = sorted(parts, key=lambda p: p[0])
        bins, y, w = (np.concatenate([p[i] for p in parts], axis=-1) for i in (1, 2, 3))
        return tree, grow(options, tree, node, bins, y, w.astype(float))

    place = {name: i for i, name in enumerate(small)}
    tasks = min(len(small), 4 * blocks.context.defaultParallelism)
    return blocks.flatMap(dealt).groupByKey(tasks, lambda name: place[name]).map(grown)


def fit_forest(df: DataFrame, features: Sequence[str], borders: list[list[float]], label: str, options: Options, key: str) -> list[Tree]:
    """Trees on bootstrapped rows; a null label is an error."""
    packed, rows, cells = _blocks(df, features, borders, label, key)
    if not rows:
        raise ValueError("no rows to fit on")
    width, heap = len(features), 2 ** (options.depth + 1) - 1

    def parse(r: Row) -> Block:
        numbers = [np.frombuffer(side, kind) for side, kind in ((r.starts, np.int64), (r.y, float), (r.n, np.int64))]
        return Block((r.part, r.number), np.frombuffer(r.bins, np.uint8).reshape(width, -1), *numbers)

    blocks = packed.rdd.map(parse).repartition(max(1, min(4 * packed.sparkSession.sparkContext.defaultParallelism, -(-rows // 5_000))))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    out = [Tree(np.full(heap, -1, np.int8), np.zeros(heap, np.uint8), np.zeros(heap), np.zeros(width)) for _ in range(options.trees)]
    known: list[dict[int, tuple[int, int]]] = [{} for _ in out]
    small: list[tuple[int, int]] = []
    large: dict[int, list[int]] = {}
    for tree in range(options.trees):
        if cells > LOCAL and options.depth:
            large[tree] = [0]
        else:
            small.append((tree, 0))
    for level in range(options.depth):
        if not large:
            break
        found, turned = _split_large(blocks, options, width, known, large, level), {}
        for tree, whole, feature, border, gain, children, sizes in found:
            for i, node in enumerate(large[tree]):
                own = out[tree]
                own.value[node] = whole[i, 1] / whole[i, 0]
                if feature[i] < 0:
                    continue
                known[tree][node] = int(feature[i]), int(border[i])
                own.feature[node], own.border[node] = feature[i], border[i]
                own.gains[feature[i]] += gain[i]
                for side in (0, 1):
                    child = 2 * node + 1 + side
                    own.value[child] = children[i, side, 1] / children[i, side, 0]
                    if level + 1 < options.depth:
                        if sizes[i, side] > LOCAL:
                            turned.setdefault(tree, []).append(child)
                        else:
                            small.append((tree, child))
        large = {tree: sorted(nodes) for tree, nodes in turned.items()}
    for first in range(0, options.trees, TREES_A_JOB):
        some = [name for name in small if first <= name[0] < first + TREES_A_JOB]
        for tree, grown in _grow_small(blocks, options, known, some).collect() if some else []:
            own = out[tree]
            own.feature[grown.node], own.border[grown.node], own.value[grown.node] = grown.feature, grown.border, grown.value
            real = grown.feature >= 0
            own.gains[:] += np.bincount(grown.feature[real], grown.gain[real], width)
    blocks.unpersist()
    remove_shared(packed)
    return out


def full(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, borders and leaves of the trees with all their nodes: below a leaf all goes
    left, to its value."""
    feature, border, value = (np.stack(side) for side in list(zip(*trees, strict=True))[:3])
    inner = feature.shape[1] // 2
    for node in range(inner):
        leaf = feature[:, node] < 0
        border[leaf, node], value[leaf, 2 * node + 1] = BINS - 1, value[leaf, node]
    return np.maximum(feature[:, :inner], 0), border[:, :inner], value[:, inner:]


class Forest(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees as a Spark ML model: adds ``prediction``, for classes ``probability`` too."""

    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    classes = Param(Params._dummy(), "classes", "whether labels are 0 and 1", TypeConverters.toBoolean)
    trees = Param(Params._dummy(), "trees", "borders and trees, packed", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, classes: bool | None = None, trees: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, features: Sequence[str], borders: list[list[float]], classes: bool, trees: list[Tree]) -> Forest:
        packed = io.BytesIO()
        sides = {name: np.stack(side) for name, side in zip(Tree._fields, zip(*trees, strict=True), strict=True)}
        np.savez_compressed(packed, **sides, **{f"borders{i}": np.array(b, float) for i, b in enumerate(borders)})
        return cls(inputCols=list(features), classes=classes, trees=base64.b64encode(packed.getvalue()).decode())

    def _parts(self) -> tuple[list[list[float]], list[Tree]]:
        packed = np.load(io.BytesIO(base64.b64decode(self.getOrDefault(self.trees))))
        borders = [packed[f"borders{i}"].tolist() for i in range(len(self.getOrDefault(self.inputCols)))]
        return borders, [Tree(*sides) for sides in zip(*[packed[name] for name in Tree._fields], strict=True)]

    @property
    def getNumTrees(self) -> int:
        return len(self._parts()[1])

    @property
    def featureImportances(self) -> DenseVector:
        """The share of each feature in the gains, a mean of the trees' shares."""
        shares = [t.gains / t.gains.sum() for t in self._parts()[1] if t.gains.sum() > 0]
        found = np.sum(shares, axis=0) if shares else np.zeros(len(self.getOrDefault(self.inputCols)))
        return Vectors.dense(found / (found.sum() or 1.0))

    def _transform(self, df: DataFrame) -> DataFrame:
        features = self.getOrDefault(self.inputCols)
        borders, trees = self._parts()
        # plain arrays: executors may have no copy of this module
        shared = df.sparkSession.sparkContext.broadcast((borders, *full(trees)))

        @F.pandas_udf("double")
        def mean(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            borders, *sides = shared.value
            return by_cell(batches, borders, lambda bins: walked(bins, *sides) / len(sides[0]))

        found = mean(*[F.col(c).cast("double") for c in features])
        if not self.getOrDefault(self.classes):
            return df.withColumn("prediction", found)
        scored = df.withColumn("_risk", found)
        return scored.withColumns(
            {"probability": array_to_vector(F.array(1 - F.col("_risk"), F.col("_risk"))), "prediction": (F.col("_risk") > 0.5).cast("double")}
        ).drop("_risk")
