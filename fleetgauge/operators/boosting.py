"""Gradient-boosted trees over binned features, several models in one run.

Features are cut at approximate quantiles. Rows that agree in all bins are one cell with sums
of the label by fold and side, from which every gradient and loss follows exactly, so that what
a round works on is bounded by the number of different cells. Up to ``CELLS`` of them a model
is fitted by one task, all models at once: its cells stay there with the margin the model gives
them, and a round takes no job. More cells stay in blocks, and a round goes on from there: each
level of the trees is a job that sums the blocks' histograms, all models' at once, and the
driver takes the splits. (No barrier stage does this: each of its exchanges takes a second at
least, however little is sent.) A model may leave one fold out; each model ends when a slice of
its training rows has gained nothing for some rounds, and is cut back to its best round.

After a bounded number of rounds the cells with their margins are written to the shared
folder: a lost executor costs the rounds since then.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence
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
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from fleetgauge.sources.shared import remove_shared, write_shared

# Functions of this module travel with the job, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature, one of them for missing values.
BINS = 64
#: Bits of a bin in a code.
BITS = 6
#: Cells that one task fits a model on, a block being a twentieth, and rounds until margins
#: are written.
CELLS, ROUNDS_A_JOB = 1_000_000, 100
#: Bins of features whose histogram is taken at once, and rows that walk down trees at once.
JOINT, WALK = 1 << 10, 1 << 14
#: Cells for which a grid is worth it, and its places for each of them, at most.
GRID, SPARE = 1 << 14, 4
#: Blocks whose histograms the driver adds up; more are added up by tasks first.
DIRECT = 64
#: Added to the sum of second derivatives of a leaf; least such sum of a split's sides.
SMOOTHING, LEAST = 1.0, 1e-3
SQUARED, LOGISTIC = "squared", "logistic"

ALONE = "model int, bins binary, n binary, total binary, held_n binary, held_total binary, held_squares binary, margin binary, log string"
NUMBERS = ["n", "total", "held_n", "held_total", "held_squares"]
STATE = "part int, bins binary, folds binary, held binary, n binary, total binary, squares binary, margins binary, log string"


class Options(NamedTuple):
    loss: str
    rounds: int
    step: float
    depth: int
    patience: int | None


class Ensemble(NamedTuple):
    """A fitted model, and the losses on its held rows after 0, 1, .. rounds."""

    start: float
    features: np.ndarray  # trees x (2 ** depth - 1)
    bins: np.ndarray
    leaves: np.ndarray  # trees x 2 ** depth
    losses: list[float]


def bin_borders(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Ascending borders of each feature, from one pass of mergeable quantile sketches."""
    share = [k / (BINS - 1) for k in range(1, BINS - 1)]
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features}
    row = df.agg(*[F.percentile_approx(number[c], share, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(row[i] or [])) for i in range(len(features))]


def binned(values: Sequence[np.ndarray], borders: list[list[float]]) -> np.ndarray:
    """(features, rows): 0 for missing values, else 1 + the number of borders below."""
    return np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(b, v, "left")).astype(np.uint8) for v, b in zip(values, borders, strict=True)])


def codes_of(features: int) -> list[str]:
    """Names of the numbers that hold a row's bins."""
    return [f"code{i}" for i in range(-(-features // (63 // BITS)))]


def packed(bins: np.ndarray) -> list[np.ndarray]:
    """The bins of each row as few numbers."""
    out = []
    for first in range(0, len(bins), 63 // BITS):
        code = np.zeros(bins.shape[1], np.int64)
        for i, own in enumerate(bins[first : first + 63 // BITS]):
            code |= own.astype(np.int64) << (BITS * i)
        out.append(code)
    return out


def unpacked(codes: Sequence[np.ndarray], features: int) -> np.ndarray:
    """(features, rows): the bins that ``packed`` took."""
    places = [divmod(f, 63 // BITS) for f in range(features)]
    return np.stack([(codes[c] >> (BITS * i) & (1 << BITS) - 1).astype(np.uint8) for c, i in places])


def with_codes(df: DataFrame, features: Sequence[str], borders: list[list[float]], *others: Column) -> DataFrame:
    """The codes of each row, and other columns."""
    given = df.select(*[F.col(c).cast("double").alias(f"feature{i}") for i, c in enumerate(features)], *others)
    width, names = len(features), codes_of(len(features))
    kept = given.columns[width:]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], borders)
            yield pa.RecordBatch.from_arrays([*map(pa.array, packed(bins)), *batch.columns[width:]], names=[*names, *kept])

    return given.mapInArrow(code, StructType([*[StructField(c, LongType()) for c in names], *given.schema.fields[width:]]))


def by_cell(batches: Iterator[tuple[pd.Series, ...]], borders: list[list[float]], score: Callable[[np.ndarray], np.ndarray]) -> Iterator[pd.Series]:
    """The score of each row's bins. Scores are kept, as rows of later batches have the same bins."""
    seen, scores = np.empty(0, np.int64), np.empty(0)
    for columns in batches:
        bins = binned([c.to_numpy(float) for c in columns], borders)
        codes = packed(bins)
        if len(codes) > 1:
            yield pd.Series(score(bins))
            continue
        own, first, back = np.unique(codes[0], return_index=True, return_inverse=True)
        at = np.searchsorted(seen, own)
        new = np.append(seen, -1)[at] != own
        found = np.empty(len(own))
        found[~new] = scores[at[~new]]
        found[new] = score(bins[:, first[new]])
        if len(seen) > CELLS:
            seen, scores = own, found
        else:
            seen, scores = np.insert(seen, at[new], own[new]), np.insert(scores, at[new], found[new])
        yield pd.Series(found[back])


def walked(bins: np.ndarray, features: np.ndarray, borders: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """The sum, at each row, of its leaves in trees that have all their nodes."""
    rows, width = bins.shape[1], len(bins)
    out = np.zeros(rows)
    for first in range(0, rows, WALK):
        own = np.ascontiguousarray(bins[:, first : first + WALK].T)
        flat, row = own.ravel(), np.arange(len(own)) * width
        for feature, border, leaf in zip(features, borders, leaves, strict=True):
            feature, at = feature.astype(np.int64), np.zeros(len(own), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                right = flat.take(row + feature.take(at)) > border.take(at)
                at += at
                at += 1
                at += right
            out[first : first + WALK] += leaf.take(at - len(feature))
    return out


def cells(df: DataFrame, features: Sequence[str], borders: list[list[float]], label: str, fold: Column, held: Column) -> DataFrame:
    """One row per combination of bins, fold and side, with count, sum and squares of the label."""
    y = F.col(label).cast("double")
    rows = with_codes(df.where(y.isNotNull()), features, borders, fold.cast("int").alias("fold"), held.alias("held"), y.alias("y"))
    keys = [c for c in rows.columns if c != "y"]
    return rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("total"), F.sum(F.col("y") * F.col("y")).alias("squares"))


class State:
    """The cells of a block and the models' margins there."""

    def __init__(self, bins: np.ndarray, folds: np.ndarray, held: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray, margins: np.ndarray):
        self.bins, self.folds, self.held = bins, folds, held
        self.n, self.total, self.squares, self.margins = n, total, squares, margins

    @classmethod
    def of(cls, row: Row | dict, features: int, models: int) -> State:
        kinds = [np.uint8, np.int32, bool, float, float, float, float]
        shapes = [(features, -1), (-1,), (-1,), (-1,), (-1,), (-1,), (models, -1)]
        names = ["bins", "folds", "held", "n", "total", "squares", "margins"]
        return cls(*[np.frombuffer(row[c], kind).reshape(shape) for c, kind, shape in zip(names, kinds, shapes, strict=True)])

    def arrays(self) -> list[np.ndarray]:
        return [self.bins, self.folds, self.held, self.n, self.total, self.squares, self.margins]

    def record(self, part: int, log: str | None = None) -> pa.RecordBatch:
        columns = [pa.array([a.tobytes()], pa.binary()) for a in self.arrays()]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *columns, pa.array([log], pa.string())], names=[f.split()[0] for f in STATE.split(", ")])

    def placed(self, splits: list[tuple[np.ndarray, np.ndarray]], models: int) -> np.ndarray:
        """(models, cells): the node of each cell below the splits so far."""
        nodes, rows, each = np.zeros((models, len(self.n)), np.int64), np.arange(models)[:, None], np.arange(len(self.n))
        for feature, border in splits:
            nodes = 2 * nodes + (self.bins[feature[rows, nodes], each] > border[rows, nodes])
        return nodes

    def level(self, loss: str, some: np.ndarray, folds: int, splits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The histogram of the nodes below the splits so far."""
        return self.histogram(self.placed(splits, len(some)), 2 ** len(splits), *self.slopes(loss, some, folds))

    def moved(self, some: np.ndarray, splits: list[tuple[np.ndarray, np.ndarray]], leaves: np.ndarray) -> State:
        """The same cells, with a tree more in the margins of some models."""
        margins = self.margins.copy()
        margins[some] += leaves[np.arange(len(some))[:, None], self.placed(splits, len(some))]
        return State(*self.arrays()[:-1], margins)

    def slopes(self, loss: str, some: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives (models, cells) of the training loss."""
        train = ~self.held & ((self.folds != some[:, None]) | (some[:, None] == folds))
        margin = self.margins[some]
        if loss == SQUARED:
            first, second = self.n * margin - self.total, np.broadcast_to(self.n, margin.shape)
        else:
            p = 1 / (1 + np.exp(-margin))
            first, second = self.n * p - self.total, self.n * p * (1 - p)
        return np.where(train, first, 0), np.where(train, second, 0)

    def losses(self, loss: str, some: np.ndarray, folds: int) -> np.ndarray:
        """(models, 2): loss on the held rows of each model, and their number."""
        own = self.held & ((self.folds != some[:, None]) | (some[:, None] == folds))
        margin = self.margins[some]
        if loss == SQUARED:
            each = self.squares - 2 * margin * self.total + self.n * margin * margin
        else:
            each = self.total * np.logaddexp(0, -margin) + (self.n - self.total) * np.logaddexp(0, margin)
        return np.stack([np.where(own, each, 0).sum(axis=1), np.where(own, self.n, 0).sum(axis=1)], axis=1)

    def histogram(self, nodes: np.ndarray, width: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """(models, nodes, features, bins, 2): sums of both derivatives."""
        models = len(nodes)
        place = (np.arange(models)[:, None] * width + nodes) * BINS
        out = np.zeros((2, len(self.bins), models * width * BINS))
        for f, own in enumerate(self.bins):
            at = (place + own).ravel()
            for k, values in enumerate((first, second)):
                out[k, f] = np.bincount(at, values.ravel(), models * width * BINS)
        return out.reshape(2, len(self.bins), models, width, BINS).transpose(2, 3, 1, 4, 0)


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, last bin on the left, sums of the children) of each node of each model, from
    its histogram; a node without a gain sends all to the left."""
    left = sums.cumsum(axis=3)
    whole = left[:, :, :, -1:, :]
    right = whole - left
    quality = lambda x: x[..., 0] ** 2 / (x[..., 1] + SMOOTHING)
    gain = quality(left) + quality(right) - quality(whole)
    gain[(left[..., 1] < LEAST) | (right[..., 1] < LEAST)] = -np.inf
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=2)
    none = ~(np.take_along_axis(flat, best[..., None], 2)[..., 0] > 1e-9)
    feature, border = best // BINS, best % BINS
    feature[none], border[none] = 0, BINS - 1
    a, b = np.indices(best.shape)
    children = np.stack([left[a, b, feature, border], right[a, b, feature, border]], axis=2)
    return feature, border, children.reshape(best.shape[0], -1, 2)


class Alone:
    """All cells of one model in the task that fits it, for ``_rounds`` its blocks and their
    ``State`` in one. What a level finds out is kept for the next."""

    def __init__(self, bins: np.ndarray, n: np.ndarray, total: np.ndarray, held_n: np.ndarray, held_total: np.ndarray, held_squares: np.ndarray, margin: np.ndarray):
        self.kept, self.margin, self.bins = [bins, n, total, held_n, held_total, held_squares], margin.copy(), bins
        self.n, self.sum = n, total
        self.held = np.flatnonzero(held_n)
        self.own = [side[self.held] for side in (held_n, held_total, held_squares)]
        self.flat, self.row = np.ascontiguousarray(bins.T).ravel(), np.arange(len(n)) * len(bins)
        # features of few bins share a histogram, from which each one's is summed
        used = [np.unique(own) for own in bins]
        self.used = used
        self.groups: list[tuple[list[int], list[np.ndarray], np.ndarray]] = []
        width = JOINT + 1
        for f in sorted(range(len(bins)), key=lambda f: len(used[f])):
            place = np.searchsorted(used[f], bins[f])
            if width * len(used[f]) <= JOINT:
                some, marks, joint = self.groups[-1]
                self.groups[-1] = [*some, f], [*marks, used[f]], joint * len(used[f]) + place
                width *= len(used[f])
            else:
                self.groups.append(([f], [used[f]], place))
                width = len(used[f])

    def record(self, model: int, log: str | None = None) -> pa.RecordBatch:
        columns = [pa.array([a.tobytes()], pa.binary()) for a in (*self.kept, self.margins())]
        return pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), *columns, pa.array([log], pa.string())], names=[f.split()[0] for f in ALONE.split(", ")])

    def margins(self) -> np.ndarray:
        return self.margin

    def total(self, work: Callable[[Alone], np.ndarray]) -> np.ndarray:
        return work(self)

    def move(self, work: Callable[[Alone], Alone]) -> None:
        work(self)

    def _slope(self, loss: str) -> None:
        if loss == SQUARED:
            self.slopes = self.n * self.margin - self.sum, self.n
        else:
            p = 1 / (1 + np.exp(-self.margin))
            self.slopes = self.n * p - self.sum, self.n * p * (1 - p)

    def _place(self, split: tuple[np.ndarray, np.ndarray]) -> None:
        """Each cell goes on from its node by the last split."""
        feature, border = split[0][0], split[1][0]
        right = self.flat.take(self.row + feature.take(self.nodes)) > border.take(self.nodes)
        self.nodes += self.nodes
        self.nodes += right

    def level(self, loss: str, some: np.ndarray, folds: int, splits: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if splits:
            self._place(splits[-1])
        else:
            self.nodes = np.zeros(len(self.n), np.int64)
            self._slope(loss)
        width = 2 ** len(splits)
        out = np.zeros((1, width, len(self.bins), BINS, 2))
        for some, marks, joint in self.groups:
            sizes = [len(m) for m in marks]
            at = self.nodes * int(np.prod(sizes)) + joint if splits else joint
            for k, slope in enumerate(self.slopes):
                sums = np.bincount(at, slope, width * int(np.prod(sizes))).reshape(width, *sizes)
                for i, (f, mark) in enumerate(zip(some, marks, strict=True)):
                    out[0, :, f, mark, k] = sums.sum(axis=tuple(j + 1 for j in range(len(sizes)) if j != i)).T
        return out

    def losses(self, loss: str, some: np.ndarray, folds: int) -> np.ndarray:
        n, total, squares = self.own
        margin = self.margin[self.held]
        if loss == SQUARED:
            each = squares - 2 * margin * total + n * margin * margin
        else:
            each = n * (np.maximum(margin, 0) + np.log(1 + np.exp(-np.abs(margin)))) - total * margin
        return np.array([[each.sum(), n.sum()]])

    def moved(self, some: np.ndarray, splits: Sequence[tuple[np.ndarray, np.ndarray]], leaves: np.ndarray) -> Alone:
        self._place(splits[-1])
        self.margin += leaves[0].take(self.nodes)
        return self


class Grid(Alone):
    """As ``Alone``, where the cells fill much of the grid of all combinations of bins: there a
    node is a box, so its sums are those of a part of the grid, and no cell has to be placed."""

    def __init__(self, *arrays: np.ndarray):
        super().__init__(*arrays)
        # many bins last, as sums run along them
        self.axes = sorted(range(len(self.bins)), key=lambda f: len(self.used[f]))
        shape = [len(self.used[f]) for f in self.axes]
        self.at = np.ravel_multi_index([np.searchsorted(self.used[f], self.bins[f]) for f in self.axes], shape)
        self.n, self.sum, self.margin = (self._spread(side, shape) for side in (self.n, self.sum, self.margin))
        self.held = self.at[self.held]

    def _spread(self, side: np.ndarray, shape: list[int]) -> np.ndarray:
        out = np.zeros(int(np.prod(shape)))
        out[self.at] = side
        return out.reshape(shape)

    def margins(self) -> np.ndarray:
        return self.margin.ravel()[self.at]

    def level(self, loss: str, some: np.ndarray, folds: int, splits: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if splits:
            self._cut(splits[-1])
        else:
            self.boxes = [tuple(slice(0, len(self.used[f])) for f in self.axes)]
            self._slope(loss)
        out = np.zeros((1, len(self.boxes), len(self.bins), BINS, 2))
        for node, box in enumerate(self.boxes):
            for k, slope in enumerate(self.slopes):
                sums = slope[box]
                if not sums.size:
                    continue
                for axis in reversed(range(len(box))):
                    f = self.axes[axis]
                    out[0, node, f, self.used[f][box[axis]], k] = sums.sum(axis=tuple(range(axis)))
                    sums = sums.sum(axis=axis)
        return out

    def losses(self, loss: str, some: np.ndarray, folds: int) -> np.ndarray:
        grid, self.margin = self.margin, self.margin.ravel()
        out = super().losses(loss, some, folds)
        self.margin = grid
        return out

    def _cut(self, split: tuple[np.ndarray, np.ndarray]) -> None:
        """Each box becomes two by the last split, of which one may be empty."""
        out = []
        for box, f, border in zip(self.boxes, split[0][0], split[1][0], strict=True):
            axis = self.axes.index(f)
            own = box[axis]
            cut = min(max(int(np.searchsorted(self.used[f], border, "right")), own.start), own.stop)
            out += [(*box[:axis], slice(own.start, cut), *box[axis + 1 :]), (*box[:axis], slice(cut, own.stop), *box[axis + 1 :])]
        self.boxes = out

    def moved(self, some: np.ndarray, splits: Sequence[tuple[np.ndarray, np.ndarray]], leaves: np.ndarray) -> Grid:
        self._cut(splits[-1])
        for box, leaf in zip(self.boxes, leaves[0], strict=True):
            self.margin[box] += leaf
        return self


def alone(arrays: list[np.ndarray]) -> Alone:
    """The cells of one model, on a grid where they fill enough of it."""
    count, places = arrays[0].shape[1], np.prod([float(len(np.unique(own))) for own in arrays[0]])
    return (Grid if count >= GRID and places <= SPARE * count else Alone)(*arrays)


class Across:
    """Blocks kept by the executors, seen from the driver."""

    def __init__(self, blocks: RDD):
        self.blocks, self.before = blocks.persist(StorageLevel.MEMORY_AND_DISK), None

    def total(self, work: Callable[[State], np.ndarray]) -> np.ndarray:
        """The sum of an array over the blocks."""
        arrays = self.blocks.map(lambda block: work(State(*block)))
        out = sum(arrays.collect()) if arrays.getNumPartitions() <= DIRECT else arrays.treeReduce(np.add)
        self._forget()
        return out

    def move(self, work: Callable[[State], State]) -> None:
        """A new state of the blocks; the old one is kept until a job has made it."""
        self._forget()
        self.before, self.blocks = self.blocks, self.blocks.map(lambda block: work(State(*block)).arrays()).persist(StorageLevel.MEMORY_AND_DISK)

    def _forget(self) -> None:
        if self.before is not None:
            self.before.unpersist()
            self.before = None

    def close(self) -> None:
        self._forget()
        self.blocks.unpersist()


def _rounds(cells: Alone | Across, options: Options, folds: int, first_round: int, known: list[dict]) -> dict:
    """Some rounds on. ``known`` has each model's losses so far and whether it goes on; so has
    what is returned, with the new trees."""
    loss, active = options.loss, np.array([m for m, k in enumerate(known) if k["active"]])
    losses, trees = [list(m["losses"]) for m in known], [[] for _ in known]

    def note(measured: np.ndarray) -> np.ndarray:
        """Which of the active models go on, given their losses on held rows."""
        on = []
        for model, (error, n) in zip(active, measured.tolist(), strict=True):
            own = losses[model]
            own.append(error / n if n else 0.0)
            best = min(range(len(own)), key=own.__getitem__)
            on.append(not (options.patience and n and len(own) - 1 - best >= options.patience))
        return np.array(on, bool)

    last = min(first_round + ROUNDS_A_JOB, options.rounds)
    for _ in range(first_round, last):
        splits: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(options.depth):
            if level == 0:
                both = cells.total(lambda s, some=active: np.concatenate([s.level(loss, some, folds, []).ravel(), s.losses(loss, some, folds).ravel()]))
                held = both[-2 * len(active) :].reshape(-1, 2)
                sums = both[: -held.size].reshape(len(active), 1, -1, BINS, 2)
                on = note(held)
                active, sums = active[on], sums[on]
                if not len(active):
                    break
            else:
                sums = cells.total(lambda s, some=active, splits=tuple(splits): s.level(loss, some, folds, splits))
            feature, border, children = best_splits(sums)
            splits.append((feature, border))
        if not len(active):
            break
        leaves = -options.step * children[..., 0] / (children[..., 1] + SMOOTHING)
        cells.move(lambda s, some=active, splits=tuple(splits), leaves=leaves: s.moved(some, splits, leaves))
        feature, border = (np.concatenate(side, axis=1) for side in zip(*splits, strict=True))
        for row, model in enumerate(active):
            trees[model].append([feature[row].tolist(), border[row].tolist(), leaves[row].tolist()])
    if len(active) and last == options.rounds:
        note(cells.total(lambda s, some=active: s.losses(loss, some, folds)))
        active = active[:0]
    return {"active": active.tolist(), "losses": losses, "trees": trees}


def _in_tasks(summed: DataFrame, features: int, options: Options, folds: int, starts: list[float], known: list[dict]) -> None:
    """The rounds of all models, a model a task."""
    spark, codes = summed.sparkSession, codes_of(features)
    held, models = F.coalesce("held", F.lit(False)), []
    for m in range(folds + 1):
        own = F.lit(True) if m == folds else F.coalesce(F.col("fold") != m, F.lit(True))
        part = lambda c, side, own=own: F.sum(F.when(own & side, F.col(c)).otherwise(0.0))
        sides = [part("n", ~held), part("total", ~held), part("n", held), part("total", held), part("squares", held)]
        models.append(F.struct(F.lit(m).alias("model"), *[s.alias(c) for s, c in zip(sides, NUMBERS, strict=True)]))
    each = summed.groupBy(*codes).agg(F.array(*models).alias("models")).select(*codes, F.inline("models"))
    each = each.where((F.col("n") > 0) | (F.col("held_n") > 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            table = pa.Table.from_batches(some).sort_by([(c, "ascending") for c in codes])
            column = lambda c: table.column(c).to_numpy()
            model = int(column("model")[0])
            bins = unpacked([column(c) for c in codes], features)
            yield Alone(bins, *[column(c) for c in NUMBERS], np.full(table.num_rows, starts[model])).record(model)

    state = write_shared(each.repartitionById(folds + 1, "model").mapInArrow(pack, ALONE))
    done = 0
    while done < options.rounds and any(k["active"] for k in known):
        active = [m for m, k in enumerate(known) if k["active"]]
        so_far = [[{k: m[k] for k in ("losses", "active")}] for m in known]

        def run(batches: Iterator[pa.RecordBatch], so_far=so_far, done=done) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    numbers = [np.frombuffer(row[c], float) for c in (*NUMBERS, "margin")]
                    own = alone([np.frombuffer(row["bins"], np.uint8).reshape(features, -1), *numbers])
                    log = _rounds(own, options, 0, done, so_far[row["model"]])
                    yield own.record(row["model"], json.dumps(log))

        rows = state.where(F.col("model").isin(active)).repartitionById(folds + 1, "model")
        turned = write_shared(rows.mapInArrow(run, ALONE))
        for row in turned.select("model", "log").collect():
            model, log = known[row.model], json.loads(row.log)
            model["losses"], model["active"] = log["losses"][0], bool(log["active"])
            model["trees"] += log["trees"][0]
            active.remove(row.model)
        for m in active:  # no rows to fit on
            known[m]["active"] = False
        remove_shared(state)
        state, done = turned, done + ROUNDS_A_JOB
    remove_shared(state)


def _blocks(state: DataFrame, tasks: int, features: int, models: int) -> RDD:
    """The arrays of each block, a block a task."""
    keyed = state.rdd.map(lambda row: (row.part, State.of(row, features, models).arrays()))
    return keyed.partitionBy(tasks, int).values()


def _written(blocks: RDD, spark: SparkSession) -> DataFrame:
    def rows(part: int, own: Iterator[list[np.ndarray]]) -> Iterator[tuple]:
        return ((part, *[a.tobytes() for a in block], None) for block in own)

    return spark.createDataFrame(blocks.mapPartitionsWithIndex(rows), STATE)


def _in_blocks(summed: DataFrame, features: int, options: Options, folds: int, starts: list[float], known: list[dict], count: int) -> None:
    """The rounds of all models, over blocks of cells."""
    spark, codes = summed.sparkSession, codes_of(features)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-count // max(1, CELLS // 20))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            table = pa.Table.from_batches(some)
            column = lambda c: table.column(c).to_numpy()
            margins = np.repeat(np.array(starts)[:, None], table.num_rows, axis=1)
            bins = unpacked([column(c) for c in codes], features)
            state = State(bins, column("fold").astype(np.int32), column("held").astype(bool), column("n"), column("total"), column("squares"), margins)
            yield state.record(TaskContext.get().partitionId())

    sides = summed.withColumns({"fold": F.coalesce("fold", F.lit(-1)), "held": F.coalesce("held", F.lit(False))})
    state = write_shared(sides.repartition(tasks).mapInArrow(pack, STATE))
    done = 0
    while done < options.rounds and any(k["active"] for k in known):
        so_far = [{k: m[k] for k in ("losses", "active")} for m in known]
        own = Across(_blocks(state, tasks, features, folds + 1))
        log = _rounds(own, options, folds, done, so_far)
        turned = write_shared(_written(own.blocks, spark)) if log["active"] else state
        own.close()
        if turned is not state:
            remove_shared(state)
        state = turned
        for m, model in enumerate(known):
            model["losses"], model["active"] = log["losses"][m], m in log["active"]
            model["trees"] += log["trees"][m]
        done += ROUNDS_A_JOB
    remove_shared(state)


def fit_ensembles(
    df: DataFrame, features: Sequence[str], borders: list[list[float]], label: str, options: Options,
    fold: Column | None = None, folds: int = 0, held: Column | None = None,
) -> list[Ensemble]:
    """``folds`` models that each leave one fold out, and one that sees all rows.

    Rows without a label are left out. ``held`` marks the rows that decide when a model ends;
    without it, or with a ``patience`` of None, all rounds are run. No rows give models without
    trees.
    """
    summed = cells(df, features, borders, label, F.lit(-1) if fold is None else fold, F.lit(False) if held is None else held)
    summed = write_shared(summed)
    out = fit_cells(summed, len(features), options, folds)
    remove_shared(summed)
    return out


def fit_cells(summed: DataFrame, features: int, options: Options, folds: int = 0) -> list[Ensemble]:
    """As ``fit_ensembles``, from what ``cells`` gives, which is read several times."""
    sums = summed.groupBy("fold", "held").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    starts = []
    for m in range(folds + 1):
        own = [r for r in sums if not r.held and (r.fold != m or m == folds)]
        n, total = sum(r.n for r in own), sum(r.total for r in own)
        mean = total / n if n else 0.0
        odds = min(max(mean, 1e-6), 1 - 1e-6)
        starts.append(mean if options.loss == SQUARED else float(np.log(odds / (1 - odds))))
    known = [{"losses": [], "active": bool(sums), "trees": []} for _ in starts]
    if summed.select(*codes_of(features)).distinct().count() <= CELLS:
        _in_tasks(summed, features, options, folds, starts, known)
    else:
        _in_blocks(summed, features, options, folds, starts, known, sum(r.cells for r in sums))
    out = []
    for start, model in zip(starts, known, strict=True):
        trees = model["trees"]
        if options.patience and any(model["losses"]):
            trees = trees[: min(range(len(model["losses"])), key=model["losses"].__getitem__)]
        nodes = 2**options.depth
        arrays = [np.array([t[i] for t in trees]).reshape(len(trees), nodes - (i < 2)) for i in range(3)]
        out.append(Ensemble(start, arrays[0].astype(np.int64), arrays[1].astype(np.int64), arrays[2].astype(float), model["losses"]))
    return out


def margins(bins: np.ndarray, model: Ensemble) -> np.ndarray:
    """The sum of the trees at each row of ``bins`` (features, rows)."""
    return model.start + walked(bins, model.features, model.bins, model.leaves)


def cell_margin(features: int, models: list[Ensemble], which: str) -> Column:
    """The margin of each cell under the model ``which`` (a column with its index); 0 without one."""

    @F.pandas_udf("double")
    def margin(which: pd.Series, *codes: pd.Series) -> pd.Series:
        bins, out = unpacked([c.to_numpy() for c in codes], features), np.zeros(len(which))
        for m, model in enumerate(models):
            own = (which == m).to_numpy()
            out[own] = margins(bins[:, own], model)
        return pd.Series(out)

    return margin(which, *codes_of(features))


def margin_column(features: Sequence[str], borders: list[list[float]], model: Ensemble) -> Column:
    """The margin of each row."""

    @F.pandas_udf("double")
    def margin(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        return by_cell(batches, borders, lambda bins: margins(bins, model))

    return margin(*[F.col(c).cast("double") for c in features])


class BoostedTrees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ensemble as a Spark ML model: adds ``prediction``, and ``probability`` of the
    two classes where the loss is logistic."""

    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    loss = Param(Params._dummy(), "loss", "squared or logistic", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "borders, start, splits and leaves as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, loss: str | None = None, trees: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, features: Sequence[str], borders: list[list[float]], loss: str, model: Ensemble) -> BoostedTrees:
        parts = {"borders": borders, **{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in model._asdict().items()}}
        parts["nodes"] = int(model.leaves.shape[1])
        return cls(inputCols=list(features), loss=loss, trees=json.dumps(parts))

    def _parts(self) -> tuple[list[list[float]], Ensemble]:
        parts = json.loads(self.getOrDefault(self.trees))
        nodes = parts["nodes"]
        shaped = lambda name, width, kind: np.array(parts[name], kind).reshape(-1, width)
        return parts["borders"], Ensemble(
            parts["start"], shaped("features", nodes - 1, np.int64), shaped("bins", nodes - 1, np.int64), shaped("leaves", nodes, float), parts["losses"]
        )

    @property
    def getNumTrees(self) -> int:
        return len(self._parts()[1].leaves)

    @property
    def losses(self) -> list[float]:
        """On the held rows, after 0, 1, .. rounds."""
        return self._parts()[1].losses

    @property
    def featureImportances(self) -> DenseVector:
        """The share of all real splits that each feature has, weighted by their level."""
        _, model = self._parts()
        weight = np.concatenate([np.full(2**k, 2.0**-k) for k in range(model.leaves.shape[1].bit_length() - 1)])
        real = model.bins < BINS - 1
        found = np.bincount(model.features[real], np.broadcast_to(weight, real.shape)[real], len(self.getOrDefault(self.inputCols)))
        return Vectors.dense(found / (found.sum() or 1.0))

    def _transform(self, df: DataFrame) -> DataFrame:
        borders, model = self._parts()
        margin = margin_column(self.getOrDefault(self.inputCols), borders, model)
        if self.getOrDefault(self.loss) == SQUARED:
            return df.withColumn("prediction", margin)
        scored = df.withColumn("_risk", 1 / (1 + F.exp(-margin)))
        return scored.withColumns(
            {"probability": array_to_vector(F.array(1 - F.col("_risk"), F.col("_risk"))), "prediction": (F.col("_risk") > 0.5).cast("double")}
        ).drop("_risk")
