"""Boosted trees from histograms, grown best leaf first.

Every feature is cut into at most 255 bins once, by quantiles of the rows that are fitted, and the rows become blocks of bin
numbers with their label, weight and score so far. A tree grows level by level: tasks add up gradients, second
derivatives and rows per (leaf, feature, bin), Spark sums these histograms over the tasks, and the split of highest gain is read off
for each leaf, with the side for missing values that gains more. Only the smaller child of a split is counted, its sibling is
the difference to their parent. Features of few bins are counted together, in the cells of their joint bins, and added up
afterwards. Where the open leaves together have few enough rows, each is sent to one task, which grows the rest of its branch.
The splits a leaf gets do not depend on the other leaves, so taking them afterwards in order of gain until the tree has its number
of leaves gives the tree that grows its best leaf first.

The blocks are kept by the executors with scores that each tree moves on, and written every ``WINDOW`` trees, which ends the
lineage; the AUC of the held-out rows is taken after each tree, and growing stops when it has not risen for the patience. What reaches the driver are histograms of
leaves x features x bins and finished branches, whatever the number of rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.functions.parsing import clean
from riskframe.operators.trees import NODE_SCHEMA, Ensemble, Node
from riskframe.session import scratch_path
from riskframe.sources.layers import remove_directory

BLOCK_ROWS = 32_768
BLOCKS_PER_TASK = 64
IN_TASK_ROWS = 262_144  # open leaves of so many rows together are finished by one task each
IN_TASK_CELLS = 1 << 26  # their rows times features
JOINT_CELLS = 512  # of features that are counted together
HISTOGRAM_BYTES = 1 << 31  # of one level of one tree
COLLECTED_TASKS = 32  # histograms of more tasks are added up by Spark
COLLECTED_BYTES = 1 << 27  # and so are larger ones
SKETCH_ROWS = 262_144  # values that are sorted at a time
SKETCH_POINTS = 64  # values kept of them, for each bin
WINDOW = 20  # trees between two writes of the scores
AUC_BINS = 4096
LEAST_HESSIAN = 1e-3
LEAST_GAIN = 1e-10
SAME_GAIN = 1e-10  # gains that differ by this share are equal: sums in another order
_BLOCK = "block long, rows int, x binary, y binary, w binary, score binary"


@dataclass(frozen=True)
class BoostingParameters:
    trees: int
    depth: int
    learning_rate: float
    min_rows: int
    bins: int = 255
    patience: int = 50
    leaves: int = 63
    ridge: float = 1.0

    def __post_init__(self):
        if not (self.trees > 0 and self.depth > 0 and self.leaves > 1 and 1 < self.bins <= 255):
            raise ValueError("boosting needs trees, depth, two leaves and 2 to 255 bins")


@dataclass(frozen=True)
class Tree:
    """Parallel arrays, a child after its parent; feature -1 is a leaf. ``bin`` is the last bin that goes left."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def reached(self, x: np.ndarray, missing: int, wanted: list[int] | None = None) -> Iterator[tuple[int, np.ndarray | None]]:
        """The columns of the bin numbers that end in each leaf, or in each of the wanted ones; None is all columns. The
        columns are dealt out node by node on the ways to these leaves, so that a level reads one number per column."""
        need = np.ones(len(self.feature), bool)
        if wanted is not None:
            need[:] = False
            need[wanted] = True
            for node in range(len(need) - 1, -1, -1):
                if self.feature[node] >= 0:
                    need[node] = need[self.left[node]] or need[self.right[node]]
        open_: list[tuple[int, np.ndarray | None]] = [(0, None)]  # all columns are at the root
        while open_:
            node, rows = open_.pop()
            feature = self.feature[node]
            if not need[node]:
                continue
            if feature < 0:
                yield node, rows
                continue
            code = x[feature] if rows is None else x[feature].take(rows)
            left = code <= self.bin[node]  # a missing value has the highest number
            if self.missing_left[node]:
                left |= code == missing
            for child, keep in ((self.left[node], True), (self.right[node], False)):
                if need[child]:
                    side = np.flatnonzero(left if keep else ~left)
                    open_.append((child, side if rows is None else rows.take(side)))

    def walked(self, x: np.ndarray, missing: int) -> np.ndarray:
        """The leaf of every column, all of them one level at a time: for few columns, where the nodes are many."""
        nodes, columns = np.arange(len(self.feature)), np.arange(x.shape[1])
        ends, flat = self.feature < 0, np.ascontiguousarray(x).ravel()
        start = np.where(ends, 0, self.feature) * x.shape[1]
        following = np.stack([np.where(ends, nodes, self.right), np.where(ends, nodes, self.left)], axis=1).ravel()
        at = np.zeros(x.shape[1], np.int64)
        while not ends.take(at).all():
            code = flat.take(start.take(at) + columns)
            left = code <= self.bin.take(at)
            left |= (code == missing) & self.missing_left.take(at)
            at = following.take(2 * at + left)
        return at

    def moved(self, x: np.ndarray, missing: int, score: np.ndarray) -> np.ndarray:
        """The scores with the value of each column's leaf added."""
        out = score.copy()
        for node, rows in self.reached(x, missing):
            if rows is None:
                out += self.value[node]
            else:
                out[rows] += self.value[node]
        return out


@dataclass(frozen=True)
class Bins:
    """Thresholds of every feature; a value lies in the first bin whose threshold is not below it, a missing one in the last."""

    features: list[str]
    thresholds: list[np.ndarray]

    @property
    def missing(self) -> int:
        return max((len(t) for t in self.thresholds), default=0) + 1

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(columns), len(columns[0]) if columns else 0), np.uint8)
        for k, (v, t) in enumerate(zip(columns, self.thresholds)):
            out[k] = np.where(np.isnan(v), self.missing, np.searchsorted(t, v, "left"))
        return out

    def threshold(self, feature: int, code: int) -> float:
        t = self.thresholds[feature]
        return float(t[code]) if code < len(t) else math.inf  # all values left, missing ones right


@dataclass(frozen=True)
class Boosted:
    """A fitted model; ``trees`` of those grown count, ``auc`` has one held-out value per grown tree."""

    bins: Bins
    grown: list[Tree]
    trees: int
    auc: list[float]

    @property
    def features(self) -> list[str]:
        return self.bins.features

    def ensemble(self, spark=None) -> Ensemble:
        return Ensemble([{i: Node(*row) for i, row in enumerate(self._rows(t))} for t in self.grown[:self.trees]])

    def nodes(self, spark) -> DataFrame:
        """The node table: leaf values in log-odds, thresholds as values of the features."""
        rows = [
            (number, i, f is None, f, t, m, left, right, v, c)
            for number, tree in enumerate(self.grown[:self.trees]) for i, (f, t, m, left, right, v, c) in enumerate(self._rows(tree))
        ]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    def _rows(self, tree: Tree) -> list[tuple]:
        out = []
        for i, f in enumerate(tree.feature.tolist()):
            cover = float(tree.cover[i])
            if f < 0:
                out.append((None, None, None, None, None, float(tree.value[i]), cover))
            else:
                threshold = self.bins.threshold(f, int(tree.bin[i]))
                out.append((self.features[f], threshold, bool(tree.missing_left[i]), int(tree.left[i]), int(tree.right[i]), None, cover))
        return out

    def raw(self, codes: np.ndarray) -> np.ndarray:
        """Log-odds from bin numbers, one column per row: the form that the training used."""
        out = np.zeros(codes.shape[1])
        for tree in self.grown[:self.trees]:
            out += tree.value[tree.walked(codes, self.bins.missing)]
        return out


# ---------------------------------------------------------------- splits

@dataclass(frozen=True)
class Joint:
    """Features in groups whose joint bins are at most ``JOINT_CELLS``: a row falls into one cell of each group, and sums
    over the cells are those of every bin of its features."""

    groups: list[list[int]]
    sizes: list[int]  # bins of each feature, the last one for missing values
    width: int

    @staticmethod
    def of(bins: Bins) -> Joint:
        sizes = [len(t) + 2 for t in bins.thresholds]
        groups: list[list[int]] = []
        cells: list[int] = []
        for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
            fits = [k for k in range(len(groups)) if cells[k] * sizes[f] <= JOINT_CELLS]
            if fits:
                k = max(fits, key=lambda k: (cells[k], -k))
                groups[k].append(f)
                cells[k] *= sizes[f]
            else:
                groups.append([f])
                cells.append(sizes[f])
        return Joint(groups, sizes, bins.missing + 1)

    def cells(self, group: list[int]) -> int:
        return math.prod(self.sizes[f] for f in group)

    def empty(self, slots: int) -> list[np.ndarray]:
        return [np.zeros((3, slots * self.cells(g))) for g in self.groups]

    def add(self, total: list[np.ndarray], x: np.ndarray, g: np.ndarray, h: np.ndarray, found: list[tuple[int, np.ndarray | None]]) -> None:
        """Gradients, second derivatives and rows of the columns that were found in each slot; ``g`` and ``h`` are in
        that order."""
        if not len(g):
            return
        rows = None if found[0][1] is None else np.concatenate([r for _, r in found])
        slot = np.repeat([s for s, _ in found], [len(g) if r is None else len(r) for _, r in found])
        for group, sums in zip(self.groups, total):
            cell = np.zeros(len(g), np.uint16)
            for f in group:
                code = np.minimum(x[f] if rows is None else x[f].take(rows), self.sizes[f] - 1)
                cell *= np.uint16(self.sizes[f])
                cell += code
            key = slot * self.cells(group)
            key += cell
            for k, weight in enumerate((g, h, None)):
                sums[k] += np.bincount(key, weight, sums.shape[1])

    def histograms(self, total: list[np.ndarray], slots: int) -> np.ndarray:
        """[slot, feature, bin, (gradient, second derivative, rows)] from the sums over cells."""
        out = np.zeros((slots, len(self.sizes), self.width, 3))
        for group, sums in zip(self.groups, total):
            shaped = sums.reshape(3, slots, *[self.sizes[f] for f in group])
            for place, f in enumerate(group):
                others = tuple(2 + k for k in range(len(group)) if k != place)
                of_bins = np.moveaxis(shaped.sum(axis=others) if others else shaped, 0, -1)
                out[:, f, :self.sizes[f] - 1] = of_bins[:, :-1]
                out[:, f, -1] = of_bins[:, -1]
        return out


@dataclass
class Splits:
    """The best split of each slot; gain 0 is none."""

    gain: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray  # [slot, 3], the sums of the left side
    total: np.ndarray


def best_splits(hist: np.ndarray, parameters: BoostingParameters) -> Splits:
    """Ties go to missing right, then to the first feature and the lowest bin. Where nothing is missing, missing values
    will follow the larger side."""
    slots, features, width, _ = hist.shape
    missing, seen = hist[:, :, -1, :], np.cumsum(hist[:, :, :-1, :], axis=2)
    total = seen[:, 0, -1, :] + missing[:, 0, :]
    ridge, least = parameters.ridge, parameters.min_rows

    def value(s):
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + ridge, 1e-300)

    best = Splits(np.zeros(slots), np.zeros(slots, int), np.zeros(slots, int), np.zeros(slots, bool), np.zeros((slots, 3)), total)
    parent, every = value(total)[:, None, None], np.arange(features)
    for side in (False, True):
        of = np.flatnonzero(missing[:, :, 2].any(axis=0)) if side else every  # elsewhere the sides are alike
        if not len(of):
            continue
        left = seen[:, of] + missing[:, of, None, :] if side else seen
        right = total[:, None, None, :] - left
        gain = value(left) + value(right) - parent
        fits = (left[..., 2] >= least) & (right[..., 2] >= least) & (left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN)
        gain = np.where(fits, gain, 0.0).reshape(slots, -1)
        top = gain.max(axis=1)
        at = (gain >= top[:, None] * (1 - SAME_GAIN)).argmax(axis=1)
        f, b = np.divmod(at, width - 1)
        for s in np.flatnonzero((top > LEAST_GAIN) & (top > best.gain * (1 + SAME_GAIN))):
            best.gain[s], best.feature[s], best.bin[s], best.missing_left[s] = gain[s, at[s]], of[f[s]], b[s], side
            best.left[s] = left[s, f[s], b[s]]
    for s in np.flatnonzero(best.gain > 0):
        if missing[s, best.feature[s], 2] == 0:
            best.missing_left[s] = 2 * best.left[s, 2] >= total[s, 2]
    return best


class Branch:
    """A tree while it grows: every split that pays, to the full depth."""

    def __init__(self, total: np.ndarray):
        self.feature, self.bin, self.missing_left, self.left, self.right, self.gain = [-1], [0], [False], [0], [0], [0.0]
        self.depth, self.sums = [0], [total]

    def split(self, at: int, splits: Splits, s: int) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[at], self.bin[at], self.missing_left[at] = int(splits.feature[s]), int(splits.bin[s]), bool(splits.missing_left[s])
        self.left[at], self.right[at], self.gain[at] = left, left + 1, float(splits.gain[s])
        for sums in (splits.left[s], splits.total[s] - splits.left[s]):
            self._leaf(self.depth[at] + 1, sums)
        return left, left + 1

    def _leaf(self, depth: int, sums: np.ndarray) -> None:
        for column, value in zip((self.feature, self.bin, self.missing_left, self.left, self.right, self.gain, self.depth, self.sums), (-1, 0, False, 0, 0, 0.0, depth, sums)):
            column.append(value)

    def graft(self, at: int, other: Branch) -> None:
        """Put a finished branch in the place of a leaf."""
        shift = len(self.feature) - 1  # node i of the other becomes i + shift, its root takes the leaf's place
        for i in range(len(other.feature)):
            target = at if i == 0 else i + shift
            if i == 0:
                self.sums[at] = other.sums[0]
            else:
                self._leaf(self.depth[at] + other.depth[i], other.sums[i])
            self.feature[target], self.bin[target], self.missing_left[target], self.gain[target] = other.feature[i], other.bin[i], other.missing_left[i], other.gain[i]
            self.left[target], self.right[target] = (other.left[i] + shift, other.right[i] + shift) if other.feature[i] >= 0 else (0, 0)

    def tree(self, parameters: BoostingParameters) -> Tree:
        """The splits in order of gain until the leaves are used up, as arrays in order of depth."""
        open_, chosen, leaves = [(-self.gain[0], 0)], set(), 1
        while open_ and leaves < parameters.leaves:
            gain, at = heapq.heappop(open_)
            if self.feature[at] < 0:
                continue
            chosen.add(at)
            leaves += 1
            for child in (self.left[at], self.right[at]):
                heapq.heappush(open_, (-self.gain[child], child))
        order, place = [0], {0: 0}
        for at in order:
            if at in chosen:
                for child in (self.left[at], self.right[at]):
                    place[child] = len(order)
                    order.append(child)
        sums = np.array([self.sums[i] for i in order])
        kept = np.array([i in chosen for i in order])
        pick = lambda column, kind, none: np.array([column[i] if i in chosen else none for i in order], kind)
        value = -parameters.learning_rate * sums[:, 0] / np.maximum(sums[:, 1] + parameters.ridge, 1e-300)
        children = [np.array([place[c[i]] if i in chosen else 0 for i in order], np.int64) for c in (self.left, self.right)]
        return Tree(pick(self.feature, np.int64, -1), pick(self.bin, np.int64, 0), pick(self.missing_left, bool, False), *children, np.where(kept, 0.0, value), sums[:, 2])

    def partial(self) -> Tree:
        arrays = [np.array(c) for c in (self.feature, self.bin, self.missing_left, self.left, self.right)]
        return Tree(*arrays, np.zeros(len(self.feature)), np.zeros(len(self.feature)))


def grow(branch: Branch, open_: list[int], count: Callable[[list[int]], np.ndarray], parameters: BoostingParameters, depth: int, most: int = 0) -> list[int]:
    """Split the open leaves level by level; ``count`` gives the histograms of some leaves. Leaves too small to split are
    left; once the open ones have at most so many rows together, they are returned as they are."""
    held: dict[int, np.ndarray] = {}
    while open_ and sum(branch.sums[at][2] for at in open_) > most:
        if not held:
            held.update(zip(open_, count(open_)))
        splits = best_splits(np.stack([held[at] for at in open_]), parameters)
        following: dict[int, np.ndarray] = {}
        children, pairs = [], []
        for s, at in enumerate(open_):
            branch.sums[at] = splits.total[s]
            if splits.gain[s] > 0:
                pair = branch.split(at, splits, s)
                # a child may split if it has rows for two leaves and depth left
                may = [c for c in pair if branch.depth[c] < depth and branch.sums[c][2] >= 2 * parameters.min_rows]
                children += may
                if may:
                    pairs.append((at, *sorted(pair, key=lambda c: (branch.sums[c][2], c))))
        if pairs and sum(branch.sums[c][2] for c in children) > most:
            for (at, small, large), sums in zip(pairs, count([small for _, small, _ in pairs])):
                following[small], following[large] = sums, held[at] - sums
        held, open_ = following, children
    return open_


def grown_in_task(x: np.ndarray, g: np.ndarray, h: np.ndarray, joint: Joint, parameters: BoostingParameters, depth: int) -> Branch:
    """The whole branch of a leaf whose rows are here."""
    branch = Branch(np.array([g.sum(), h.sum(), float(len(g))]))

    def count(leaves: list[int]) -> np.ndarray:
        total, place = joint.empty(len(leaves)), {at: s for s, at in enumerate(leaves)}
        found = [(place[at], rows) for at, rows in branch.partial().reached(x, joint.width - 1, leaves)]
        if found[0][1] is None:
            joint.add(total, x, g, h, found)
        else:
            rows = np.concatenate([rows for _, rows in found])
            joint.add(total, x, g.take(rows), h.take(rows), found)
        return joint.histograms(total, len(leaves))

    if depth > 0 and len(g) >= 2 * parameters.min_rows and len(x):
        grow(branch, [0], count, parameters, depth)
    return branch


# ---------------------------------------------------------------- blocks

def _thinned(values: np.ndarray, counts: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with the rows up to each since the one before: all of them, or as many as the points, evenly
    spread over the rows. The rows up to a value that is kept stay exact."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(counts[order])
    last = np.append(values[1:] != values[:-1], True)[:len(values)]
    values, upto = values[last], upto[last]
    if len(values) > points:
        kept = np.unique(np.searchsorted(upto, np.ceil(np.arange(1, points + 1) / points * upto[-1]), "left"))
        values, upto = values[kept], upto[kept]
    return values, np.diff(upto, prepend=0.0)


def fit_bins(rows: DataFrame, features: list[str], bins: int) -> Bins:
    """Quantiles of every feature; few distinct values are bins of their own.

    Tasks sort some rows at a time and keep evenly spread values of them; these are joined for each feature in groups of
    tasks, then over the groups. Each of the three steps moves a rank by less than one in ``SKETCH_POINTS`` x bins rows; with no more
    distinct values the quantiles are exact."""
    points = SKETCH_POINTS * bins

    def packed(number: list, values: list, counts: list, group: int) -> pa.RecordBatch:
        columns = [pa.array(number, pa.int32()), pa.array([group] * len(number), pa.int32()), *[pa.array([a.tobytes() for a in x], pa.binary()) for x in (values, counts)]]
        return pa.RecordBatch.from_arrays(columns, ["feature", "part", "v", "n"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, group = [], 0, TaskContext.get().partitionId() % SKETCH_POINTS

        def sketch() -> pa.RecordBatch:
            found = []
            for k in range(len(features)):
                v = np.concatenate([b.column(k).to_numpy(zero_copy_only=False).astype(float) for b in held])
                v = np.sort(v[~np.isnan(v)])
                at = np.flatnonzero(np.append(v[1:] != v[:-1], True)[:len(v)])
                found.append(_thinned(v[at], np.diff(at, prepend=-1).astype(float), points))
            return packed(list(range(len(features))), *zip(*found), group)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SKETCH_ROWS:
                yield sketch()
                held, size = [], 0
        if size:
            yield sketch()

    def joined(table: pa.Table) -> pa.Table:
        values, counts = (np.concatenate([np.frombuffer(a.as_buffer()) for a in table.column(c)]) for c in ("v", "n"))
        made = packed([table.column("feature")[0].as_py()], *zip(_thinned(values, counts, points)), table.column("part")[0].as_py())
        return pa.Table.from_batches([made])

    if not features:
        return Bins([], [])
    schema = "feature int, part int, v binary, n binary"
    found = rows.select(*features).mapInArrow(sketched, schema).groupBy("feature", "part").applyInArrow(joined, schema).groupBy("feature").applyInArrow(joined, schema)
    thresholds = [np.zeros(0)] * len(features)
    for r in found.select("feature", "v", "n").collect():  # a row per feature, of at most as many values as the points
        values, upto = np.frombuffer(r["v"]), np.cumsum(np.frombuffer(r["n"]))
        if len(values):
            ranks = np.ceil(np.arange(1, bins) / bins * upto[-1])
            thresholds[r["feature"]] = np.unique(values[np.searchsorted(upto, ranks, "left")])
    return Bins(list(features), thresholds)


def blocks(rows: DataFrame, bins: Bins, start: float) -> DataFrame:
    """Blocks of bin numbers, labels, weights and scores. ``rows`` has the features, then ``__y`` and ``__w``."""
    n = len(bins.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            x, y, w = (np.concatenate(p, axis=-1) for p in zip(*held))
            data = [x.tobytes(), y.tobytes(), w.tobytes(), np.full(len(y), start).tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(y)], pa.int32()), *[pa.array([d], pa.binary()) for d in data]],
                ["block", "rows", "x", "y", "w", "score"],
            )

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = [c[at:at + BLOCK_ROWS] for c in columns]
                held.append((bins.codes(part[:n]) if n else np.zeros((0, len(part[-1])), np.uint8), part[n], part[n + 1]))
                size += len(part[-1])
                if size >= BLOCK_ROWS:
                    yield block()
                    number, held, size = number + 1, [], 0
        if size:
            yield block()

    return rows.mapInArrow(run, _BLOCK)


def _opened(batch: pa.RecordBatch, features: int) -> Iterator[tuple]:
    for block, rows, x, y, w, score in zip(*batch.columns):
        n = rows.as_py()
        yield block.as_py(), np.frombuffer(x.as_buffer(), np.uint8).reshape(features, n), *(np.frombuffer(c.as_buffer()) for c in (y, w, score))


def _gradients(y, w, score) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
    return w * (p - y), w * p * (1 - p)


def _held(data: DataFrame, bins: Bins) -> RDD:
    """The blocks as arrays that stay with the executors while trees are grown on them: the jobs on them are many and
    short, and need no plan. They are kept as the bytes that a task gets, labels and weights as bytes where those hold them."""
    features = len(bins.features)

    def tight(a: np.ndarray) -> np.ndarray:
        small = np.clip(np.nan_to_num(a), 0, 255).astype(np.uint8)
        return small if (small == a).all() else a

    def opened(row) -> tuple:
        y, w, score = (np.frombuffer(row[c]) for c in ("y", "w", "score"))
        return row["block"], np.frombuffer(row["x"], np.uint8).reshape(features, row["rows"]), tight(y), tight(w), score

    return data.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK_DESER)


def _moved(held: RDD, bins: Bins, tree: Tree) -> RDD:
    """The held blocks with one more tree in their scores."""
    missing = bins.missing
    return held.map(lambda b: (*b[:4], tree.moved(b[1], missing, b[4]))).persist(StorageLevel.MEMORY_AND_DISK_DESER)


def _added(parts) -> np.ndarray:
    """The same sum whatever order the (task, sums) arrive in."""
    ordered = [sums for _, sums in sorted(parts, key=lambda p: p[0])]
    return sum(ordered[1:], ordered[0])


def _summed(held: RDD, bins: Bins, joint: Joint, partial: Tree, leaves: list[int]) -> np.ndarray:
    """The histograms of some leaves, summed over the tasks: by Spark, where they are many or large."""
    features, width, missing = len(bins.features), joint.width, bins.missing
    place = {at: s for s, at in enumerate(leaves)}
    filled = np.array([[b < size - 1 or b == missing for b in range(width)] for size in joint.sizes])  # bins that a value can have

    def count(task: int, blocks: Iterator[tuple]) -> Iterator[tuple]:
        total = joint.empty(len(leaves))
        for _, x, y, w, score in blocks:
            found = [(place[at], rows) for at, rows in partial.reached(x, missing, leaves)]
            if found[0][1] is not None:
                rows = np.concatenate([rows for _, rows in found])
                y, w, score = y.take(rows), w.take(rows), score.take(rows)
            joint.add(total, x, *_gradients(y, w, score), found)
        sums = joint.histograms(total, len(leaves))
        for s in np.flatnonzero(sums[:, 0, :, 2].any(axis=1)):
            yield int(s), (task, sums[s][filled])

    parts, tasks = held.mapPartitionsWithIndex(count), held.getNumPartitions()
    if tasks > COLLECTED_TASKS or tasks * len(leaves) * int(filled.sum()) * 24 > COLLECTED_BYTES:
        found = parts.groupByKey(len(leaves)).mapValues(_added).collect()
    else:
        by_slot: dict[int, list] = {}
        for s, part in parts.collect():  # histograms, as many as leaves and tasks
            by_slot.setdefault(s, []).append(part)
        found = [(s, _added(found)) for s, found in by_slot.items()]
    out = np.zeros((len(leaves), features, width, 3))
    for s, sums in found:
        out[s][filled] = sums
    return out


def _finished(held: RDD, bins: Bins, joint: Joint, branch: Branch, leaves: list[int], parameters: BoostingParameters) -> None:
    """Send the rows of each leaf to one task, which grows its branch, and graft the branches."""
    missing, partial = bins.missing, branch.partial()
    place = {at: s for s, at in enumerate(leaves)}
    left = [parameters.depth - branch.depth[at] for at in leaves]

    def send(part: tuple) -> Iterator[tuple]:
        block, x, y, w, score = part
        for at, rows in partial.reached(x, missing, leaves):
            if rows is None:
                yield place[at], (block, x, *_gradients(y, w, score))
            elif len(rows):
                yield place[at], (block, x.take(rows, axis=1), *_gradients(y.take(rows), w.take(rows), score.take(rows)))

    def finish(leaf: tuple) -> tuple[int, Branch]:
        s, parts = leaf[0], sorted(leaf[1], key=lambda p: p[0])
        return s, grown_in_task(*(np.concatenate(p, axis=-1) for p in list(zip(*parts))[1:]), joint, parameters, left[s])

    for s, made in sorted(held.flatMap(send).groupByKey(len(leaves)).map(finish).collect(), key=lambda m: m[0]):
        branch.graft(leaves[s], made)


def _advanced(data: DataFrame, bins: Bins, recent: list[Tree]) -> DataFrame:
    """The blocks with the recent trees added to their scores."""
    features, missing = len(bins.features), bins.missing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for _, x, _, _, score in _opened(batch, features):
                for tree in recent:
                    score = tree.moved(x, missing, score)
                scores.append(score.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.binary())], batch.schema.names)

    return data.mapInArrow(run, _BLOCK)


def _held_auc(data: DataFrame, bins: Bins, recent: list[Tree]) -> list[float]:
    """The AUC of the rows after each of the recent trees; none where a label is missing.

    Probabilities are counted in ``AUC_BINS`` bins, whose rows count as ties: fine enough to choose a tree by, and what is
    shuffled does not grow with the rows."""
    features, missing = len(bins.features), bins.missing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, len(recent), AUC_BINS))
        for batch in batches:
            for _, x, y, w, score in _opened(batch, features):
                for k, tree in enumerate(recent):
                    score = tree.moved(x, missing, score)
                    at = np.minimum((AUC_BINS / (1 + np.exp(-np.clip(score, -50, 50)))).astype(np.int64), AUC_BINS - 1)
                    for label in (0, 1):
                        held[label, k] += np.bincount(at, y == label, AUC_BINS)
        tree, at = np.nonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree, pa.int64()), pa.array(at, pa.int64()), *[pa.array(held[label][tree, at]) for label in (0, 1)]], ["tree", "bin", "good", "bad"]
        )

    counts = data.mapInArrow(count, "tree long, bin long, good double, bad double").groupBy("tree", "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    below = Window.partitionBy("tree").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most AUC_BINS rows
    won = counts.withColumn("won", F.col("bad") * (F.coalesce(F.sum("good").over(below), F.lit(0)) + F.col("good") / 2))
    auc = won.groupBy("tree").agg(F.try_divide(F.sum("won"), F.sum("good") * F.sum("bad")).alias("auc")).where("auc is not null").orderBy("tree")
    return [r["auc"] for r in auc.collect()]  # one row per tree


# ---------------------------------------------------------------- training

def _written(data: DataFrame, old: str | None) -> tuple[DataFrame, str]:
    """The blocks on disk, in the place of an earlier version of them."""
    spark, path = data.sparkSession, scratch_path(data.sparkSession, "boosting")
    data.write.mode("overwrite").parquet(path)
    if old:
        remove_directory(spark, old)
    return spark.read.schema(data.schema).parquet(path), path


def block_tasks(rows: int, cores: int) -> int:
    """So few rows that one task finishes their trees are read by one task; more are dealt out evenly, so that no core waits
    for a last task."""
    return 1 if rows <= IN_TASK_ROWS else cores * max(1, -(-rows // (cores * BLOCKS_PER_TASK * BLOCK_ROWS)))


def _dealt(data: DataFrame, rows: int) -> DataFrame:
    return data.repartition(block_tasks(rows, data.sparkSession.sparkContext.defaultParallelism))


def _next_tree(held: RDD, bins: Bins, joint: Joint, rows: int, parameters: BoostingParameters) -> Tree:
    branch, most = Branch(np.array([0.0, 0.0, float(rows)])), min(IN_TASK_ROWS, IN_TASK_CELLS // max(1, len(bins.features)))
    open_ = [0] if rows >= 2 * parameters.min_rows and bins.features else []
    rest = grow(branch, open_, lambda leaves: _summed(held, bins, joint, branch.partial(), leaves), parameters, parameters.depth, most)
    if rest:
        _finished(held, bins, joint, branch, rest, parameters)
    return branch.tree(parameters)


def boost(rows: DataFrame, features: list[str], label: str, held_out: str = "held_out", parameters: BoostingParameters | None = None, weight: str | None = None) -> Boosted:
    """Fit on the rows outside the carve-out, keep the trees up to the best held-out AUC.

    Rows without a label are left out; a missing weight is 1. A held-out set without both labels keeps all trees. No
    rows to fit, or one label among them, give single leaves at the clipped log-odds.
    """
    parameters = parameters or BoostingParameters(1000, 6, 0.05, 20)
    if len(features) * 2 ** (parameters.depth - 1) * (parameters.bins + 1) * 24 > HISTOGRAM_BYTES:
        raise ValueError("histograms of one level would take more than 2 GB: fewer features, bins or levels")
    inputs = rows.where(F.col(label).isNotNull()).select(
        *[clean(F.col(f)).alias(f"f{k}") for k, f in enumerate(features)], F.col(label).cast("double").alias("__y"),
        (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("__w"), F.coalesce(F.col(held_out), F.lit(False)).alias("__held"),
    )
    # read several times, and as a rule the carve-out of a caller
    stored = scratch_path(rows.sparkSession, "boosting-rows")
    inputs.write.mode("overwrite").parquet(stored)
    inputs = rows.sparkSession.read.schema(inputs.schema).parquet(stored)
    fitting, judging = inputs.where("not __held").drop("__held"), inputs.where("__held").drop("__held")
    bins = fit_bins(fitting, [f"f{k}" for k in range(len(features))], parameters.bins)
    bins = Bins(list(features), bins.thresholds)
    used = ~F.col("__held")
    sums = inputs.agg(
        F.sum(F.when(used, F.col("__w") * F.col("__y"))).alias("y"), F.sum(F.when(used, F.col("__w"))).alias("w"),
        F.count_if(used).alias("n"), F.count_if("__held").alias("held"),
    ).first()
    share = min(max((sums["y"] or 0.0) / sums["w"], 1e-6), 1 - 1e-6) if sums["w"] else 0.5
    start = math.log(share / (1 - share))
    data, path = _written(blocks(fitting, bins, start), None)
    judge, judge_path = _written(blocks(judging, bins, start), None)
    remove_directory(rows.sparkSession, stored)
    joint = Joint.of(bins)
    grown: list[Tree] = []
    recent: list[Tree] = []
    auc: list[float] = []
    held, older = _held(_dealt(data, sums["n"]), bins), None
    while True:
        tree = _next_tree(held, bins, joint, sums["n"], parameters)
        if older is not None:
            older.unpersist()  # the jobs of this tree have built what follows from it
            older = None
        stuck = len(tree.feature) == 1  # no leaf pays for a split, and none will later
        if not stuck or not grown:
            recent.append(tree)
            grown.append(tree)
        last = stuck or len(grown) == parameters.trees
        if not last and len(recent) < WINDOW:
            older, held = held, _moved(held, bins, tree)
            continue
        held.unpersist()
        if recent:
            auc += _held_auc(_dealt(judge, sums["held"]), bins, recent)
        if last or auc and len(auc) - int(np.argmax(auc)) > parameters.patience:
            break
        data, path = _written(_advanced(data, bins, recent), path)
        judge, judge_path = _written(_advanced(judge, bins, recent), judge_path)
        held, recent = _held(_dealt(data, sums["n"]), bins), []
    remove_directory(rows.sparkSession, path)
    remove_directory(rows.sparkSession, judge_path)
    # the start is part of the first tree, so that the node table is the whole model
    first = grown[0]
    grown[0] = Tree(first.feature, first.bin, first.missing_left, first.left, first.right, np.where(first.feature < 0, first.value + start, 0.0), first.cover)
    return Boosted(bins, grown, int(np.argmax(auc)) + 1 if auc else len(grown), auc)
