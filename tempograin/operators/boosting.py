"""Boosted trees of all folds and classes grown in the same passes over the rows.

Every (variant, seed, fold, class) is a model. Features are cut into bins once. A pass adds up, for
the nodes that each model needs next, gradients, Hessians and rows per feature and bin: in the
tasks first, then by node and feature in a shuffle. Only these sums, whose size depends on models,
leaves, features and bins but not on the rows, reach the driver, which picks the splits. Models do
not wait for each other: one may grow its fortieth tree while another grows its thirtieth. Of two
sibling nodes only the smaller is summed, the other is the difference to their parent. The rows of
a node that has no more than NODE_ROWS of them meet in one task, which grows all that is below.

Rows with equal bins get equal scores, so they are one kind of row, with its count per cell and class.
Where there are no more than NODE_ROWS kinds, however many rows, a cell's kinds meet in one task, which
grows all its trees: no passes, and the kinds' scores are joined to the rows at the end.

Gradients and Hessians are whole multiples of 2^-28, so sums are exact in any order: a task that
runs again, or another number of partitions, gives the same trees.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin import session
from tempograin.operators import newton
from tempograin.operators.ordered import RunningSum, cut

# Rounds, rate, leaves, rows a leaf, bins and the least Hessian of a leaf.
ROUNDS = 100
RATE = 0.1
LEAVES = 31
LEAF_ROWS = 20
BINS = 255
LEAF_HESSIAN = 1e-3

MISSING = 255  # in the place of a bin
UNIT = float(2 ** 28)
WIDTH = 256 * 3  # sums of a node and feature: gradient, Hessian, rows per bin
KEEP = 5  # rounds after which the rows' scores are written again
TASK_ROWS = 2048  # fewer rows are not worth a task
NODE_ROWS = 262144  # rows of a node that one task may hold, at 8 bytes and one a feature; above it a node is summed in passes
REDUCE_BYTES = 64 * 1024 * 1024  # sums that one task of the shuffle adds up


@dataclass
class Tree:
    """Nodes in arrays, root first; a leaf's children are itself."""

    feature: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def place(self, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            node = np.where(bins[rows, self.feature[node]] <= self.at[node], self.left[node], self.right[node])
        return node


def best_split(sums: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, last bin of the left side) of a node's sums (feature, bin, 3); the first of equals."""
    run = sums.cumsum(axis=1)
    total, left = run[0, -1], run[:, :-1]
    right = total - left
    gl, hl, gr, hr = left[..., 0] / UNIT, left[..., 1] / UNIT, right[..., 0] / UNIT, right[..., 1] / UNIT
    allowed = (left[..., 2] >= LEAF_ROWS) & (right[..., 2] >= LEAF_ROWS) & (hl >= LEAF_HESSIAN) & (hr >= LEAF_HESSIAN)
    if not allowed.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, gl * gl / hl + gr * gr / hr, -np.inf)
    best = int(gain.argmax())
    gained = float(gain.flat[best] - (total[0] / UNIT) ** 2 / (total[1] / UNIT))
    return (gained, *divmod(best, gain.shape[1])) if gained > 1e-10 else None


class Growing:
    """One tree in growth. Node 1 is the root, the children of node i are 2i and 2i + 1."""

    def __init__(self, leaves: int | None = None):
        self.leaves = leaves or LEAVES
        self.sums: dict[int, np.ndarray] = {}
        self.split: dict[int, tuple[float, int, int] | None] = {}
        self.total: dict[int, tuple[int, int, int]] = {}  # gradient, Hessian, rows

    def learn(self, node: int, sums: np.ndarray) -> None:
        """Take the sums of a node and work out its sibling's."""
        self.sums[node] = sums
        if node > 1:
            self.sums[node ^ 1] = self.sums[node // 2] - sums
        for n in ((node,) if node == 1 else (node, node ^ 1)):
            self.split[n] = best_split(self.sums[n])
            self.total[n] = tuple(int(v) for v in self.sums[n][0].sum(axis=0))

    def attach(self, node: int, below: list[tuple]) -> None:
        """Take what a task found at and below a node: (node counted from there, gain, feature, bin, sums)."""
        for place, gain, feature, at, *total in below:
            depth = place.bit_length() - 1
            n = (node << depth) | (place - (1 << depth))
            self.split[n] = (gain, feature, at) if at >= 0 else None
            self.total[n] = tuple(total)

    def advance(self) -> tuple[list[int] | None, list[int]]:
        """The splits of the finished tree, or None and the nodes that must be opened to go on.

        Leaves are split in the order of their gains. All those which may still be among the
        splits are opened together, so that a tree takes about as many passes as it has levels.
        """
        if 1 not in self.split:
            return None, [0]
        heap = [(-self.split[1][0], 1)] if self.split[1] else []
        done: list[int] = []
        while heap and len(done) < self.leaves - 1:
            node = heap[0][1]
            if 2 * node not in self.split:
                return None, [n for _, n in heapq.nsmallest(self.leaves - 1 - len(done), heap) if 2 * n not in self.split]
            heapq.heappop(heap)
            done.append(node)
            for child in (2 * node, 2 * node + 1):
                if self.split[child]:
                    heapq.heappush(heap, (-self.split[child][0], child))
        return done, []

    def asked(self, node: int) -> int:
        """The smaller child of a node that is opened; the root itself for 0."""
        if node == 0:
            return 1
        _, feature, at = self.split[node]
        rows = self.sums[node][feature, :, 2]
        return 2 * node + int(rows[:at + 1].sum() > rows[at + 1:].sum())

    def tree(self, splits: set[int]) -> tuple[Tree, dict[int, int]]:
        """The tree with these splits, and the place of each node in it."""
        order = [1]
        for node in order:
            if node in splits:
                order += [2 * node, 2 * node + 1]
        at = {node: i for i, node in enumerate(order)}
        feature, cut, value = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros(len(order))
        left = np.arange(len(order))
        right = left.copy()
        for node, i in at.items():
            if node in splits:
                _, feature[i], cut[i] = self.split[node]
                left[i], right[i] = at[2 * node], at[2 * node + 1]
            elif node in self.total:
                g, h, _ = self.total[node]
                value[i] = -RATE * (g / UNIT) / max(h / UNIT, 1e-12)
        return Tree(feature, cut, left, right, value, max(order).bit_length() - 1), at


def _halves(weights: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole numbers as (part, factor) such that any sum of a part is exact in doubles."""
    if float(np.abs(weights).sum(dtype=np.float64)) < 2.0 ** 52:
        return [(weights.astype(np.float64), 1)]
    high = weights >> 26
    return [(high.astype(np.float64), 1 << 26), ((weights - (high << 26)).astype(np.float64), 1)]


def grow_here(columns: list[np.ndarray], g: np.ndarray, h: np.ndarray, n: np.ndarray,
              leaves: int | None = None) -> tuple[Growing, list[int], dict[int, np.ndarray]]:
    """The tree of some rows in memory, from the same sums and in the same order as in passes: (tree, its splits, rows of every node).

    ``columns`` has the bins of each feature as whole numbers, ``g``, ``h`` and ``n`` are each row's sums.
    """
    parts = [_halves(w) for w in (g, h, n)]
    size = max(int(column.max()) for column in columns) + 1  # the bins above are empty and end no left side

    def sums(rows: np.ndarray) -> np.ndarray:
        own = [[(w[rows], factor) for w, factor in part] for part in parts]
        out = np.zeros((len(columns), size, 3), np.int64)
        for f, column in enumerate(columns):
            bins = column[rows]
            for i, part in enumerate(own):
                for w, factor in part:
                    out[f, :, i] += np.bincount(bins, w, size).astype(np.int64) * factor
        return out
    out, rows = Growing(leaves), {1: np.arange(len(g))}
    out.learn(1, sums(rows[1]))
    while True:
        done, needed = out.advance()
        if done is not None:
            return out, done, rows
        node = needed[0]
        _, feature, cut = out.split[node]
        low = columns[feature][rows[node]] <= cut
        rows[2 * node], rows[2 * node + 1] = rows[node][low], rows[node][~low]
        child = out.asked(node)
        out.learn(child, sums(rows[child]))


@dataclass
class Boost:
    """What the tasks need: each cell's preparation, first scores and the trees not yet in the rows' scores."""

    study: newton.Study
    classes: int  # scores of a cell: one for two classes, else one a class
    edges: list[np.ndarray]
    base: np.ndarray  # (cell, score)
    recent: dict[tuple[int, int], list[Tree]] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return len(self.edges) + len(self.study.levels)

    def middle(self) -> np.ndarray:
        """(cell, numeric feature): the bin of the median of the training rows."""
        return np.array([[np.searchsorted(e, m) for e, m in zip(self.edges, row)] for row in self.study.median]).reshape(len(self.study.cells), len(self.edges))

    def scores(self, cell: int, bins: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """The scores of some rows with all trees so far."""
        out = raw.copy()
        for k in range(self.classes):
            for tree in self.recent.get((cell, k), ()):
                out[:, k] += tree.value[tree.place(bins)]
        return out


def _fixed(batch: pa.RecordBatch, name: str, kind, width: int) -> np.ndarray:
    """A binary column whose values all have the same length, as a matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    if not width or not len(column):
        return np.zeros((len(column), width), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


class Rows:
    """A batch of the stored rows."""

    def __init__(self, batch: pa.RecordBatch, boost: Boost, middle: np.ndarray):
        cells = len(boost.study.cells)
        self.batch, self.middle = batch, middle
        self.bins = _fixed(batch, "_bins", np.uint8, boost.width)
        self.role = _fixed(batch, "_role", np.int8, cells)
        if "_raw" in batch.schema.names:
            self.raw = _fixed(batch, "_raw", np.float64, cells * boost.classes).reshape(-1, cells, boost.classes)
        else:
            self.raw = np.broadcast_to(boost.base, (batch.num_rows, *boost.base.shape))
        self.y = batch.column(batch.schema.get_field_index("_y")).to_numpy().astype(np.int64)
        self.gaps = [f for f in range(middle.shape[1]) if (self.bins[:, f] == MISSING).any()]

    def of(self, cell: int, chosen: np.ndarray) -> np.ndarray:
        """The bins of the chosen rows, missing numbers at the cell's median."""
        out = self.bins[chosen]
        for f in self.gaps:
            out[out[:, f] == MISSING, f] = self.middle[cell, f]
        return out


def _bin_edges(data: DataFrame, numeric: list[str]) -> list[np.ndarray]:
    """The last value of every bin but the highest: each value its own bin if there are few, else quantiles."""
    values = data.select(F.posexplode("_x").alias("feature", "value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = session.durable(values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    kinds = {r["feature"]: r["kinds"] for r in counted.groupBy("feature").agg(F.count(F.lit(1)).alias("kinds")).collect()}
    few, many = [f for f, k in kinds.items() if k <= BINS], [f for f, k in kinds.items() if k > BINS]
    found: dict[int, list[float]] = {f: [] for f in range(len(numeric))}
    for r in counted.filter(F.col("feature").isin(few)).collect():  # at most BINS values a feature
        found[r["feature"]].append(r["value"])
    edges = [np.array(sorted(found[f]))[:-1] for f in range(len(numeric))]
    if many:
        some = counted.filter(F.col("feature").isin(many))
        total = some.groupBy("feature").agg(F.sum("n").alias("total"))
        run = cut(some, ["feature"], ["value"]).add(_to=RunningSum(F.col("n"))).rows().join(total, "feature")
        bins = run.groupBy("feature", F.ceil(F.col("_to") * BINS / F.col("total")).alias("bin")).agg(F.max("value").alias("last"))
        for r in bins.orderBy("feature", "bin").collect():
            found[r["feature"]].append(r["last"])
        for f in many:
            edges[f] = np.array(found[f])[:-1]
    return edges


def _store(data: DataFrame, boost: Boost, kind: str) -> DataFrame:
    """The rows with their bins and roles as bytes, written once."""
    study, edges = boost.study, boost.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in newton._slices(batches, study):
            bins = np.empty((len(rows.y), boost.width), np.uint8)
            for f, edge in enumerate(edges):
                bins[:, f] = np.where(np.isnan(rows.x[:, f]), MISSING, np.searchsorted(edge, rows.x[:, f]))
            bins[:, len(edges):] = rows.hot
            yield pa.RecordBatch.from_arrays(
                [rows.batch.column(rows.batch.schema.get_field_index("_row")), pa.array(rows.y), _binary(bins), _binary(rows.role.astype(np.int8))],
                names=["_row", "_y", "_bins", "_role"])
    return session.durable(data.mapInArrow(run, f"_row {kind}, _y double, _bins binary, _role binary"))


def _counts(data: DataFrame, study: newton.Study, classes: int) -> np.ndarray:
    """(cell, class): training rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(study.cells), classes), np.int64)
        for rows in newton._slices(batches, study):
            for cell in range(len(study.cells)):
                total[cell] += np.bincount(rows.y[rows.role[:, cell] == 1].astype(np.int64), minlength=classes)
        cell, label = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(label), pa.array(total[cell, label])], names=["cell", "label", "n"])
    out = np.zeros((len(study.cells), classes), np.int64)
    for r in data.mapInArrow(run, "cell long, label long, n long").groupBy("cell", "label").agg(F.sum("n").alias("n")).collect():
        out[r["cell"], r["label"]] = r["n"]
    return out


def gradients(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, score): gradients and Hessians of the log loss in whole multiples of 1 / UNIT."""
    if raw.shape[1] == 1:
        p = newton._logistic(raw)
        target = y[:, None]
    else:
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        target = y[:, None] == np.arange(raw.shape[1])
    return np.rint((p - target) * UNIT), np.rint(p * (1 - p) * UNIT)


def _sums(data: DataFrame, boost: Boost, growing: dict[tuple[int, int], tuple[Tree, dict[int, int]]], partitions: int) -> np.ndarray:
    """(request, feature, bin, 3) for every request: ``growing`` gives each model's tree and the requests at its nodes."""
    width, middle = boost.width, boost.middle()
    n = sum(len(asked) for _, asked in growing.values())
    by_cell: dict[int, list[int]] = {}
    for cell, k in growing:
        by_cell.setdefault(cell, []).append(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width, WIDTH), np.int64)
        offsets = np.arange(width) * 256
        for batch in batches:
            rows = Rows(batch, boost, middle)
            for cell, classes in by_cell.items():
                chosen = np.flatnonzero(rows.role[:, cell] == 1)
                if not len(chosen):
                    continue
                bins = rows.of(cell, chosen)
                g, h = gradients(boost.scores(cell, bins, rows.raw[chosen, cell]), rows.y[chosen])
                for k in classes:
                    tree, asked = growing[cell, k]
                    slots = np.full(len(tree.feature), -1)
                    first = min(asked.values())
                    for place, request in asked.items():
                        slots[place] = request - first
                    slot = slots[tree.place(bins)]
                    used = np.flatnonzero(slot >= 0)
                    at = (slot[used][:, None] * (width * 256) + offsets + bins[used]).ravel()
                    size = len(asked) * width * 256
                    for i, weight in enumerate((g[used, k], h[used, k], None)):
                        got = np.bincount(at, None if weight is None else np.repeat(weight, width), size)
                        total[first:first + len(asked), :, i::3] += got.astype(np.int64).reshape(len(asked), width, 256)
        for request in range(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width) + request * width), _binary(total[request])], names=["place", "sums"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, sums in zip(batch.column(0).to_pylist(), _fixed(batch, "sums", np.int64, WIDTH)):
                total[place] = total[place] + sums if place in total else sums
        for place, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([place]), _binary(sums[None])], names=["place", "sums"])
    schema = "place long, sums binary"
    reducers = min(partitions, math.ceil(n * width * WIDTH * 8 / REDUCE_BYTES))
    found = data.mapInArrow(add, schema).repartition(max(1, reducers), "place").mapInArrow(combine, schema).toArrow()
    out = np.zeros((n * width, WIDTH), np.int64)
    for place, sums in zip(found["place"].to_pylist(), found["sums"].to_pylist()):
        out[place] = np.frombuffer(sums, np.int64)
    return out.reshape(n, width, 256, 3)


def _below(data: DataFrame, boost: Boost, growing: dict[tuple[int, int], tuple[Tree, dict[int, int]]], n: int, partitions: int) -> dict[int, list[tuple]]:
    """What :meth:`Growing.attach` takes for every request, whose node's rows are few and meet in one task."""
    middle, width = boost.middle(), boost.width
    by_cell: dict[int, list[int]] = {}
    for cell, k in growing:
        by_cell.setdefault(cell, []).append(k)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = Rows(batch, boost, middle), []
            for cell, classes in by_cell.items():
                chosen = np.flatnonzero(rows.role[:, cell] == 1)
                bins = rows.of(cell, chosen)
                g, h = gradients(boost.scores(cell, bins, rows.raw[chosen, cell]), rows.y[chosen])
                for k in classes:
                    tree, asked = growing[cell, k]
                    place = tree.place(bins)
                    for node, request in asked.items():
                        at = place == node
                        # Both are whole and below 2^29.
                        out.append((request, bins[at].tobytes(), g[at, k].astype(np.int32).tobytes(), h[at, k].astype(np.int32).tobytes()))
            request, *parts = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(request, pa.int64()), *[pa.array(v, pa.binary()) for v in parts]], names=["request", "bins", "g", "h"])

    def grow(table: pa.Table) -> pa.Table:
        part = {c: np.frombuffer(b"".join(table[c].to_pylist()), np.uint8 if c == "bins" else np.int32).astype(np.int64) for c in ("bins", "g", "h")}
        tree, _, _ = grow_here(list(part["bins"].reshape(-1, width).T.copy()), part["g"], part["h"], np.ones(len(part["g"]), np.int64))
        found = [(table["request"][0].as_py(), node, *(split or (0.0, 0, -1)), *tree.total[node]) for node, split in tree.split.items()]
        return pa.table([pa.array(v) for v in zip(*found)], names=["request", "node", "gain", "feature", "at", "g", "h", "n"])
    sent = data.mapInArrow(send, "request long, bins binary, g binary, h binary").repartition(min(n, 2 * partitions), "request")
    found = sent.groupBy("request").applyInArrow(grow, "request long, node long, gain double, feature long, at long, g long, h long, n long").toArrow()
    out: dict[int, list[tuple]] = {}
    for request, *rest in zip(*[c.to_pylist() for c in found.columns]):
        out.setdefault(request, []).append(tuple(rest))
    return out


def _absorb(data: DataFrame, boost: Boost, kind: str) -> DataFrame:
    """The rows with the recent trees in their scores, written to the shared folder."""
    middle = boost.middle()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(batch, boost, middle)
            raw = rows.raw.copy()
            for cell in range(raw.shape[1]):
                chosen = np.flatnonzero(rows.role[:, cell] > 0)
                raw[chosen, cell] = boost.scores(cell, rows.of(cell, chosen), raw[chosen, cell])
            names = ["_row", "_y", "_bins", "_role"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], _binary(raw.reshape(len(raw), -1))], names=[*names, "_raw"])
    return session.durable(data.mapInArrow(run, f"_row {kind}, _y double, _bins binary, _role binary, _raw binary"))


def _kinds(stored: DataFrame, study: newton.Study) -> DataFrame:
    """(bins, label, training rows in each cell): rows with equal bins and label counted together, written once."""
    trains = [F.count_if(F.substring("_role", cell + 1, 1) == F.lit(b"\x01")).alias(f"_n{cell}") for cell in range(len(study.cells))]
    counted = stored.groupBy("_bins", F.col("_y").cast("int").alias("_y")).agg(*trains)
    return session.durable(counted.select("_bins", "_y", F.array(*[f"_n{cell}" for cell in range(len(study.cells))]).alias("_n")))


def grow_all(bins: np.ndarray, n: np.ndarray, base: np.ndarray, rounds: int, leaves: int) -> np.ndarray:
    """(kind, score) after all rounds of one cell, from the bins of each kind of row and its training rows (kind, class)."""
    columns = list(bins.T.astype(np.int64))
    raw = np.tile(base, (len(bins), 1))
    every = n.sum(axis=1)
    for _ in range(rounds):
        g, h = np.zeros(raw.shape, np.int64), np.zeros(raw.shape, np.int64)
        for label in np.flatnonzero(n.any(axis=0)):
            own = gradients(raw, np.full(len(raw), label))
            g += own[0].astype(np.int64) * n[:, label, None]
            h += own[1].astype(np.int64) * n[:, label, None]
        for k in range(raw.shape[1]):
            tree, splits, rows = grow_here(columns, g[:, k], h[:, k], every, leaves)
            flat, at = tree.tree(set(splits))
            for node, place in at.items():
                if flat.left[place] == place:
                    raw[rows[node], k] += flat.value[place]
    return raw


def _grown(stored: DataFrame, kinds: DataFrame, boost: Boost) -> DataFrame:
    """The rows with their final scores: the kinds of every cell meet in one task, which grows all the cell's trees."""
    study, middle, width, base, rounds = boost.study, boost.middle(), boost.width, boost.base, ROUNDS
    leaves = LEAVES

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = b"".join(batch.column(batch.schema.get_field_index("_bins")).to_pylist())
            y = batch.column(batch.schema.get_field_index("_y")).to_numpy().astype(np.int32).tobytes()
            n = batch.column(batch.schema.get_field_index("_n")).flatten().to_numpy().reshape(-1, len(study.cells))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(study.cells), dtype=np.int32)), *[pa.array([v] * len(study.cells), pa.binary()) for v in (bins, y)],
                pa.array([n[:, cell].tobytes() for cell in range(len(study.cells))], pa.binary())], names=["cell", "bins", "y", "n"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[list[bytes]]] = {}
        for batch in batches:
            for cell, *parts in zip(*[c.to_pylist() for c in batch.columns]):
                for known, part in zip(got.setdefault(cell, [[], [], []]), parts):
                    known.append(part)
        for cell, (bins, y, n) in got.items():
            # The order does not matter: sums are whole numbers.
            kind, place = np.unique(np.frombuffer(b"".join(bins), f"V{width}"), return_inverse=True)
            counts = np.zeros((len(kind), max(2, boost.classes)), np.int64)
            np.add.at(counts, (place, np.frombuffer(b"".join(y), np.int32)), np.frombuffer(b"".join(n), np.int64))
            filled = np.frombuffer(kind.tobytes(), np.uint8).reshape(len(kind), width).copy()
            for f in range(middle.shape[1]):
                filled[filled[:, f] == MISSING, f] = middle[cell, f]
            raw = grow_all(filled, counts, base[cell], rounds if study.two_classes[cell] else 0, leaves)
            for at in range(0, len(kind), newton.SLICE):
                own = kind[at:at + newton.SLICE]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), cell), pa.int32()), pa.array([v.tobytes() for v in own], pa.binary()), _binary(raw[at:at + newton.SLICE])],
                    names=["cell", "_bins", "raw"])
    sent = kinds.mapInArrow(send, "cell int, bins binary, y binary, n binary").repartitionById(len(study.cells), "cell")
    grown = session.durable(sent.mapInArrow(grow, "cell int, _bins binary, raw binary"))
    each = F.array_sort(F.collect_list(F.struct("cell", "raw")))
    raw = grown.groupBy("_bins").agg(F.aggregate(each, F.lit(b""), lambda s, v: F.concat(s, v["raw"])).alias("_raw"))
    return stored.join(raw, "_bins")


def held_out_scores(frame: DataFrame, assigned: DataFrame, group: str, row: str, numeric: list[str], categorical: list[str],
                    classes: int = 2) -> tuple[DataFrame, newton.Study]:
    """(cell, row, y, scores) of every held-out row: one score for two classes (the logit of 1), else one a class.

    ``frame`` has a column ``label`` of whole numbers from 0. Rows with a null label are left
    out, a null group is a group. Bins come from all rows, without their labels; null numbers
    take the median of the training rows, null and unseen levels are no level. Folds whose
    training rows have one class are left out; if all are, it is an error. No early stop.
    """
    spark, kind = frame.sparkSession, frame.schema[row].dataType.simpleString()
    data, study = newton.laid_out(frame, assigned, group, row, numeric, categorical, [1.0], 2, [newton.Variant()])
    newton.prepare(data, study)
    if not study.two_classes.any():
        raise ValueError("no fold had two classes to train on")
    counts = _counts(data, study, classes)
    share = np.clip(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1), 1e-15, 1 - 1e-15)
    base = np.log(share[:, 1:] / share[:, :1]) if classes == 2 else np.log(share)
    boost = Boost(study, base.shape[1], _bin_edges(data, numeric), base)
    partitions = max(1, min(spark.sparkContext.defaultParallelism, math.ceil(data.count() / TASK_ROWS)))
    stored = _store(data.repartition(partitions), boost, kind)
    kinds = _kinds(stored, study)
    if kinds.select("_bins").distinct().count() <= NODE_ROWS:
        return _told(_grown(stored, kinds, boost), boost, row, kind), study
    return _told(_passes(stored, boost, counts, partitions, kind), boost, row, kind), study


def _passes(stored: DataFrame, boost: Boost, counts: np.ndarray, partitions: int, kind: str) -> DataFrame:
    """The rows with their scores, the last trees left in ``boost``: nodes are summed in passes until a task may hold their rows."""
    study = boost.study
    models = [(int(c), k) for c in np.flatnonzero(study.two_classes) for k in range(boost.classes)]
    trees: dict[tuple[int, int], Growing] = {m: Growing() for m in models}
    rounds = {c: 0 for c, _ in models}
    kept = dict(rounds)
    while trees:
        # Nodes to be summed in passes, and nodes whose rows one task may hold.
        summed, gathered = {}, {}
        sum_asked, gather_asked = [], []
        finished: dict[tuple[int, int], list[int]] = {}
        for model, tree in trees.items():
            done, needed = tree.advance()
            if done is not None:
                finished[model] = done
                continue
            size = {n: tree.total[n][2] if n else int(counts[model[0]].sum()) for n in needed}
            small, large = [max(n, 1) for n in needed if size[n] <= NODE_ROWS], [n for n in needed if size[n] > NODE_ROWS]
            flat, place = tree.tree({n for n in tree.split if 2 * n in tree.split} | set(large) - {0})
            if large:
                wanted = [tree.asked(n) for n in large]
                summed[model] = (flat, {place[n]: len(sum_asked) + i for i, n in enumerate(wanted)})
                sum_asked += [(model, n) for n in wanted]
            if small:
                gathered[model] = (flat, {place[n]: len(gather_asked) + i for i, n in enumerate(small)})
                gather_asked += [(model, n) for n in small]
        # A cell goes on to its next round when the trees of all its classes are done.
        for cell in {c for c, _ in finished if all((c, k) in finished for k in range(boost.classes))}:
            for k in range(boost.classes):
                boost.recent.setdefault((cell, k), []).append(trees[cell, k].tree(set(finished[cell, k]))[0])
                trees[cell, k] = Growing()
            rounds[cell] += 1
            if rounds[cell] == ROUNDS:
                for k in range(boost.classes):
                    del trees[cell, k]
        if max(rounds[c] - kept[c] for c in rounds) >= KEEP:
            stored, boost.recent, kept = _absorb(stored, boost, kind), {}, dict(rounds)
        if sum_asked:
            for (model, node), sums in zip(sum_asked, _sums(stored, boost, summed, partitions)):
                trees[model].learn(node, sums)
        if gather_asked:
            for request, found in _below(stored, boost, gathered, len(gather_asked), partitions).items():
                model, node = gather_asked[request]
                trees[model].attach(node, found)
    return stored


def _told(stored: DataFrame, boost: Boost, row: str, kind: str) -> DataFrame:
    """(cell, row, y, scores) of every held-out row."""
    middle, cells = boost.middle(), np.flatnonzero(boost.study.two_classes)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(batch, boost, middle)
            for cell in cells:
                at = np.flatnonzero(rows.role[:, cell] == 2)
                raw = boost.scores(cell, rows.of(cell, at), rows.raw[at, cell])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), cell), pa.int32()), batch.column(batch.schema.get_field_index("_row")).take(pa.array(at)),
                     pa.array(rows.y[at].astype(np.int32)), pa.array(list(raw), pa.list_(pa.float64()))], names=["cell", row, "y", "scores"])
    return stored.mapInArrow(told, f"cell int, {row} {kind}, y int, scores array<double>")


def score_folds(frame: DataFrame, assigned: DataFrame, group: str, row: str, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, list[dict]]:
    """(seed, fold, row, y, p) of every held-out row, and the folds scored."""
    scores, study = held_out_scores(frame, assigned, group, row, numeric, categorical)
    seeds, folds = (F.array(*[F.lit(int(c[i])) for c in study.cells]) for i in (1, 2))
    at = F.col("cell") + 1
    out = scores.select(F.element_at(seeds, at).alias("seed"), F.element_at(folds, at).alias("fold"), row, "y",
                        (1 / (1 + F.exp(-F.col("scores")[0]))).alias("p"))
    return out, [{"seed": s, "fold": f, "c": None} for i, (_, s, f) in enumerate(study.cells) if study.two_classes[i]]
