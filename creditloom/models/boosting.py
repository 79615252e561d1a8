"""Boosted trees with patience: squared, logistic and softmax loss on binned features.

MLlib boosts without multiclass loss, cannot keep the best prefix of rounds, and prepares its bins anew for every
round. Here features are binned once by exact quantiles and written as blocks. Up to ``_TASK_ROWS`` rows a model is one
task's, which grows all its rounds in one job: a job's latency is many times the work of a level of so few rows. Models
that do not need each other are trained side by side.

Of a larger table a level of the tree (of all classes' trees) is one job: every partition sums gradients by node,
feature and bin, and the sums of all partitions meet. Validation rows ride along: the first job of a round also measures
the rounds before it. Blocks are numpy arrays in an RDD and keep a feature's bins together. A round's first job also
brings the margins up to date and keeps them; the lineage is cut by a checkpoint in the shared folder.

Either way features of few bins are summed together, by the combination of their bins, and each feature's sums are sums
of those. Of two siblings the smaller one is summed; the other is what the parent has left.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.operators.quantiles import exact_quantiles
from creditloom.runtime import checkpoint_root, materialize

_BLOCK = 8192  # rows
_TASK_ROWS = 1_000_000  # of a table that is one task's
_MERGED = 262_144  # rows of a block when there are several tasks
_MOST_ROWS = 2_000_000  # of a task, once every core has one
_FEW_CELLS, _MANY_CELLS = 64, 4096  # combinations of bins that are summed together, by the rows of a block
_EQUAL = 1e-9  # share of a gain
_COMPARED = 32  # nodes of a level whose rows are routed by comparing whole columns
_CUT = 32  # rounds between checkpoints
_AT_ONCE = 16 << 20  # bytes of sums that come back without a shuffle
_NODES = 16  # nodes whose sums travel together
_BUCKETS = 4096  # of the score, for the validation AUC


# --- losses: margins (rows, classes) -> gradient and second derivative ----------------------------


def _probability(loss: str, margin: np.ndarray) -> np.ndarray:
    if loss == "squared":
        return margin
    if loss == "logistic":
        return 1.0 / (1.0 + np.exp(-margin))
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _derivatives(loss: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _probability(loss, margin)
    if loss == "squared":
        return p - y[:, None], np.ones_like(p)
    target = y[:, None] if loss == "logistic" else (y[:, None] == np.arange(p.shape[1])).astype(float)
    return p - target, np.maximum(p * (1.0 - p), 1e-16)


def _measure(metric: str, loss: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums from which :func:`_score` makes the validation metric."""
    if metric == "auc":
        bucket = np.minimum((_probability(loss, margin)[:, 0] * _BUCKETS).astype(np.int64), _BUCKETS - 1)
        return np.stack([np.bincount(bucket[y == v], w[y == v], _BUCKETS) for v in (0, 1)])
    p = _probability(loss, margin)
    if loss == "squared":
        each = (p[:, 0] - y) ** 2
    elif loss == "logistic":
        each = np.logaddexp(0.0, np.where(y == 1, -margin[:, 0], margin[:, 0]))
    else:
        each = -np.log(np.maximum(p[np.arange(len(y)), y.astype(np.int64)], 1e-300))
    return np.array([(w * each).sum(), w.sum()])


def _score(metric: str, sums: np.ndarray) -> float:
    """Greater is better."""
    if metric == "auc":
        negative, positive = sums
        below = np.cumsum(negative) - negative
        pairs = negative.sum() * positive.sum()
        return float((positive * (below + negative / 2)).sum() / pairs) if pairs else 0.0
    return float(-sums[0] / sums[1]) if sums[1] else 0.0


# --- trees: node i has children 2 i + 1 and 2 i + 2 -----------------------------------------------


@dataclass
class Tree:
    feature: np.ndarray  # -1: leaf
    cut: np.ndarray  # bins up to this one go left
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        size = (1 << (depth + 1)) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` steps; rows of ``bins`` may lie in either order in memory."""
        node = np.zeros(len(bins), np.uint8 if levels < 8 else np.int32)
        for level in range(levels):
            if not self.step(node, bins, level):
                break
        return node

    def step(self, node: np.ndarray, bins: np.ndarray, level: int) -> bool:
        """Take the rows that are in nodes of ``level`` one step down, in place. False: nothing is split there."""
        first, size = (1 << level) - 1, 1 << level
        split = (np.flatnonzero(self.feature[first : first + size] >= 0) + first).tolist()
        if not split:
            return False
        if len(split) <= _COMPARED and bins.strides[0] == 1:
            # whole columns of bytes are compared many at a time
            old = node.copy()
            for i in split:
                here = old == i
                node += here * node.dtype.type(i + 1)
                node += here & (bins[:, self.feature[i]] > self.cut[i])
            return True
        by_row, by_feature = bins.strides
        flat, rows = bins.ravel(order="K"), np.arange(len(bins)) * by_row
        inner = self.feature >= 0
        inner[:first] = inner[first + size :] = False
        at = np.where(inner, self.feature, 0).astype(np.int64) * by_feature
        cut = np.where(inner, self.cut, 255).astype(np.uint8)  # a leaf's rows go left, which is where it stays
        left = np.where(inner, 2 * np.arange(len(inner)) + 1, np.arange(len(inner))).astype(node.dtype)
        right = flat.take(at.take(node) + rows) > cut.take(node)
        node[:] = left.take(node) + right
        return True

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, len(self.value).bit_length() - 1)]


def one_task(df: DataFrame) -> bool:
    """Whether a boosted model of the table is grown by one task, so that several models can be trained side by side."""
    return df.count() <= _TASK_ROWS


def _add(margin: np.ndarray, rounds: list[list[Tree]], bins: np.ndarray) -> np.ndarray:
    out = margin.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree.predict(bins)
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8, order="F")
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[:, f], "left")
    return out


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """The distinct quantiles that cut ``values`` in ``bins`` equal shares, the same as those of :func:`exact_quantiles`."""
    if not len(values):
        return np.empty(0)
    ordered, at = np.sort(values), (len(values) - 1) * (np.arange(1, bins) / bins)
    low = np.floor(at).astype(np.int64)
    a, b = ordered[low], ordered[np.ceil(at).astype(np.int64)]
    with np.errstate(invalid="ignore"):
        return np.unique(np.where(a == b, a, a + (b - a) * (at - low)))


class _Cells:
    """Features that are summed together: a row's cell is the combination of its bins, and a group has few cells.

    The sums of a feature's bins are those of the cells with that bin, so nothing is lost by summing cells. Features
    that have one bin cannot be split and are left out.
    """

    def __init__(self, sizes: list[int], rows: int, bins: int):
        most = min(max(rows // 128, _FEW_CELLS), _MANY_CELLS)
        self.width, self.bins = len(sizes), bins
        self.groups: list[list[tuple[int, int, int]]] = []  # (feature, bins, cells of a step)
        self.cells: list[int] = []
        for n, f in sorted(((n, f) for f, n in enumerate(sizes) if n > 1), key=lambda x: (-x[0], x[1])):
            for i, cells in enumerate(self.cells):
                if cells * n <= most:
                    self.groups[i].append((f, n, cells))
                    self.cells[i] *= n
                    break
            else:
                self.groups.append([(f, n, 1)])
                self.cells.append(n)

    def of(self, x: np.ndarray) -> list[np.ndarray]:
        """The cell of each row, by group; ``x`` is (features, rows)."""
        out = []
        for group in self.groups:
            cell = x[group[0][0]].astype(np.uint16)
            for f, _, step in group[1:]:
                cell += x[f] * np.uint16(step)
            out.append(cell)
        return out

    def sums(self, cells: list[np.ndarray], slot: np.ndarray | None, slots: int, weights: list[np.ndarray | None]) -> list[np.ndarray]:
        """(weights, slots, cells) by group; a weight of None counts rows."""
        out = []
        for cell, size in zip(cells, self.cells):
            at = cell.astype(np.intp)
            if slot is not None:
                at += slot * np.intp(size)
            out.append(np.stack([np.bincount(at, w, slots * size) for w in weights]).reshape(len(weights), slots, size))
        return out

    def features(self, sums: list[np.ndarray]) -> np.ndarray:
        """(slots, features, bins, weights) of the sums of cells."""
        weights, slots = sums[0].shape[:2]
        out = np.zeros((slots, self.width, self.bins, weights))
        out[:, :, 0] = sums[0].sum(axis=2).T[:, None]  # stays where a feature has one bin
        for group, total in zip(self.groups, sums):
            shaped = total.reshape(weights, slots, *(n for _, n, _ in reversed(group)))
            for i, (f, n, _) in enumerate(reversed(group)):
                axes = tuple(2 + j for j in range(len(group)) if j != i)
                out[:, f, :n] = np.moveaxis(shaped.sum(axis=axes), 0, -1)
        return out


def _splits(sums: np.ndarray, l2: float, least: float) -> list[tuple]:
    """(node offset, gain, feature, cut, sums left, sums right) of every node that has a useful split."""
    out = []
    whole = sums[:, 0].sum(axis=1)  # every feature's bins add up to the node
    left = sums.cumsum(axis=2)[:, :, :-1]
    right = whole[:, None, None] - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = worth(left) + worth(right) - worth(whole)[:, None, None]
    gain[(left[..., 1] < least) | (right[..., 1] < least)] = -np.inf
    for node in range(len(sums)):
        # of splits that differ by the rounding of their sums only, the first
        best = int(np.argmax(gain[node] >= gain[node].max() * (1 - _EQUAL)))
        f, b = divmod(best, gain.shape[2])
        if gain[node, f, b] > 1e-9:
            out.append((node, float(gain[node, f, b]), f, b, left[node, f, b].tolist(), right[node, f, b].tolist()))
    return out


# --- model -----------------------------------------------------------------------------------------


@dataclass
class BoostedModel:
    loss: str
    base: np.ndarray
    edges: list[np.ndarray]
    rounds: list[list[Tree]]
    importances: np.ndarray
    #: Validation metric after 0, 1, 2 ... rounds (greater is better); ``rounds`` is the best prefix.
    curve: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The prediction of a regression, the probabilities of all classes of a classification."""
        return self.binned_scores(self.binned(x))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return _binned(x, self.edges)

    def binned_scores(self, bins: np.ndarray) -> np.ndarray:
        margin = np.tile(self.base, (len(bins), 1))
        return self._shown(_add(margin, self.rounds, bins) if len(bins) else margin)

    def _shown(self, margin: np.ndarray) -> np.ndarray:
        p = _probability(self.loss, margin)
        return np.column_stack([1.0 - p, p]) if self.loss == "logistic" else p

    def changes(self, x: np.ndarray, other: np.ndarray, places: list[int]) -> np.ndarray:
        """How each row's first score changes when the feature at ``places[i]`` alone takes the value ``other[:, i]``.

        Values are binned once, and only trees that split by a feature are walked again for it.
        """
        bins = self.binned(x)
        codes = [np.searchsorted(self.edges[f], other[:, i], "left") for i, f in enumerate(places)]
        margin = np.tile(self.base, (len(x), 1))
        steps = np.zeros((len(places), *margin.shape))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                plain = tree.predict(bins)
                margin[:, k] += plain
                used = set(tree.feature.tolist())
                for i, f in enumerate(places):
                    if f in used:
                        own = bins[:, f].copy()
                        bins[:, f] = codes[i]
                        steps[i, :, k] += tree.predict(bins) - plain
                        bins[:, f] = own
        if self.loss == "squared":
            return np.ascontiguousarray(steps[:, :, 0].T)
        base = self._shown(margin)[:, 0]
        return np.column_stack([self._shown(margin + s)[:, 0] - base for s in steps])

    def switched(self, z: np.ndarray) -> "Switched":
        """What the features of a regression add against the binned background ``z``."""
        return Switched([t for trees in self.rounds for t in trees], z)

    def transform(self, df: DataFrame, features: str = "features", prediction: str = "prediction") -> DataFrame:
        """Add the prediction (of a classification the class number, with ``probability``)."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, len(sent.value.edges)))
                yield pd.Series(list(sent.value.scores(x)), dtype=object)

        out = df.withColumn("probability", scores(vector_to_array(F.col(features))))
        if self.loss == "squared":
            return out.withColumn(prediction, F.get("probability", F.lit(0))).drop("probability")
        return out.withColumn(prediction, (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def to_json(self) -> str:
        trees = [[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in ts] for ts in self.rounds]
        return json.dumps([self.loss, self.base.tolist(), [e.tolist() for e in self.edges], trees, self.importances.tolist(), self.curve])

    @classmethod
    def from_json(cls, text: str) -> "BoostedModel":
        loss, base, edges, trees, importances, curve = json.loads(text)
        rounds = [[Tree(np.array(f, np.int32), np.array(c, np.int32), np.array(v)) for f, c, v in ts] for ts in trees]
        return cls(loss, np.array(base), [np.array(e) for e in edges], rounds, np.array(importances), curve)


class Switched:
    """Mean change of a sum of trees when features are switched one by one from background rows to a row's own values.

    Features are switched in their order and in the reverse order. A leaf is reached after t steps if the first feature
    of its path that the row fails is not yet switched, and the last one that the background row fails is. So of a row
    only its first and last failed feature count, and of the background how many of its rows reach the leaf from each
    step on; no switched version is made.
    """

    def __init__(self, trees: list[Tree], z: np.ndarray):
        self.width = z.shape[1]
        self.parts = []
        for tree in trees:
            used = np.unique(tree.feature[tree.feature >= 0])
            if len(used):
                leaves, first, last = self._failed(tree, used, z)
                steps = np.arange(len(used) + 1)
                # the share of the background that reaches a leaf of the row after each number of steps
                onward = (last[:, :, None] < steps).mean(axis=1)
                back = (len(used) - first[:, :, None].astype(int) <= steps).mean(axis=1)
                worth = tree.value[leaves][:, None]
                self.parts.append((tree, used, worth * onward, worth * back))

    @staticmethod
    def _failed(tree: Tree, used: np.ndarray, bins: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The leaves, and by leaf and row the place among ``used`` of the first and last feature that leads elsewhere.

        If none does, these are the number of features and -1.
        """
        m, n = len(used), len(bins)
        place = {int(f): i for i, f in enumerate(used)}
        leaves, firsts, lasts = [], [], []
        open_ = [(0, np.full(n, m, np.int16), np.full(n, -1, np.int16))]
        while open_:
            node, first, last = open_.pop()
            f = int(tree.feature[node])
            if f < 0:
                leaves.append(node)
                firsts.append(first)
                lasts.append(last)
                continue
            right, at = bins[:, f] > tree.cut[node], np.int16(place[f])
            for child, away in ((2 * node + 2, ~right), (2 * node + 1, right)):
                open_.append((child, np.minimum(first, np.where(away, at, np.int16(m))), np.maximum(last, np.where(away, at, np.int16(-1)))))
        return leaves, np.stack(firsts), np.stack(lasts)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): what each feature adds, for binned rows."""
        out = np.zeros((len(x), self.width))
        for tree, used, onward, back in self.parts:
            m = len(used)
            _, first, last = self._failed(tree, used, x)
            place, total = np.arange(m), np.zeros((len(x), m))
            stays = np.arange(m + 1)[:, None]  # the first failed feature, or the last one and 1
            for a, b, there, here in zip(first, last, onward, back):
                # the leaf counts up to the first failed feature; backwards up to the last one, and there the steps run down
                forth = np.where(stays > place, there[1:], 0.0) - np.where(stays >= place, there[:-1], 0.0)
                home = np.where(stays <= place, here[::-1][:-1], 0.0) - np.where(stays <= place + 1, here[::-1][1:], 0.0)
                table = ((forth[:, None] + home[None]) / 2).reshape(-1, m)
                total += table.take(a.astype(np.intp) * (m + 1) + b + 1, axis=0)
            out[:, used] += total
        return out


@dataclass
class Boosting:
    """Settings of a model; ``patience`` rounds without a better validation metric end the training."""

    loss: str = "squared"
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    l2: float = 1.0
    least: float = 1.0  # sum of second derivatives on either side of a split
    bins: int = 64
    classes: int = 2  # of the softmax loss
    patience: int | None = None
    metric: str = "loss"  # or auc

    def fit(self, df: DataFrame, features: str = "features", label: str = "label", weight: Column | None = None, validation: str | None = None) -> BoostedModel:
        """``validation`` names a boolean column; its rows only measure. Labels of softmax are 0, 1, ... classes - 1."""
        spark = df.sparkSession
        checkpoint_root(spark)
        rows = materialize(
            df.select(
                vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"),
                (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), (F.col(validation) if validation else F.lit(False)).alias("v"),
            ).where("y IS NOT NULL"),
            "boosting-rows",
        )
        train, validate = rows.where("NOT v"), validation is not None
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        if one_task(rows):
            return self._fit_here(rows, self._base(train), validate)
        names = [f"f{i}" for i in range(first["n"])]
        marks: dict[str, set] = {n: set() for n in names}
        for q in exact_quantiles(train.select(*[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)]), names, [i / self.bins for i in range(1, self.bins)]):
            if q.value is not None:
                marks[q.column].add(q.value)
        edges = [np.array(sorted(marks[n])) for n in names]
        base = self._base(train)
        blocks = self._blocks(rows, edges, base)
        cells = _Cells([len(e) + 1 for e in edges], _MERGED, self.bins)
        return BoostedModel(self.loss, base, edges, *self._learn_by_level(blocks, cells, len(base), validate))

    def _base(self, train: DataFrame) -> np.ndarray:
        if self.loss == "softmax":
            share = np.full(self.classes, 1e-9)
            for r in train.groupBy("y").agg(F.sum("w").alias("w")).collect():  # one row for each class
                share[int(r["y"])] += r["w"]
            return np.log(share / share.sum())
        mean = train.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0] or 0.0
        return np.array([mean if self.loss == "squared" else float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9)))])

    def _blocks(self, rows: DataFrame, edges: list[np.ndarray], base: np.ndarray):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _BLOCK):
                    part = batch.slice(at, _BLOCK)
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(edges))
                    made = [_binned(x, edges).tobytes("F"), *(part.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).tobytes() for c in "yw")]
                    made.append(part.column("v").cast(pa.uint8()).to_numpy(zero_copy_only=False).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([m], pa.binary()) for m in made], ["x", "y", "w", "v"])

        stored = materialize(rows.mapInArrow(pack, "x binary, y binary, w binary, v binary"), "boosting-blocks")

        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // _MOST_ROWS))

        def arrays(part) -> Iterator[tuple]:
            """(bins by feature, label, weight, validation or not, margins), learned and measured rows apart."""
            held, size = [], 0
            for r in part:
                y, w, v = np.frombuffer(r["y"]), np.frombuffer(r["w"]), np.frombuffer(r["v"], bool)
                held.append((np.frombuffer(r["x"], np.uint8).reshape(len(edges), len(y)), y, w, v))
                size += len(y)
                if size >= _MERGED:
                    yield from joined(held)
                    held, size = [], 0
            if held:
                yield from joined(held)

        def joined(held: list[tuple]) -> Iterator[tuple]:
            x, y, w, v = (np.concatenate(c, axis=-1) for c in zip(*held))
            for kind in (False, True):
                at = np.flatnonzero(v == kind)
                if len(at):
                    yield np.ascontiguousarray(x[:, at]), y[at], w[at], kind, np.tile(base, (len(at), 1))

        return stored.repartition(tasks).rdd.mapPartitions(arrays).persist(StorageLevel.MEMORY_AND_DISK)

    def _learn(self, width: int, validate: bool, grow: Callable, keep: Callable) -> tuple[list[list[Tree]], np.ndarray, list[float]]:
        """The best prefix of rounds, its gains by feature, and the curve. ``grow`` makes a round, ``keep`` adds it to the margins."""
        rounds: list[list[Tree]] = []
        gains: list[np.ndarray] = []
        curve: list[float] = []
        best = 0
        while validate or len(rounds) < self.rounds:
            trees, gain, measured = grow()
            if validate:
                curve.append(_score(self.metric, measured))
                if curve[-1] > curve[best]:
                    best = len(rounds)
            if trees is None or len(rounds) >= self.rounds or (self.patience and len(rounds) - best >= self.patience):
                break
            rounds.append(trees)
            gains.append(gain)
            keep(trees, len(rounds))
        kept = best if validate else len(rounds)
        return rounds[:kept], np.sum(gains[:kept], axis=0) if kept else np.zeros(width), curve

    def _round(self, classes: int, width: int, level: Callable) -> tuple[list[Tree] | None, np.ndarray, np.ndarray | None]:
        """The trees of one round (None: no split helps), gains by feature, and validation sums before the round."""
        trees = [Tree.empty(self.depth) for _ in range(classes)]
        gain, measured = np.zeros(width), None
        asked = [(k, 0, None) for k in range(classes)]  # (class, node, its smaller sibling)
        for n in range(self.depth):
            found, sums = level(trees, n, asked)
            if n == 0:
                measured = sums
            if not found:
                break
            asked = []
            for k, node, g, f, cut, left, right in sorted(found):
                trees[k].feature[node], trees[k].cut[node] = f, cut
                for child, s in ((2 * node + 1, left), (2 * node + 2, right)):
                    trees[k].value[child] = -self.rate * s[0] / (s[1] + self.l2)
                gain[f] += g
                small = 2 * node + (1 if left[1] <= right[1] else 2)
                asked += [(k, small, None), (k, 4 * node + 3 - small, small)]
        return (trees if any((t.feature >= 0).any() for t in trees) else None), gain, measured

    def _weights(self, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[list[np.ndarray | None]]:
        """Gradient and second derivative of the rows by class; None: the latter is one."""
        plain = bool((w == 1.0).all())
        if plain and self.loss == "squared":
            return [[margin[:, 0] - y, None]]
        g, h = _derivatives(self.loss, margin, y)
        return [[d[:, k].copy() if plain else w * d[:, k] for d in (g, h)] for k in range(margin.shape[1])]

    def _measured(self, blocks: list[tuple], total: np.ndarray | None = None) -> np.ndarray:
        for _, y, w, valid, margin in blocks:
            if valid:
                m = _measure(self.metric, self.loss, margin, y, w)
                total = m if total is None else total + m
        return total if total is not None else np.zeros((2, _BUCKETS)) if self.metric == "auc" else np.zeros(2)

    # a table that is one task's

    def _fit_here(self, rows: DataFrame, base: np.ndarray, validate: bool) -> BoostedModel:
        settings = self

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            y, w, v = (np.concatenate([b.column(c).cast(t).to_numpy(zero_copy_only=False) for b in held]) for c, t in (("y", pa.float64()), ("w", pa.float64()), ("v", pa.uint8())))
            v = v.astype(bool)
            x = [b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in held]
            edges, bins = [], np.empty((x[0].shape[1], len(y)), np.uint8)
            for f in range(len(bins)):
                values = np.concatenate([part[:, f] for part in x])
                edges.append(_edges(values[~v], settings.bins))
                bins[f] = np.searchsorted(edges[f], values, "left")
            del x, held
            blocks = []
            for kind in (False, True):
                at = np.flatnonzero(v == kind)
                if len(at):
                    blocks.append((bins[:, at], y[at], w[at], kind, np.tile(base, (len(at), 1))))
            del bins
            made = edges, settings._learn_here(blocks, [len(e) + 1 for e in edges], len(base), validate)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

        edges, learned = pickle.loads(rows.coalesce(1).mapInArrow(learn, "made binary").first()["made"])
        return BoostedModel(self.loss, base, edges, *learned)

    def _learn_here(self, blocks: list[tuple], sizes: list[int], classes: int, validate: bool) -> tuple:
        """All rounds of a table that is one task's: rows keep their cells, margins and nodes."""
        cells = _Cells(sizes, max((len(b[1]) for b in blocks if not b[3]), default=0), self.bins)
        mine = [(b, cells.of(b[0])) for b in blocks if not b[3]]
        state: dict = {}

        def level(trees: list[Tree], n: int, asked: list[tuple]) -> tuple[list[tuple], np.ndarray | None]:
            if n == 0:
                state["weights"] = [self._weights(b[4], b[1], b[2]) for b, _ in mine]
                state["nodes"] = [[np.zeros(len(b[1]), np.uint8 if self.depth < 8 else np.int32) for _ in trees] for b, _ in mine]
                state["sums"] = {}
            found, held = [], {}
            for k, tree in enumerate(trees):
                ours = [(node, small) for c, node, small in asked if c == k]
                if not ours or not cells.groups:
                    continue
                summed = [node for node, small in ours if small is None]
                total = None
                for (b, codes), weights, nodes in zip(mine, state["weights"], state["nodes"]):
                    if n:
                        tree.step(nodes[k], b[0].T, n - 1)
                    part = self._cell_sums(cells, codes, nodes[k], weights[k], summed, n)
                    total = part if total is None else [t + p for t, p in zip(total, part)]
                if total is None:
                    continue
                if n:  # what the smaller siblings leave of their parents
                    before, places = state["sums"][k], [summed.index(small) for _, small in ours if small is not None]
                    up = [before[0].index((small - 1) // 2) for _, small in ours if small is not None]
                    total = [np.concatenate([t, p[:, up] - t[:, places]], axis=1) for t, p in zip(total, before[1])]
                order = summed + [node for node, small in ours if small is not None]
                held[k] = (order, total)
                found += [(k, order[i], *rest) for i, *rest in _splits(cells.features(total), self.l2, self.least)]
            state["sums"] = held
            return found, self._measured(blocks) if validate and n == 0 else None

        def grow() -> tuple:
            made = self._round(classes, len(sizes), level)
            if made[0]:
                for nodes, (b, _) in zip(state["nodes"], mine):
                    for node, tree in zip(nodes, made[0]):
                        tree.step(node, b[0].T, self.depth - 1)
            return made

        def keep(trees: list[Tree], _: int) -> None:
            for nodes, (b, _) in zip(state["nodes"], mine):
                for k, tree in enumerate(trees):
                    b[4][:, k] += tree.value.take(nodes[k])
            for b in blocks:
                if b[3]:
                    b[4][:] = _add(b[4], [trees], b[0].T)

        return self._learn(len(sizes), validate, grow, keep)

    def _cell_sums(self, cells: _Cells, codes: list[np.ndarray], node: np.ndarray, weights: list, summed: list[int], level: int) -> list[np.ndarray]:
        """Sums of the rows in the nodes ``summed``, by group of features."""
        if level == 0:
            return cells.sums(codes, None, 1, weights)
        slots = np.full((2 << level) - 1, -1, np.intp)
        slots[summed] = np.arange(len(summed))
        slot = slots.take(node)
        at = np.flatnonzero(slot >= 0)
        return cells.sums([c.take(at) for c in codes], slot.take(at), len(summed), [w if w is None else w.take(at) for w in weights])

    # a larger table: a job for each level

    def _learn_by_level(self, blocks, cells: _Cells, classes: int, validate: bool) -> tuple:
        now, old = blocks, None  # the blocks of this round and of the one before
        held: dict[tuple, np.ndarray] = {}  # sums of the nodes of the level before

        def level(trees: list[Tree], n: int, asked: list[tuple]) -> tuple[list[tuple], np.ndarray | None]:
            return self._level(now, cells, trees, n, asked, validate and n == 0, held)

        def keep(trees: list[Tree], done: int) -> None:
            nonlocal now, old
            if old is not None:
                old.unpersist()
            old, now = now, self._refresh(now, [trees], done)

        try:
            return self._learn(cells.width, validate, lambda: self._round(classes, cells.width, level), keep)
        finally:
            now.unpersist()
            if old is not None:
                old.unpersist()

    def _refresh(self, blocks, rounds: list[list[Tree]], done: int):
        """Blocks whose margins hold ``rounds``, too; the next job makes and keeps them."""
        new = blocks.map(lambda b: (*b[:4], _add(b[4], rounds, b[0].T))).persist(StorageLevel.MEMORY_AND_DISK)
        if done % _CUT == 0:
            new.checkpoint()
        return new

    def _level(self, blocks, cells: _Cells, trees: list[Tree], level: int, asked: list[tuple], measure: bool, held: dict) -> tuple[list[tuple], np.ndarray | None]:
        """Best splits (class, node, gain, feature, cut, left, right) of the nodes of one level, and validation sums.

        ``held`` has the sums of the level before, if they came back, and gets those of this one.
        """
        settings, tasks = self, blocks.getNumPartitions()
        derived = [(k, node, small) for k, node, small in asked if small is not None and (k, (node - 1) // 2) in held]
        at_once = tasks * (len(asked) - len(derived)) * cells.width * self.bins * 16 <= _AT_ONCE
        later = {(k, node) for k, node, _ in derived} if at_once else set()
        summed = [[node for k, node, _ in asked if k == c and (k, node) not in later] for c in range(len(trees))]
        sums = blocks.mapPartitions(lambda part: settings._sums(part, cells, trees, level, summed, measure))
        if at_once:
            met: dict[tuple, np.ndarray] = {}
            for key, part in sums.collect():
                met[key] = met[key] + part if key in met else part
            measured = met.pop(("measure", 0), None)
            of = {(k, summed[k][c * _NODES + i]): s for (k, c), total in met.items() for i, s in enumerate(total)}
            for k, node, small in derived:
                of[k, node] = held[k, (node - 1) // 2] - of.get((k, small), 0.0)
            held.clear()
            held.update(of)
            order = sorted(of)
            found = [(*order[i], *rest) for i, *rest in _splits(np.stack([of[key] for key in order]), self.l2, self.least)] if order else []
        else:
            held.clear()
            # the sums of all nodes of the level meet in a shuffle
            groups = min(tasks, sum(-(-len(nodes) // _NODES) for nodes in summed))
            found, measured = [], None
            for key, value in sums.reduceByKey(np.add, groups).map(lambda item: settings._best(summed, item)).collect():
                if key[0] == "measure":
                    measured = value
                else:
                    found += value
        return found, self._measured([], measured) if measure else None

    def _sums(self, part, cells: _Cells, trees: list[Tree], level: int, summed: list[list[int]], measure: bool) -> Iterator[tuple]:
        """Gradient sums of the blocks' rows by (class, group of nodes), and their validation sums."""
        held: dict[int, list[np.ndarray]] = {}
        measured = None
        for block in part:
            x, y, w, valid, margin = block
            if valid:
                measured = self._measured([block], measured) if measure else None
                continue
            if not cells.groups:
                continue
            codes = cells.of(x)
            for k, (tree, weights) in enumerate(zip(trees, self._weights(margin, y, w))):
                if summed[k]:
                    made = self._cell_sums(cells, codes, tree.nodes(x.T, level), weights, summed[k], level)
                    held[k] = [t + m for t, m in zip(held[k], made)] if k in held else made
        if measured is not None:
            yield ("measure", 0), measured
        for k, total in held.items():
            by_node = cells.features(total)
            for c in range(-(-len(by_node) // _NODES)):
                yield (k, c), by_node[c * _NODES : (c + 1) * _NODES].copy()

    def _best(self, summed: list[list[int]], item: tuple) -> tuple:
        (k, c), total = item
        if k == "measure":
            return (k, c), total
        return (k, c), [(k, summed[k][c * _NODES + i], *rest) for i, *rest in _splits(total, self.l2, self.least)]
