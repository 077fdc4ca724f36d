"""Boosted trees grown leaf by leaf on histograms, any number of candidates side by side over one stored table.

Features are cut into at most 255 bins at quantiles of the training rows. The stored table holds blocks of rows: their bins,
labels, weights and, for each candidate, their scores. A pass is one job: in every block the open leaves' gradients and
hessians are added up by (candidate, leaf, feature, bin), the blocks' histograms are added up by (candidate, leaf, feature)
where the best cut of each is found, and only these cuts, a row for each leaf and feature, reach the driver. There the leaf
of the largest gain is split, until a tree has its number of leaves or nothing gains. A pass evaluates the children of every
leaf that may yet be split, so a tree takes about as many passes as it is deep. All candidates share each pass. Every
``STORE_EVERY`` trees the scores are stored anew, so a lost executor costs a pass.

A table of at most ``SMALL_CELLS`` cells is grown by the same steps, one task a candidate, without jobs in between. There each
node holds its rows, so a split touches only those of the leaf that it cuts, no leaf is evaluated ahead of its turn, and the
scores follow from the rows that the leaves hold in the end. Of two children the smaller one's histogram is added up and the
larger one's is what remains of their parent's.

Gradients and hessians are whole multiples of a grain so small that no sum of them is ever rounded. Sums are then the same in
any order of rows, blocks and tasks, what remains of a parent is exactly the other child, and cuts that part the same training
rows gain exactly the same: the first feature and bin wins.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, field, replace
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fresh
from ..sources.shared import forget, materialise

BINS = 255
BLOCK_ROWS = 16_384
SMALL_CELLS = 4_000_000
STORE_EVERY = 16
STRETCH = 8192
#: Fixed value: the least sum of hessians of a leaf.
LEAST_HESSIAN = 1e-3

#: The three candidates of the main search.
LEAF_GRID = (
    {"n_estimators": 300, "learning_rate": 0.05, "num_leaves": 31, "min_child_samples": 50, "subsample": 0.8, "colsample_bytree": 0.8, "reg_lambda": 0.0, "reg_alpha": 0.0},
    {"n_estimators": 500, "learning_rate": 0.03, "num_leaves": 63, "min_child_samples": 100, "subsample": 0.8, "colsample_bytree": 0.8, "reg_lambda": 0.5, "reg_alpha": 0.0},
    {"n_estimators": 700, "learning_rate": 0.03, "num_leaves": 127, "min_child_samples": 150, "subsample": 0.8, "colsample_bytree": 0.8, "reg_lambda": 1.0, "reg_alpha": 0.1},
)
#: What the random search draws from.
SEARCH = {
    "learning_rate": (0.01, 0.02, 0.03, 0.05, 0.07),
    "num_leaves": (15, 31, 63, 127),
    "min_child_samples": (20, 50, 100, 200),
    "subsample": (0.7, 0.85, 1.0),
    "subsample_freq": (0, 1),
    "colsample_bytree": (0.7, 0.85, 1.0),
    "reg_alpha": (0.0, 0.01, 0.1, 1.0),
    "reg_lambda": (0.0, 0.01, 0.1, 1.0),
    "max_depth": (-1, 6, 10, 14),
}

BLOCK = "block long, rows int, bins binary, y binary, weight binary, val binary, ids binary, scores binary"
HIST = "trial int, leaf int, feature int, cells binary"
FORECAST = "trial int, y_true int, prob double"
CUT = "trial int, leaf int, feature int, gain double, bin int, g double, h double, n double, left_g double, left_h double, left_n double"


@dataclass
class Params:
    """What one candidate is grown with; names and defaults as usual for leaf-wise boosting. ``max_depth`` below 1 sets no
    limit; rows are drawn anew for each tree only if ``subsample_freq`` is 1."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = -1
    min_child_samples: int = 20
    subsample: float = 1.0
    subsample_freq: int = 0
    colsample_bytree: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number: a split has a feature, a bin (up to it goes left) and two children; a leaf has a value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        for name, empty in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0)):
            getattr(self, name).extend([empty, empty])
        left = len(self.feature) - 2
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, left, left + 1
        return left, left + 1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The last node that each row reaches; a right child's number is one above the left one's."""
        feature, at, left = (np.array(x) for x in (self.feature, self.bin, self.left))
        flat, width = bins.reshape(-1), bins.shape[1]
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows := rows.compress(feature.take(node.take(rows)) >= 0)):
            here = node.take(rows)
            node[rows] = left.take(here) + (flat.take(rows * width + feature.take(here)) > at.take(here))
        return node


@dataclass
class Request:
    """What a candidate wants of a pass: cuts of the open nodes of a tree under way."""

    tree: Tree
    open: list[int]
    features: list[int]
    round: int
    trees: list[Tree]
    params: Params
    loss: bool  # whether the validation loss of the trees so far is wanted too


@dataclass
class Model:
    """A fitted ensemble: bin edges of each feature, the first score and the trees."""

    features: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree]
    params: Params
    losses: list[float] = field(default_factory=list)

    def importances(self) -> list[tuple[str, int, float]]:
        """``(feature, splits, gain)``: how often a feature splits a node, and what that gains in all."""
        n, gain = [0] * len(self.features), [0.0] * len(self.features)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    n[f] += 1
                    gain[f] += g
        return list(zip(self.features, n, gain, strict=True))

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for t in self.trees:
            out += np.array(t.value)[t.nodes_of(bins)]
        return out

    def probability(self) -> Column:
        """The probability of a row, from its feature columns (numbers without nulls)."""
        model = self

        @F.pandas_udf("double")
        def probability(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for parts in columns:
                x = np.column_stack([c.to_numpy(float) for c in parts])
                yield pd.Series(1 / (1 + np.exp(-model.scores(binned(x, model.edges)))))

        return probability(*[F.col(f).cast("double") for f in self.features])


def binned(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """A value's bin is the number of its feature's edges below it."""
    return np.column_stack([np.searchsorted(np.array(e, float), x[:, i]) for i, e in enumerate(edges)]).astype(np.uint8)


# ---- what happens inside a block


def drawn(ids: np.ndarray, params: Params, round_: int) -> np.ndarray:
    """The rows of a tree's bag, by a hash of id, seed and round: the same wherever a row lies."""
    if not params.subsample_freq or params.subsample >= 1:
        return np.ones(len(ids), bool)
    h = ids ^ (np.uint64(params.seed * 1_000_003 + round_) * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / 2**53 < params.subsample


def grain_of(weight: float) -> float:
    """The power of two in whose multiples gradients are counted: sums of as many as ``weight``, all their weights, stay exact."""
    return 2.0 ** max(math.ceil(math.log2(weight)) - 52, -1000) if weight > 0 else 1.0


def slopes(y: np.ndarray, weight: np.ndarray, score: np.ndarray, grain: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's gradient and hessian, in whole grains; worked out in short stretches, which stay in the processor's cache."""
    out = np.empty((2, len(y)))
    for lo in range(0, len(y), STRETCH):
        part = slice(lo, lo + STRETCH)
        p = np.exp(-score[part])
        p += 1
        np.divide(1, p, out=p)
        for x, to in ((p - y[part], out[0, part]), (p * (1 - p), out[1, part])):
            x *= weight[part]
            x *= 1 / grain
            np.multiply(np.rint(x, out=x), grain, out=to)
    return out[0], out[1]


def histograms(
    bins: np.ndarray, y: np.ndarray, weight: np.ndarray, train: np.ndarray, ids: np.ndarray, score: np.ndarray, want: Request, grain: float
) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(node, feature, cells)`` of the open nodes: sums of gradient, hessian and rows for each bin."""
    node = want.tree.nodes_of(bins)
    slot = np.full(len(want.tree.feature), -1)
    slot[want.open] = np.arange(len(want.open))
    rows = np.flatnonzero(train & (slot[node] >= 0) & drawn(ids, want.params, want.round))
    g, h = slopes(y[rows], weight[rows], score[rows], grain)
    at, size = slot[node[rows]] * (BINS + 1), len(want.open) * (BINS + 1)
    for f in want.features:
        cell = at + bins[rows, f]
        sums = np.stack([np.bincount(cell, v, size) for v in (g, h, np.ones(len(rows)))]).reshape(3, len(want.open), BINS + 1)
        for i, n in enumerate(want.open):
            yield n, f, sums[:, i]


def log_loss(y: np.ndarray, score: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -score, score)).sum())


def best_cuts(cells: np.ndarray, p: Params) -> list[tuple]:
    """``(gain, bin, g, h, n, left g, left h, left n)`` of the best cut of each histogram; a gain of 0 is none."""
    sums = cells.cumsum(axis=2)
    whole, left = sums[:, :, -1:], sums[:, :, :-1]
    right = whole - left
    gain = _worth(left[:, 0], left[:, 1], p) + _worth(right[:, 0], right[:, 1], p) - _worth(whole[:, 0], whole[:, 1], p)
    fits = (np.minimum(left[:, 2], right[:, 2]) >= max(p.min_child_samples, 1)) & (np.minimum(left[:, 1], right[:, 1]) >= LEAST_HESSIAN)
    gain = np.where(fits & (gain > 1e-9), gain, 0.0)
    k, i = gain.argmax(axis=1), np.arange(len(cells))
    return [(g, b, *w, *x) for g, b, w, x in zip(gain[i, k].tolist(), k.tolist(), whole[:, :, 0].tolist(), left[i, :, k].tolist(), strict=True)]


def best_cut(cells: np.ndarray, p: Params) -> tuple:
    """``best_cuts`` of one histogram."""
    return best_cuts(cells[None], p)[0]


def _worth(g, h, p: Params):
    shrunk = np.maximum(np.abs(g) - p.reg_alpha, 0) if p.reg_alpha else g
    return shrunk * shrunk / np.maximum(h + p.reg_lambda, 1e-300)


def leaf_value(g: float, h: float, p: Params) -> float:
    return -math.copysign(max(abs(g) - p.reg_alpha, 0.0), g) / (h + p.reg_lambda) * p.learning_rate if h + p.reg_lambda > 0 else 0.0


# ---- the growth of one candidate, driven by passes

NO_CUT = (0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def grow(params: Params, n_features: int, patience: int | None, ahead: bool = True) -> Generator[Request, tuple[dict, float | None], tuple[list[Tree], list[float]]]:
    """Yields requests, is sent ``({(node, feature): cut}, validation loss)``, and returns the trees and the losses.

    Who answers adds ``Request.trees`` to the scores first. Growth ends with ``n_estimators`` trees or where not even a root can
    be cut; with patience also after so many trees without a new least loss, and the trees after the best are cut off. With
    ``ahead`` a request also opens children that may not be needed, which saves passes; without, only those of the leaf just split.
    """
    trees: list[Tree] = []
    losses: list[float] = []
    best = lambda: int(np.argmin(losses[1:])) + 1 if len(losses) > 1 else 0
    while True:
        features = sorted(Random(params.seed * 7919 + len(trees)).sample(range(n_features), max(1, round(params.colsample_bytree * n_features))))
        tree, shadow = Tree(), Tree()  # the shadow splits ahead of the decision, so that children can be evaluated early
        plan: dict[int, tuple[int, tuple]] = {}  # of the shadow's nodes: feature and cut
        twin, depth, sums = {0: 0}, {0: 0}, {}
        heap: list[tuple[float, int]] = []
        leaves = 1

        def note(cuts: dict, open_: list[int]) -> None:
            for n in open_:
                found = [(cuts[n, f][0], -f) for f in features if (n, f) in cuts]
                plan[n] = (-max(found)[1], cuts[n, -max(found)[1]]) if found else (0, NO_CUT)

        def may_split(node_depth: int) -> bool:
            return params.max_depth < 1 or node_depth < params.max_depth

        def offer(node: int) -> None:
            gain = plan[twin[node]][1][0]
            if gain > 0 and may_split(depth[node]):
                heapq.heappush(heap, (-gain, node))

        cuts, loss = yield Request(shadow, [0], features, len(trees), trees, params, patience is not None)
        if patience is not None:
            losses.append(loss)
            if len(trees) >= params.n_estimators or len(losses) - 1 - best() >= patience:
                return trees[: best()], losses
        elif len(trees) >= params.n_estimators:
            return trees, losses
        note(cuts, [0])
        sums[0] = plan[0][1][2:4]
        offer(0)
        while True:
            waiting: list[int] = []
            while heap and leaves < params.num_leaves and not waiting:
                node = heapq.heappop(heap)[1]
                f, cut = plan[twin[node]]
                pair = tree.split(node, f, cut[1])
                tree.gain[node] = cut[0]
                leaves += 1
                t = twin[node]
                twins = (shadow.left[t], shadow.right[t]) if shadow.feature[t] >= 0 else shadow.split(t, f, cut[1])
                for child, other, side in zip(pair, twins, (cut[5:7], (cut[2] - cut[5], cut[3] - cut[6])), strict=True):
                    twin[child], depth[child], sums[child] = other, depth[node] + 1, side
                    if other in plan:
                        offer(child)
                    elif may_split(depth[child]):
                        waiting.append(child)
            if not waiting or leaves >= params.num_leaves:
                break
            open_ = [twin[c] for c in waiting]
            for _, node in heapq.nsmallest(params.num_leaves - leaves, heap) if ahead else ():  # those that may be split before the next pass
                if shadow.feature[twin[node]] < 0 and may_split(depth[node] + 1):
                    f, cut = plan[twin[node]]
                    open_ += shadow.split(twin[node], f, cut[1])
            cuts, _ = yield Request(shadow, open_, features, len(trees), trees, params, False)
            note(cuts, open_)
            for c in waiting:
                offer(c)
        if leaves == 1:
            return (trees[: best()] if patience is not None else trees), losses
        for node, f in enumerate(tree.feature):
            if f < 0:
                tree.value[node] = leaf_value(*sums[node], params)
        trees.append(tree)


# ---- fitting


def bin_edges(train: DataFrame, features: Sequence[str], sample_rows: int) -> list[list[float]]:
    """Each feature's edges: quantiles of at most about ``sample_rows`` training rows (all, if there are no more), cut by hash."""
    n = train.count()
    if n > sample_rows:
        train = train.where(F.pmod(F.xxhash64(*features), F.lit(10**9)) < int(10**9 * sample_rows / n))
    asked = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    row = train.agg(*[F.percentile(F.col(c).cast("double"), asked).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(len(features))]


def _blocks(batches: Iterator[pa.RecordBatch], n_features: int, edges: list[list[float]], start: float, trials: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            get = lambda i, part=part: part.column(i).to_numpy(zero_copy_only=False)
            x = np.column_stack([get(i) for i in range(n_features)])
            y, weight, val, ids = (get(n_features + i) for i in range(4))
            cells = [binned(x, edges), y.astype(np.uint8), weight.astype(float), val.astype(np.uint8), ids.astype(np.int64), np.full((trials, len(x)), start)]
            yield _block_row(number, len(x), [np.ascontiguousarray(c).tobytes() for c in cells])
            number += 1


def _block_row(number: int, rows: int, cells: list[bytes]) -> pa.RecordBatch:
    arrays = [pa.array([number], pa.int64()), pa.array([rows], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "rows", "bins", "y", "weight", "val", "ids", "scores"])


def _read_blocks(batch: pa.RecordBatch | pa.Table, n_features: int, trials: int) -> Iterator[tuple]:
    """``(number, bins, y, weight, val, ids, scores)``."""
    for row in batch.to_pylist():
        n = row["rows"]
        of = lambda name, kind, shape, row=row: np.frombuffer(row[name], kind).reshape(shape)
        yield row["block"], of("bins", np.uint8, (n, n_features)), of("y", np.uint8, n), of("weight", float, n), of("val", np.uint8, n) > 0, of("ids", np.uint64, n), of("scores", float, (trials, n)).copy()


def _add_trees(scores: np.ndarray, bins: np.ndarray, trees: Sequence[Tree]) -> None:
    for t in trees:
        scores += np.array(t.value)[t.nodes_of(bins)]


def _pass(batches: Iterator[pa.RecordBatch], n_features: int, trials: int, wants: dict[int, tuple[Request, list[Tree]]], grain: float) -> Iterator[pa.RecordBatch]:
    """Histograms of all candidates' open nodes, added up over the task's blocks; node -1 holds the validation loss."""
    sums: dict[tuple[int, int, int], np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        k, node, f = zip(*sums, strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(node, pa.int32()), pa.array(f, pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["trial", "leaf", "feature", "cells"])
        sums.clear()
        return out

    for batch in batches:
        for _, bins, y, weight, val, ids, scores in _read_blocks(batch, n_features, trials):
            for k, (want, later) in wants.items():
                _add_trees(scores[k], bins, later)
                for node, f, cells in histograms(bins, y, weight, ~val, ids, scores[k], want, grain):
                    sums[k, node, f] = sums[k, node, f] + cells if (k, node, f) in sums else cells
                if want.loss:
                    sums[k, -1, -1] = sums.get((k, -1, -1), np.zeros(2)) + np.array([log_loss(y[val], scores[k][val]), val.sum()])
            if len(sums) > 8000:
                yield flush()
    if sums:
        yield flush()


def _rescore(batches: Iterator[pa.RecordBatch], n_features: int, trials: int, later: dict[int, list[Tree]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, bins, y, weight, val, ids, scores in _read_blocks(batch, n_features, trials):
            for k, trees in later.items():
                _add_trees(scores[k], bins, trees)
            yield _block_row(number, len(y), [x.tobytes() for x in (bins, y, weight, val.astype(np.uint8), ids, scores)])


def _cuts(table: pa.Table, params: Sequence[Params]) -> pa.Table:
    """The best cut of each feature of one node from the histograms of all tasks."""
    k, node = table["trial"][0].as_py(), table["leaf"][0].as_py()
    feature, cells = table["feature"].to_numpy(), table["cells"].to_pylist()
    rows = []
    for f in np.unique(feature):
        whole = sum(np.frombuffer(cells[i], float) for i in np.flatnonzero(feature == f))
        found = best_cut(whole.reshape(3, -1), params[k]) if node >= 0 else (whole[0], 0, 0.0, 0.0, whole[1], 0.0, 0.0, 0.0)
        rows.append((k, node, int(f), *found))
    names = [c.split()[0] for c in CUT.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32()] + [pa.float64()] * 6
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _fit_here(table: pa.Table, n_features: int, params: Sequence[Params], patience: int | None, forecast: list | None = None) -> tuple[int, list[Tree], list[float]]:
    """A candidate grown on all blocks in one task; ``forecast`` is told the validation rows' labels and scores by its trees."""
    k = table["trial"][0].as_py()
    table = table.drop_columns(["trial"]).sort_by("block")  # one order, whatever the order of arrival
    blocks = [b[1:] for b in _read_blocks(table, n_features, 1)]
    bins, y, weight, val, ids = (np.concatenate([b[i] for b in blocks]) for i in range(5))
    order, n = np.argsort(val, kind="stable"), int((~val).sum())  # rows to learn from come first
    bins, y, weight, ids, score = bins[order], y[order], weight[order], ids[order], np.concatenate([b[5][0] for b in blocks])[order]
    grain, everything, best = grain_of(float(weight[:n].sum())), np.arange(len(y)), (math.inf, score[n:].copy())
    run, held = grow(params[k], n_features, patience, ahead=False), Held([np.ascontiguousarray(c) for c in bins.T])
    want = next(run)
    while True:
        if want.open == [0]:  # a tree begins
            if want.trees:
                held.add_leaves(score, want.trees[-1])
            bag = drawn(ids[:n], params[k], want.round)
            rest = np.concatenate([everything[:n].compress(~bag), everything[n:]])
            held.begin(everything[:n].compress(bag), rest, *slopes(y[:n], weight[:n], score[:n], grain))
        cuts = held.cuts(want)
        loss = log_loss(y[n:], score[n:]) / max(len(y) - n, 1) if want.loss else None
        if want.loss and want.trees and loss < best[0]:
            best = loss, score[n:].copy()
        try:
            want = run.send((cuts, loss))
        except StopIteration as end:
            if forecast is not None:
                forecast += [y[n:], score[n:] if patience is None else best[1]]
            return k, *end.value


class Held:
    """The rows of each node of a tree under way: those that it is grown on and the others, in their order in the table. Nodes of
    ``2 * (BINS + 1)`` rows or more also keep their histograms until they are split, no more than a few numbers a cell in all."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns  # bins of each feature

    def begin(self, bag: np.ndarray, others: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        self.rows, self.kept, self.g, self.h = {0: (bag, others)}, {}, g, h

    def part(self, tree: Tree, node: int) -> None:
        """Deals a node's rows to its children."""
        column, pairs = self.columns[tree.feature[node]], []
        for rows in self.rows.pop(node):
            low = column.take(rows) <= tree.bin[node]
            pairs.append((rows.compress(low), rows.compress(~low)))
        self.rows[tree.left[node]], self.rows[tree.right[node]] = zip(*pairs, strict=True)

    def sums(self, node: int, features: list[int]) -> np.ndarray:
        """A node's histograms, added up from its rows."""
        rows, cells = self.rows[node][0], np.empty((len(features), 3, BINS + 1))
        g, h = self.g.take(rows), self.h.take(rows)
        for j, f in enumerate(features):
            cell = self.columns[f].take(rows).astype(np.intp)
            cells[j] = np.bincount(cell, g, BINS + 1), np.bincount(cell, h, BINS + 1), np.bincount(cell, minlength=BINS + 1)
        return cells

    def cuts(self, want: Request) -> dict[tuple[int, int], tuple]:
        """Cuts of the open nodes (the root, or the two children of one node) that have rows enough for one."""
        above = None
        if want.open[0]:
            parent = want.tree.left.index(want.open[0])
            self.part(want.tree, parent)
            above = self.kept.pop(parent, None)
        size = {n: len(self.rows[n][0]) for n in want.open}
        nodes = [n for n in want.open if size[n] >= 2 * max(want.params.min_child_samples, 1)]
        if not nodes:
            return {}
        if above is None:
            cells = {n: self.sums(n, want.features) for n in nodes}
        else:
            less, more = sorted(want.open, key=size.get)
            cells = {less: self.sums(less, want.features)}
            cells[more] = above - cells[less]
        self.kept |= {n: cells[n] for n in nodes if size[n] >= 2 * (BINS + 1)}
        found = best_cuts(np.concatenate([cells[n] for n in nodes]), want.params)
        return dict(zip([(n, f) for n in nodes for f in want.features], found, strict=True))

    def add_leaves(self, score: np.ndarray, tree: Tree) -> None:
        """Adds the values of the finished tree's leaves to the scores of the rows that they hold."""
        for node, f in enumerate(tree.feature):
            if f >= 0 and node in self.rows:
                self.part(tree, node)
            if f < 0:
                for rows in self.rows[node]:
                    score[rows] += tree.value[node]


def _each_apart(table: DataFrame, trials: int) -> DataFrame:
    """The table once for each candidate, each in a task of its own: dealt by a hash, several would share one."""
    return table.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).repartitionByRange(trials, "trial")


def _fit_by_passes(table: DataFrame, n_features: int, params: Sequence[Params], patience: int | None, grain: float) -> tuple[list[tuple[list[Tree], list[float]]], DataFrame]:
    """All candidates' trees and losses, and the table as it was stored last."""
    spark, trials = table.sparkSession, len(params)
    runs = {k: grow(p, n_features, patience) for k, p in enumerate(params)}
    wants = {k: next(r) for k, r in runs.items()}
    stored, out = dict.fromkeys(runs, 0), {}
    while wants:
        sent = {k: (replace(w, trees=[]), w.trees[stored[k] :]) for k, w in wants.items()}

        def one_pass(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return _pass(batches, n_features, trials, sent, grain)

        def cuts(part: pa.Table) -> pa.Table:
            return _cuts(part, params)

        rows = table.mapInArrow(one_pass, HIST).groupBy("trial", "leaf").applyInArrow(cuts, CUT).collect()  # a row a leaf and feature
        answers: dict[int, dict] = {k: {} for k in wants}
        losses = {r["trial"]: r["gain"] / max(r["n"], 1) for r in rows if r["leaf"] < 0}
        for r in rows:
            if r["leaf"] >= 0:
                answers[r["trial"]][r["leaf"], r["feature"]] = tuple(r)[3:]
        for k in list(wants):
            try:
                wants[k] = runs[k].send((answers[k], losses.get(k)))
            except StopIteration as end:
                out[k] = end.value
                del wants[k]
        if any(len(w.trees) - stored[k] >= STORE_EVERY for k, w in wants.items()):
            later = {k: w.trees[stored[k] :] for k, w in wants.items()}

            def rescore(batches: Iterator[pa.RecordBatch], later=later) -> Iterator[pa.RecordBatch]:
                return _rescore(batches, n_features, trials, later)

            before, table = table, materialise(table.mapInArrow(rescore, BLOCK), "boosted")
            forget(spark, before)
            stored |= {k: len(w.trees) for k, w in wants.items()}
    return [out[k] for k in range(trials)], table


def _forecast(batches: Iterator[pa.RecordBatch], n_features: int, trials: int, start: float, grown: Sequence[Sequence[Tree]]) -> Iterator[pa.RecordBatch]:
    """``FORECAST`` of the validation rows of blocks by all candidates."""
    for batch in batches:
        for _, bins, y, _, val, *_ in _read_blocks(batch, n_features, trials):
            bins, y = bins[val], y[val]
            for k, trees in enumerate(grown):
                score = np.full(len(y), start)
                _add_trees(score, bins, trees)
                yield from _forecast_rows(k, y, score).to_batches()


def _forecast_rows(k: int, y: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"trial": pa.array(np.full(len(y), k), pa.int32()), "y_true": pa.array(y, pa.int32()), "prob": pa.array(1 / (1 + np.exp(-score)), pa.float64())})


def fit_leafwise(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    candidates: Sequence[Params],
    weight: str | None = None,
    split: str = "split",
    patience: int | None = None,
    forecasts: list[DataFrame] | None = None,
    ids: Sequence[str] = (),
    sample_rows: int = 200_000,
    small_cells: int = SMALL_CELLS,
) -> list[Model]:
    """One model for each candidate, from the rows of split ``train`` (with ``patience`` stopped by those of ``val``).

    Features are numbers without nulls; rows without a label go. Rows are drawn for bags by the hash of the columns ``ids``,
    or of all features. ``sample_rows`` bounds the rows that bin edges are taken from. The first score is the weighted log
    odds of the training labels.

    To a list ``forecasts`` is added a table of what each model (``trial``, by its number) forecasts of the rows of ``val`` that
    stopped it: ``(trial, y_true, prob)``. A candidate that grows in one task knows their scores from its growth, so no row walks
    through the trees again.
    """
    columns, trials, spark = list(features), len(candidates), df.sparkSession
    y, w, v, at = fresh(columns, "y", "weight", "val", "at")
    kept = df.where(F.col(label).isNotNull() & F.col(split).isin("train", "val") if patience is not None else F.col(label).isNotNull() & (F.col(split) == "train"))
    rows = kept.select(
        *[F.col(f).cast("double").alias(f) for f in columns], F.col(label).cast("int").alias(y), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias(w),
        (F.col(split) == "val").alias(v), F.xxhash64(*(ids or columns)).alias(at),
    )
    rows = materialise(rows, "rows")
    train = rows.where(~F.col(v))
    total = train.agg(F.count("*").alias("n"), F.coalesce(F.sum(w), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.col(w) * F.col(y)), F.lit(0.0)).alias("p")).first()
    rate = min(max(total["p"] / total["w"], 1e-15), 1 - 1e-15) if total["w"] else 0.5
    start, edges = math.log(rate / (1 - rate)), bin_edges(train, columns, sample_rows)
    small = rows.count() * len(columns) <= small_cells

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, len(columns), edges, start, 1 if small else trials)

    table = materialise(rows.mapInArrow(blocks, BLOCK), "blocks")
    forget(spark, rows)
    validated = forecasts is not None
    if small:
        turns = sorted(range(trials), key=lambda k: (candidates[k].learning_rate, -candidates[k].num_leaves))  # those that take longest start first
        ordered = [candidates[k] for k in turns]

        def fit(part: pa.Table) -> pa.Table:
            seen = [] if validated else None
            k, trees, losses = _fit_here(part, len(columns), ordered, patience, seen)
            model = pa.table({"trial": pa.array([turns[k]], pa.int32()), "model": pa.array([pickle.dumps((trees, losses))], pa.binary())})
            return pa.concat_tables([model, _forecast_rows(turns[k], *seen)] if validated else [model], promote_options="default").select(names)

        names = ["trial", "model", "y_true", "prob"] if validated else ["trial", "model"]
        found = _each_apart(table, trials).groupBy("trial").applyInArrow(fit, "trial int, model binary" + (", y_true int, prob double" if validated else ""))
        if validated:
            found = materialise(found, "grown")
            forecasts.append(found.where("model is null").select("trial", "y_true", "prob"))
        grown = {r["trial"]: pickle.loads(r["model"]) for r in found.where("model is not null").select("trial", "model").collect()}  # a row a candidate
        fitted = [grown.get(k, ([], [])) for k in range(trials)]
    else:
        fitted, table = _fit_by_passes(table, len(columns), candidates, patience, grain_of(total["w"]))
        if validated:
            trees = [f[0] for f in fitted]

            def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                return _forecast(batches, len(columns), trials, start, trees)

            forecasts.append(materialise(table.mapInArrow(forecast, FORECAST), "forecasts"))
    forget(spark, table)
    return [Model(columns, edges, start, trees, p, losses) for (trees, losses), p in zip(fitted, candidates, strict=True)]


def search_draws(trials: int, seed: int = 42, rounds: int = 4000) -> list[Params]:
    """Seeded draws of the nine parameters of ``SEARCH``."""
    draw = Random(seed)
    return [Params(n_estimators=rounds, seed=seed + t + 1, **{name: draw.choice(values) for name, values in SEARCH.items()}) for t in range(trials)]
