"""Leaf-wise boosting against plain trees grown on rows, by both ways of running it, and its stopping rule."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B
from tidemark.operators import models


def rows_like(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.randrange(12), rng.random()
        y = int(rng.random() < 1 / (1 + math.exp(-(2 * a * (b > 5) - 1 + c))))
        out.append((i, a, float(b), c, y, ["train", "train", "val", "test"][i % 4], 1.0 + (i % 3)))
    return out


SCHEMA = "id long, a double, b double, c double, label int, split string, weight double"
FEATURES = ["a", "b", "c"]


def plain_fit(rows, params, edges, start, weighted):
    """Best-first trees straight from rows: every leaf's best cut is searched over all rows in it."""
    train = [r for r in rows if r[5] == "train"]
    bins = [[sum(e < r[1 + f] for e in edges[f]) for f in range(3)] for r in train]
    y, w, score, trees = [r[4] for r in train], [r[6] if weighted else 1.0 for r in train], [start] * len(train), []
    for t in range(params.n_estimators):
        features = sorted(random.Random(params.seed * 7919 + t).sample(range(3), max(1, round(params.colsample_bytree * 3))))
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [a * (q - b) for a, q, b in zip(w, p, y)], [a * q * (1 - q) for a, q in zip(w, p)]

        def worth(i):
            a = max(abs(sum(g[k] for k in i)) - params.reg_alpha, 0)
            return a * a / max(sum(h[k] for k in i) + params.reg_lambda, 1e-300)

        def cut(i):
            best = (1e-9, None)
            for f in features:
                for at in range(255):
                    left, right = [k for k in i if bins[k][f] <= at], [k for k in i if bins[k][f] > at]
                    if min(len(left), len(right)) >= params.min_child_samples and min(sum(h[k] for k in x) for x in (left, right)) >= 1e-3:
                        gain = worth(left) + worth(right) - worth(i)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, at, left, right))
            return best

        leaves = [(list(range(len(train))), 0, 0)]  # rows, depth, number
        known = {0: cut(leaves[0][0])}
        while len(leaves) < params.num_leaves:
            open_ = [(known[m][0], -m, (i, d, m)) for i, d, m in leaves if known[m][1] and (params.max_depth < 1 or d < params.max_depth)]
            if not open_:
                break
            leaf = max(open_, key=lambda x: x[:2])[2]
            leaves.remove(leaf)
            for part in known[leaf[2]][1][2:]:
                known[len(known)] = cut(part)
                leaves.append((part, leaf[1] + 1, len(known) - 1))
        if len(leaves) == 1:
            break
        for leaf in leaves:
            i = leaf[0]
            a = sum(g[k] for k in i)
            value = -math.copysign(max(abs(a) - params.reg_alpha, 0), a) / (sum(h[k] for k in i) + params.reg_lambda) * params.learning_rate
            for k in i:
                score[k] += value
        trees.append(len(leaves))
    return score, trees


@pytest.mark.parametrize("small", [10**9, 0])
@pytest.mark.parametrize(
    "params, weight",
    [
        (B.Params(n_estimators=4, num_leaves=6, min_child_samples=10), None),
        (B.Params(n_estimators=3, num_leaves=9, min_child_samples=5, reg_lambda=1.0, reg_alpha=0.5, colsample_bytree=0.7, max_depth=3), "weight"),
    ],
)
def test_trees_equal_plain_best_first_growth(spark, monkeypatch, small, params, weight):
    monkeypatch.setattr(B, "BLOCK_ROWS", 37)
    monkeypatch.setattr(B, "STORE_EVERY", 2)
    rows = rows_like(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    (model,) = B.fit_leafwise(df, FEATURES, "label", [params], weight, small_cells=small)
    score, leaves = plain_fit(rows, params, model.edges, model.start, bool(weight))
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == leaves and len(leaves) == params.n_estimators
    train = np.array([r[1:4] for r in rows if r[5] == "train"])
    assert np.allclose(model.scores(B.binned(train, model.edges)), score, atol=1e-9)
    got = {r.id: r.p for r in df.select("id", model.probability().alias("p")).collect()}
    want = [1 / (1 + math.exp(-s)) for s in score]
    assert np.allclose([got[r[0]] for r in rows if r[5] == "train"], want, atol=1e-9)


def test_both_ways_give_the_same_models_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(B, "STORE_EVERY", 3)
    df = spark.createDataFrame(rows_like(2, 600), SCHEMA).repartition(4)
    tried = [B.Params(n_estimators=7, num_leaves=5, min_child_samples=9, subsample=0.7, subsample_freq=1, seed=3), B.Params(n_estimators=5, num_leaves=8, colsample_bytree=0.7)]
    here = B.fit_leafwise(df, FEATURES, "label", tried, patience=3, ids=["id"])
    apart = B.fit_leafwise(df, FEATURES, "label", tried, patience=3, ids=["id"], small_cells=0)
    for a, b in zip(here, apart, strict=True):
        assert [t.feature for t in a.trees] == [t.feature for t in b.trees] and [t.bin for t in a.trees] == [t.bin for t in b.trees]
        assert np.allclose(a.losses, b.losses) and a.importances()[0][1] == b.importances()[0][1]
    assert len(here[0].losses) <= 8


def test_patience_cuts_back_to_the_lowest_validation_loss(spark):
    rows = rows_like(4, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    (model,) = B.fit_leafwise(df, FEATURES, "label", [B.Params(n_estimators=300, num_leaves=8, min_child_samples=5, learning_rate=0.3)], patience=10)
    best = int(np.argmin(model.losses[1:])) + 1
    assert len(model.trees) == best and len(model.losses) - 1 == best + 10 < 300
    val = np.array([r[1:4] for r in rows if r[5] == "val"])
    y = np.array([r[4] for r in rows if r[5] == "val"])
    s = model.scores(B.binned(val, model.edges))
    assert math.isclose(np.logaddexp(0, np.where(y > 0, -s, s)).mean(), model.losses[best], rel_tol=1e-9)


def test_awkward_tables(spark):
    assert B.fit_leafwise(spark.createDataFrame([], SCHEMA), FEATURES, "label", [B.Params()])[0].trees == []
    rows = [(i, 1.0, 2.0, 3.0, i % 2, "train", 1.0) for i in range(100)] + [(7, 1.0, 2.0, 3.0, None, "train", 1.0)]
    (model,) = B.fit_leafwise(spark.createDataFrame(rows, SCHEMA), FEATURES, "label", [B.Params()])  # nothing to cut
    assert model.trees == [] and abs(model.start) < 1e-12
    one = [(i, float(i), 2.0, 3.0, 1, "train", 1.0) for i in range(60)]
    assert B.fit_leafwise(spark.createDataFrame(one, SCHEMA), FEATURES, "label", [B.Params()])[0].trees == []


def test_no_row_of_the_table_reaches_the_driver(spark, monkeypatch):
    """What the passes collect is a row for each leaf and feature, however many rows there are."""
    seen = []
    real = B._cuts
    monkeypatch.setattr(B, "_cuts", real)
    df = spark.range(30_000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"), (F.rand(4) < F.rand(1)).cast("int").alias("label"), F.lit("train").alias("split"))
    frame = type(df)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    B.fit_leafwise(df, FEATURES, "label", [B.Params(n_estimators=2, num_leaves=4)], small_cells=0)
    assert seen and max(len(x) for x in seen) <= 4 * 3


def test_searches_choose_and_count_splits(spark):
    df = spark.createDataFrame(rows_like(5, 500), SCHEMA)
    choice, model, out = models.leafwise_grid(df, FEATURES, "label", [{"n_estimators": 5, "min_child_samples": 400}, {"n_estimators": 20, "num_leaves": 6}])
    assert choice["num_leaves"] == 6 and {r.split for r in models.metrics_of(out).collect()} == {"train", "val", "test"}
    table = {r.feature: r for r in models.tree_importances(spark, model).collect()}
    assert sum(r.split_importance for r in table.values()) == sum(sum(f >= 0 for f in t.feature) for t in model.trees)
    assert math.isclose(sum(r.gain_share for r in table.values()), 1.0) and table["a"].gain_share > table["c"].gain_share
    choice, model, _ = models.tuned_trees(df, FEATURES, "label", trials=3, patience=5, rounds=60)
    assert set(B.SEARCH) <= set(choice) and choice["best_iteration"] == len(model.trees)
    assert B.search_draws(4) == B.search_draws(4) and len({str(p) for p in B.search_draws(4)}) == 4


@pytest.mark.parametrize("neighbours", [3, None])
def test_importance_is_made_of_all_four_parts(spark, neighbours):
    from tidemark.operators import ranking
    from tidemark.operators.neighbours import neighbour_information

    df = spark.createDataFrame(rows_like(6, 500), SCHEMA).withColumn("c", F.when(F.col("id") % 7 != 0, F.col("c")))
    trees = {"n_estimators": 6, "num_leaves": 5}
    got = {r.feature: r for r in models.feature_importance(df, FEATURES, "label", trees=trees, neighbours=neighbours).collect()}
    train = df.where("split = 'train'")
    ready = models.class_weights(models.impute_and_scale(train, FEATURES, scale=False), "label", "ratio")
    (model,) = B.fit_leafwise(ready, FEATURES, "label", [B.Params(**trees)], "weight")
    splits = {f: (n, g) for f, n, g in model.importances()}
    rank = {r.feature: r.abs_spearman for r in ranking.abs_spearman(train, FEATURES, "label").collect()}
    mi = neighbour_information(ranking.stacked(ready, FEATURES, "label"), ["feature"], "x", "y") if neighbours else ranking.quantile_mutual_information(ready, FEATURES, "label")
    mi = {r.feature: r.mutual_info for r in mi.collect()}
    top = lambda d: max(d.values()) or 1.0
    for f in FEATURES:
        r = got[f]
        assert (r.split_importance, r.gain_importance) == pytest.approx(splits[f]) and r.abs_spearman == pytest.approx(rank[f]) and r.mutual_info == pytest.approx(mi[f])
        parts = [0.20 * mi[f] / top(mi), 0.15 * rank[f] / top(rank), 0.20 * splits[f][0] / max(n for n, _ in splits.values()), 0.45 * splits[f][1] / max(g for _, g in splits.values())]
        assert r.importance_score == pytest.approx(sum(parts)) and r.train_rows_used == train.count()


def test_growth_in_a_task_touches_only_the_rows_of_the_leaf_that_is_cut(monkeypatch):
    """The root's rows once a tree, and then those of the two new leaves; never all rows for each split."""
    rng, n, leaves, rounds = np.random.default_rng(1), 4000, 32, 3
    bins = rng.integers(0, 200, (n, 3)).astype(np.uint8)
    y, ids = (rng.random(n) < bins[:, 0] / 200).astype(np.uint8), rng.integers(0, 2**60, n)
    cells = [bins, y, np.ones(n), (np.arange(n) % 4 == 0).astype(np.uint8), ids, np.zeros((1, n))]
    row = B._block_row(0, n, [c.tobytes() for c in cells])
    table = pa.Table.from_batches([row]).append_column("trial", pa.array([0], pa.int32()))
    read, walked, count, walk = [], [], np.bincount, B.Tree.nodes_of
    monkeypatch.setattr(B.np, "bincount", lambda x, *rest, **more: read.append(len(x)) or count(x, *rest, **more))
    monkeypatch.setattr(B.Tree, "nodes_of", lambda self, rows: walked.append(len(rows)) or walk(self, rows))
    _, trees, losses = B._fit_here(table, 3, [B.Params(n_estimators=rounds, num_leaves=leaves, min_child_samples=20)], 5)
    assert [sum(f < 0 for f in t.feature) for t in trees] == [leaves] * rounds and len(losses) == rounds + 1
    assert sum(walked) <= n * rounds
    assert sum(read) < 9 * (rounds + 1) * n * 12  # three sums of three features at each of some twelve depths


@pytest.mark.parametrize("trials, blocks", [(3, 1), (20, 1), (20, 61)])
def test_each_candidate_grows_in_a_task_of_its_own(spark, trials, blocks):
    table = spark.range(blocks).withColumnRenamed("id", "block")
    spots = B._each_apart(table, trials).withColumn("at", F.spark_partition_id()).groupBy("trial").agg(F.collect_set("at").alias("at"), F.count("*").alias("n")).collect()
    assert len({r.at[0] for r in spots}) == trials and {(len(r.at), r.n) for r in spots} == {(1, blocks)}


def held_table(order, cuts, n=6000, skew=170):
    """Blocks of the same rows, in some order and cut at some places; a cut far to one side parts the labels best."""
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 200, (n, 3)).astype(np.uint8)
    y, ids = (rng.random(n) < np.where(bins[:, 0] > skew, 0.8, 0.1) + bins[:, 1] / 2000).astype(np.uint8), np.arange(n) * 7919
    weight, val = 0.3 + rng.random(n), (np.arange(n) % 4 == 0).astype(np.uint8)
    rows = []
    for i, part in enumerate(np.split(order(n), cuts)):
        cells = [bins[part], y[part], weight[part], val[part], ids[part], np.zeros((1, len(part)))]
        rows.append(B._block_row(i, len(part), [np.ascontiguousarray(c).tobytes() for c in cells]))
    return pa.Table.from_batches(rows).append_column("trial", pa.array([0] * len(rows), pa.int32()))


def test_only_the_smaller_child_of_a_large_node_is_added_up(monkeypatch):
    table, read, count = held_table(np.arange, []), [], np.bincount
    monkeypatch.setattr(B.np, "bincount", lambda x, *rest, **more: read.append(len(x)) or count(x, *rest, **more))
    _, trees, _ = B._fit_here(table, 3, [B.Params(n_estimators=1, num_leaves=12)], None)
    train = 6000 * 3 // 4
    assert trees[0].feature[0] == 0 and abs(trees[0].bin[0] - 170) < 9 and read.count(train) == 18  # the root, and that of the tree which is not grown
    assert max(x for x in read if x < train) <= train / 2


@pytest.mark.parametrize("params", [B.Params(n_estimators=12, num_leaves=20, reg_alpha=0.1), B.Params(n_estimators=9, num_leaves=31, min_child_samples=3, subsample=0.7, subsample_freq=1, max_depth=6)])
def test_the_order_of_rows_and_the_cut_of_blocks_do_not_change_a_bit_of_a_tree(params):
    one = B._fit_here(held_table(np.arange, []), 3, [params], 5)[1]
    other = B._fit_here(held_table(np.random.default_rng(9).permutation, [100, 1500, 1501]), 3, [params], 5)[1]
    assert len(one) > 2 and one == other


def test_cuts_of_equal_gain_go_to_the_first_feature():
    """Feature 2 parts the same rows as feature 0, in bins of other numbers."""
    table = held_table(np.arange, []).to_pylist()[0]
    bins = np.frombuffer(table["bins"], np.uint8).reshape(-1, 3).copy()
    bins[:, 2] = bins[:, 0] + 40
    row = B._block_row(0, len(bins), [bins.tobytes(), *[table[c] for c in ("y", "weight", "val", "ids", "scores")]])
    _, trees, _ = B._fit_here(pa.Table.from_batches([row]).append_column("trial", pa.array([0], pa.int32())), 3, [B.Params(n_estimators=25, num_leaves=31, min_child_samples=5)], None)
    assert len(trees) == 25 and not any(2 in t.feature for t in trees) and any(1 in t.feature for t in trees)


@pytest.mark.parametrize("small", [10**9, 0])
def test_forecasts_of_validation_rows_are_those_of_the_models(spark, monkeypatch, small):
    monkeypatch.setattr(B, "STORE_EVERY", 3)
    rows = [*rows_like(7, 500), (900, 0.1, 3.0, 0.5, None, "val", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tried = [B.Params(n_estimators=9, num_leaves=4, learning_rate=0.3), B.Params(n_estimators=6, num_leaves=7, min_child_samples=10), B.Params(n_estimators=5, min_child_samples=400)]
    forecasts = []
    models_ = B.fit_leafwise(df, FEATURES, "label", tried, patience=2, forecasts=forecasts, small_cells=small)
    assert [m.params for m in models_] == tried and not models_[2].trees and len(models_[0].trees) < len(models_[0].losses) - 1
    val = df.where("split = 'val' and label is not null")
    for k, m in enumerate(models_):
        want = sorted((r.label, r.p) for r in val.select("label", m.probability().alias("p")).collect())
        assert sorted((r.y_true, r.prob) for r in forecasts[0].where(F.col("trial") == k).collect()) == want and len(want) == 125


def test_search_without_rows_to_learn_from_or_to_validate_on(spark):
    rows = rows_like(8, 200)
    for kept in ("train", "val", "test"):
        df = spark.createDataFrame([r for r in rows if r[5] == kept], SCHEMA)
        choice, _, out = models.tuned_trees(df, FEATURES, "label", trials=2, patience=2, rounds=5)
        assert out.count() == df.count() and choice["threshold"] is not None
