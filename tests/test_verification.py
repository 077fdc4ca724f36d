"""Splits, metrics, ranking, models and reports on small frames."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, models, ranking, splits

SCHEMA = "g string, y_true int, y_prob double, y_pred int"


def sample(n=200, seed=2):
    r = random.Random(seed)
    return [(r.choice("ab"), int(r.random() < 0.3), round(r.random(), 1), int(r.random() < 0.4)) for _ in range(n)] + [("one", 1, 0.4, 0), ("one", 1, 0.6, 1)]


def plain_ranks(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    if not pos or not neg:
        return None, None
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    ap, last = 0.0, 0.0
    for s in sorted({p for _, p in rows}, reverse=True):
        tp, fp = sum(p >= s for p in pos), sum(q >= s for q in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    return ap, auc


def test_ranking_metrics(spark):
    rows = sample()
    got = {r.g: r for r in metrics.ranking_metrics(spark.createDataFrame(rows, SCHEMA), ["g"]).collect()}
    for g in ("a", "b", "one"):
        ap, auc = plain_ranks([(y, p) for k, y, p, _ in rows if k == g])
        assert got[g].pr_auc == pytest.approx(ap) and got[g].roc_auc == pytest.approx(auc) if ap is not None else got[g].pr_auc is None and got[g].roc_auc is None


def test_confusion_with_zero_denominators(spark):
    r = metrics.confusion_metrics(spark.createDataFrame([("a", 1, 0.1, 0), ("a", 1, 0.2, 0)], SCHEMA)).first()
    assert (r.tp, r.fn, r.precision, r.recall, r.f1, r.f2, r.hss, r.balanced_accuracy) == (0, 2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    r = metrics.confusion_metrics(spark.createDataFrame([("a", 0, 0.1, 0)], SCHEMA)).first()
    assert (r.tn, r.hss, r.balanced_accuracy) == (1, None, 1.0)


def test_threshold_scan_and_choice(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    for r in metrics.threshold_scan(df, ["g"]).collect():
        mine = [(y, p) for g, y, p, _ in rows if g == r.g]
        assert r.tp == sum(y and p >= r.threshold for y, p in mine) and r.fp == sum((not y) and p >= r.threshold for y, p in mine) and r.tp + r.fp + r.fn + r.tn == len(mine)
    tie = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 0, 0.1, 0)], SCHEMA)
    assert metrics.select_threshold(tie).first().threshold == 0.15
    assert sorted(r.threshold for r in metrics.infer_threshold(spark.createDataFrame([("n", 0, 0.3, 0), ("p", 1, 0.4, 1), ("o", 1, 0.2, 1), ("o", 0, 0.6, 0), ("s", 1, 0.7, 1), ("s", 1, 0.1, 0)], SCHEMA), ["g"]).collect()) == [0.4, 0.4, 0.7, 1.0]


def test_long_pivot_difference_and_missing(spark):
    rows = [(m, *r) for m in ("x", "y") for r in sample(seed=3 if m == "x" else 4)]
    long = metrics.metrics_long(spark.createDataFrame(rows, f"model string, {SCHEMA}"), ["model", "g"], min_rows=5, min_positives=1)
    assert {r.g for r in long.collect()} == {"a", "b"}
    wide = metrics.pivot_metrics(long, ["g"], ["model"], ["f2"], [["x"], ["y"]]).orderBy("g").collect()
    diff = metrics.model_difference(long, ["g"], "f2", "x", "y").orderBy("g").collect()
    assert [r.f2_diff for r in diff] == pytest.approx([r.f2__x - r.f2__y for r in wide])
    assert metrics.model_difference(long, ["g"], "f2", "x", "zz").count() == 0
    want = spark.createDataFrame([("x", "a"), ("z", "a")], "model string, g string")
    assert [tuple(r) for r in metrics.missing_predictions(want, long, ["model", "g"]).collect()] == [("z", "a")]


def test_normalise_predictions(spark):
    df = spark.createDataFrame([(1, 1.5, 1), (None, None, None)], "target int, y_prob double, y_pred int")
    assert [tuple(r) for r in metrics.normalise_predictions(df, "target").collect()] == [(1, 1.0, 1), (0, 0.0, 0)]
    with pytest.raises(ValueError, match="y_pred"):
        metrics.normalise_predictions(df.drop("y_pred"), "target")
    with pytest.raises(ValueError, match="holds"):
        metrics.check_binary(spark.createDataFrame([(2,)], "y int"), "y")


def test_robust_ranges(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (float("inf"),), (float("nan"),), (None,)], "v double")
    assert [round(x, 6) for x in metrics.robust_range(df, "v", "brier").first()] == [0.49, 0.51]
    assert [round(x, 6) for x in metrics.robust_range(df, "v", "f2").first()] == [0.49, 0.51]
    assert [round(x, 6) for x in metrics.robust_range(df, "v", "hss").first()] == [-0.5, 0.5]
    assert tuple(metrics.robust_range(df.where("false"), "v", "f2").first()) == (None, None)


@pytest.mark.parametrize(("years", "want"), [([2001], {2001: "train"}), ([2002, 2001], {2001: "train", 2002: "test"}), ([1, 2, 3, 4], {1: "train", 2: "train", 3: "val", 4: "test"}), ([], {})])
def test_year_splits(years, want):
    assert splits.year_splits(years) == want


def test_split_report(spark):
    day = lambda d: datetime(2024, 1, d)
    df = spark.createDataFrame([(day(1), 1), (day(5), 0), (day(9), 1), (day(30), 1)], "t timestamp, y int")
    rows = splits.split_by_dates(df, "t", {"train": ("2024-01-01", "2024-01-05"), "test": ("2024-01-05", "2024-01-09")})
    assert sorted((r.t.day, r.split) for r in rows.collect()) == [(1, "train"), (5, "train"), (9, "test")]
    assert [r.status for r in splits.split_report(rows, "t").orderBy("place").collect()] == ["pass", "warn", "pass"]
    wrong = splits.split_by_dates(df, "t", {"test": ("2024-01-01", "2024-01-05"), "train": ("2024-01-06", "2024-01-09")})
    with pytest.raises(ValueError, match="out of order"):
        splits.check_splits(wrong, "t")
    task = splits.task_summary(rows.withColumn("s", F.lit(1)), ["y"], "s", "t").orderBy("split").collect()
    assert [(r.split, r.rows, r.stations) for r in task] == [("test", 1, 1), ("train", 2, 1), ("val", 0, 0)]


def test_feature_columns_leave_out_leaks(spark):
    df = spark.sql("select 1 as id, 2.0 as speed, true as ok, 'x' as name, 1 as target_a, 3 as speed_future, 4 as t_plus_1")
    assert splits.feature_columns(df, ["id"]) == ["speed", "ok"]
    a = [r.id for r in splits.seeded_sample(spark.range(100).repartition(7), ["id"], 10).collect()]
    assert a == [r.id for r in splits.seeded_sample(spark.range(100).repartition(3), ["id"], 10).collect()] and len(a) == 10


def test_spearman_and_information(spark):
    r = random.Random(5)
    rows = [("a", float(i), float(i) ** 3) for i in range(20)] + [("flat", 1.0, float(i)) for i in range(20)] + [("few", 1.0, 2.0)] + [("t", float(r.randrange(5)), float(r.randrange(4))) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r.spearman for r in ranking.spearman(df, ["g"], "x", "y").collect()}
    import pandas as pd

    t = pd.DataFrame([x[1:] for x in rows if x[0] == "t"]).rank()
    assert got["a"] == pytest.approx(1) and got["flat"] is None and got["few"] is None and got["t"] == pytest.approx(t[0].corr(t[1]))
    same = spark.createDataFrame([(0.0, 0), (1.0, 1)] * 5, "x double, y int")
    assert ranking.binned_mutual_information(same, [], "x", "y", [0.5]).first()[0] == pytest.approx(0.693147, abs=1e-5)


def test_importance(spark):
    f = spark.createDataFrame([("a",), ("b",)], "feature string")
    t = [spark.createDataFrame([("a", 2.0), ("b", 1.0)], f"feature string, {c} double") for c in ("mutual_info", "abs_spearman", "split_importance")] + [spark.createDataFrame([("b", 0.0)], "feature string, gain_importance double")]
    got = {r.feature: r.importance_score for r in ranking.importance_ensemble(t, f).collect()}
    assert got == {"a": pytest.approx(0.55), "b": pytest.approx(0.275)}


def test_baselines_and_estimators(spark):
    r = random.Random(6)
    rows = [(i, ("train", "val", "test")[min(2, i // 200)], x := r.gauss(0, 1), r.gauss(0, 1), int(x + r.gauss(0, 0.3) > 0.7)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, split string, x double, z double, label int")
    rate = sum(v[-1] for v in rows[:200]) / 200
    assert models.climatology(df, "label").where("split = 'test'").first().y_prob == pytest.approx(rate)
    assert models.persistence(df, "label", "x", "z", 0.95).where("split = 'train'").agg(F.sum("y_pred")).first()[0] == 10
    for fit in (models.logistic_grid(df, ["x", "z"], "label", (0.1, 1.0)), models.boosted_trees(df, ["x", "z"], "label", [{"maxDepth": 3, "maxIter": 5}], early_stop=True)):
        choice, model, out = fit
        test = models.metrics_of(out).where("split = 'test'").first()
        assert test.roc_auc > 0.9 and test.f2 > 0.7 and 0 < choice["threshold"] < 1
    assert models.gain_shares(model, ["x", "z"])[0][0] == "x"
    scaled = models.impute_and_scale(df.withColumn("z", F.when(F.col("id") > 5, F.col("z"))).withColumn("c", F.lit(2.0)), ["z", "c"])
    s = scaled.where("split = 'train'").agg(F.avg("z"), F.stddev_pop("z"), F.max("c")).first()
    assert s[0] == pytest.approx(0, abs=1e-9) and s[1] == pytest.approx(1) and s[2] == 0
    assert {round(x.weight, 3) for x in models.class_weights(df, "label", "ratio").select("weight").distinct().collect()} == {1.0, round((600 - (p := sum(v[-1] for v in rows))) / p, 3)}


def test_queries_search_whole_grids(spark, monkeypatch):
    from tidemark.operators import models
    from tidemark.plans import queries

    tried = []
    best = models._best

    class Stop(Exception):
        pass

    def chosen(fitted, *rest):
        tried.append([p for p, _ in fitted])
        raise Stop

    rows = [(i, i % 2, float(i % 7), None if i % 5 else 1.0, ("train", "val", "test")[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, label int, a double, b double, split string")
    monkeypatch.setattr(queries, "_documents", lambda *_: (df, ["a", "b"]))
    monkeypatch.setattr(models, "_best", chosen)
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, data: None)
    monkeypatch.setattr(models, "fit_leafwise", lambda df, features, label, candidates, *rest: tried.append(candidates) or (_ for _ in ()).throw(Stop))
    for name in ("logistic_regression", "boosted_trees", "leafwise_trees", "tuned_trees"):
        try:
            getattr(queries, name)(spark, "")
        except Stop:
            pass
    assert [p["C"] for p in tried[0]] == list(models.C_GRID)
    assert [(p["maxDepth"], p["maxIter"]) for p in tried[1]] == [(3, 20), (5, 20), (5, 40)]
    assert tried[2] == [models.Params(**p) for p in models.LEAF_GRID]
    assert tried[3] == models.search_draws(20)
    monkeypatch.undo()
    assert models._best is best
    choice, _, out = models.tuned_trees(df, ["a", "b"], "label", trials=1, patience=2)
    assert "threshold" in choice and out.count() == len(rows)


def test_labelled_documents_join_their_measures_and_not_their_texts(spark, tmp_path):
    import math

    from tidemark.plans import queries

    spark.createDataFrame([(1, "Ab c!", "en"), (2, None, "en"), (3, "", "de"), (4, "x", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows, features = queries._documents(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join") < plan.index("regexp_replace")
    got = {r.doc_id: (r.label, r.split, *[None if r[f] is None else round(r[f], 6) for f in features]) for r in rows.collect()}
    assert got == {1: (1, "train", round(math.log(6), 6), 0.2, 0.2, 0.2), 2: (0, "train", None, None, None, None), 3: (1, "val", 0.0, 0.0, 0.0, 0.0)}
