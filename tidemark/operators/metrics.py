"""Forecast verification per group: confusion counts, skill, ranking quality, calibration, threshold choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fresh
from .ranks import quantiles, running_totals

GRID = tuple(round(0.05 * k, 2) for k in range(1, 20))


def normalise_predictions(df: DataFrame, target: str | None = None) -> DataFrame:
    """``y_true`` (from that column or the target's), ``y_prob`` in [0, 1], ``y_pred``; null labels and scores count as 0."""
    if "y_true" not in df.columns:
        if target not in df.columns:
            raise ValueError("neither y_true nor the target is there")
        df = df.withColumnRenamed(target, "y_true")
    missing = {"y_prob", "y_pred"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    prob = F.least(F.greatest(F.coalesce(F.col("y_prob").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    whole = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    return df.withColumns({"y_true": whole("y_true"), "y_prob": prob, "y_pred": whole("y_pred")})


def check_binary(df: DataFrame, label: str) -> list[int]:
    """The distinct labels, which must be 0 or 1."""
    found = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(3).collect())
    if not set(found) <= {0, 1}:
        raise ValueError(f"{label} holds {found}")
    return found


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _counts(y: Column, p: Column) -> list[Column]:
    cell = lambda a, b: F.coalesce(F.sum(F.when((y == a) & (p == b), 1).otherwise(0)), F.lit(0)).cast("long")
    return [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]


def scores_of_counts(df: DataFrame, beta: float = 2.0) -> DataFrame:
    """Adds precision, recall, f1, f-beta as ``f2``, balanced accuracy, event and predicted rate and Heidke's skill score.

    Zero denominators give 0, except Heidke's, which gives null; balanced accuracy averages over the classes there are.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    b2 = beta * beta
    recall, specific = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    both = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    heidke = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    return df.withColumns(
        {
            "precision": _ratio(tp, tp + fp), "recall": recall, "f1": _ratio(2 * tp, 2 * tp + fp + fn), "f2": _ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp),
            "balanced_accuracy": F.when(both > 0, (recall + specific) / both), "event_rate": _ratio(tp + fn, n), "predicted_rate": _ratio(tp + fp, n),
            "hss": F.when(heidke != 0, 2 * (tp * tn - fp * fn) / heidke),
        }
    )


def confusion_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Counts and the scores made of them, per group."""
    return scores_of_counts(df.groupBy(*keys).agg(*_counts(F.col(y), F.col(pred))))


def ranking_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", prob: str = "y_prob", decimals: int | None = None) -> DataFrame:
    """``pr_auc`` (average precision: steps over distinct scores) and ``roc_auc`` (ties count half) per group; null where a
    class is missing.

    Rows are counted by group and score before the shuffle; ``decimals`` bounds the number of distinct scores, which need not
    be few: their running totals are made in buckets.
    """
    keys = list(keys)
    score = F.col(prob) if decimals is None else F.round(F.col(prob), decimals)
    s, p, n, tp, fp, all_p, all_n, whole_p, whole_n, ap, u = fresh(df.columns, "s", "p", "n", "tp", "fp", "all_p", "all_n", "whole_p", "whole_n", "ap", "u")
    rows = df.where(F.col(y).isNotNull() & F.col(prob).isNotNull())
    counts = rows.groupBy(*keys, score.alias(s)).agg(F.sum(F.col(y).cast("long")).alias(p), F.sum(1 - F.col(y).cast("long")).alias(n))
    ranked = running_totals(counts, keys, s, {p: (tp, all_p), n: (fp, all_n)}, descending=True)
    out = ranked.groupBy(*keys).agg(
        F.sum(p).alias(whole_p),
        F.sum(n).alias(whole_n),
        F.sum(F.col(p) * F.col(tp) / (F.col(tp) + F.col(fp))).alias(ap),
        F.sum(F.col(n) * (F.col(tp) - F.col(p) / 2)).alias(u),
    )
    both = (F.col(whole_p) > 0) & (F.col(whole_n) > 0)
    return out.select(*keys, F.when(both, F.col(ap) / F.col(whole_p)).alias("pr_auc"), F.when(both, F.col(u) / (F.col(whole_p) * F.col(whole_n))).alias("roc_auc"))


def calibration_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", prob: str = "y_prob", eps: float = 1e-9) -> DataFrame:
    """Brier score and log loss with probabilities clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    t = F.col(y)
    return df.groupBy(*keys).agg(
        F.avg(F.pow(F.col(prob) - t, F.lit(2.0))).alias("brier"), F.avg(-(t * F.log(p) + (1 - t) * F.log(1 - p))).alias("log_loss")
    )


def threshold_scan(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", prob: str = "y_prob", grid: Sequence[float] = GRID) -> DataFrame:
    """Scores at every threshold of the grid. Each row counts once, at the number of thresholds that it reaches, and
    cumulative sums do the rest: the grid never multiplies the rows."""
    keys, grid = list(keys), sorted(grid)
    r, p_, c_, s_ = fresh(df.columns, "r", "p", "c", "s")
    reached = sum(((F.col(prob) >= t).cast("int") for t in grid), F.lit(0))
    counts = df.groupBy(*keys, reached.alias(r)).agg(F.sum(F.col(y).cast("long")).alias(p_), F.count("*").alias(c_))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(float(t)).alias("t")) for i, t in enumerate(grid)])
    each = counts.withColumn(s_, F.explode(steps))
    hit = F.col(r) >= F.col(f"{s_}.k")
    cell = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("long")
    p, n = F.col(p_), F.col(c_) - F.col(p_)
    out = each.groupBy(*keys, F.col(f"{s_}.t").alias("threshold")).agg(cell(~hit, n).alias("tn"), cell(hit, n).alias("fp"), cell(~hit, p).alias("fn"), cell(hit, p).alias("tp"))
    return scores_of_counts(out)


def select_threshold(df: DataFrame, keys: Sequence[str] = (), metric: str = "f2", **options) -> DataFrame:
    """The grid's best threshold per group: by metric, then recall, the lowest threshold on ties (average precision is the
    same at all thresholds of a group, so it decides nothing here)."""
    scan = threshold_scan(df, keys, **options)
    best = F.max_by(F.struct(*[c for c in scan.columns if c not in keys]), F.struct(F.coalesce(metric, F.lit(-1.0)), "recall", -F.col("threshold")))
    (found,) = fresh(scan.columns, "best")
    return scan.groupBy(*keys).agg(best.alias(found)).select(*keys, f"{found}.*")


def infer_threshold(df: DataFrame, keys: Sequence[str] = (), prob: str = "y_prob", pred: str = "y_pred") -> DataFrame:
    """The threshold behind (prob, pred), per group and in [0, 1]: the least positive score where no negative one exceeds it
    (or there is none), halfway to the largest negative score where one does, and 1 without positives."""
    yes = F.min(F.when(F.col(pred) == 1, F.col(prob)))
    no = F.max(F.when(F.col(pred) == 0, F.col(prob)))
    found = F.when(yes.isNull(), F.lit(1.0)).when(yes < no, (yes + no) / 2).otherwise(yes)
    return df.groupBy(*keys).agg(F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0)).alias("threshold"))


def metrics_long(df: DataFrame, keys: Sequence[str], min_rows: int = 0, min_positives: int = 0, decimals: int | None = None) -> DataFrame:
    """All scores per group, of groups with enough rows and positives."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(F.col("y_true").cast("long")).alias("n_positive"), *_counts(F.col("y_true"), F.col("y_pred")), F.avg(F.pow(F.col("y_prob") - F.col("y_true"), F.lit(2.0))).alias("brier")
    )
    counts = scores_of_counts(counts.where((F.col("rows") >= min_rows) & (F.col("n_positive") >= min_positives)))
    return counts.join(ranking_metrics(df, keys, decimals=decimals), keys, "left").join(infer_threshold(df, keys), keys, "left")


def pivot_metrics(long: DataFrame, index: Sequence[str], by: Sequence[str], metrics: Sequence[str], values: Sequence[Sequence[str]]) -> DataFrame:
    """One row per index; columns ``{metric}__{by...}`` for the stated combinations (stated, so the plan knows its columns)."""
    out = []
    for m in metrics:
        for combo in values:
            here = F.lit(True)
            for c, v in zip(by, combo, strict=True):
                here = here & (F.col(c) == v)
            out.append(F.max(F.when(here, F.col(m))).alias("__".join([m, *combo])))
    return long.groupBy(*index).agg(*out)


def model_difference(long: DataFrame, index: Sequence[str], metric: str, first: str, second: str, model: str = "model") -> DataFrame:
    """``{metric}_diff`` of two models where both are there."""
    pick = lambda m: F.max(F.when(F.col(model) == m, F.col(metric)))
    both = long.where(F.col(model).isin(first, second)).groupBy(*index).agg(pick(first).alias("a"), pick(second).alias("b"))
    return both.where("a is not null and b is not null").select(*index, (F.col("a") - F.col("b")).alias(f"{metric}_diff"))


def missing_predictions(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected combinations without a table."""
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")


def robust_range(df: DataFrame, value: str, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """``low``, ``high`` of finite values per group for a colour scale: their 5th and 95th percentile inside [0, 1], and if
    those are equal the extremes, a little wider; ``hss`` is symmetric about 0, at least 0.05 wide; null without values."""
    (v,) = fresh(keys, "v")
    x = F.col(value).cast("double")
    rows = df.select(*keys, x.alias(v)).where(F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    r = quantiles(rows, keys, v, {"lo": (0.05, "linear"), "hi": (0.95, "linear")}, [F.min(v).alias("least"), F.max(v).alias("most")])
    lo, hi, least, most = (F.col(c) for c in ("lo", "hi", "least", "most"))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    if metric == "hss":
        side = F.greatest(F.abs(F.least(lo, F.lit(0.0))), F.abs(F.greatest(hi, F.lit(0.0))), F.lit(0.05))
        low, high = -side, side
    elif metric == "brier":
        low = F.when(lo != hi, lo).when(least != most, least).otherwise(F.greatest(least - 0.01, F.lit(0.0)))
        high = F.when(lo != hi, hi).when(least != most, most).otherwise(F.least(most + 0.01, F.lit(1.0)))
    else:
        flat = F.greatest(lo, F.lit(0.0)) == F.least(hi, F.lit(1.0))
        low = F.when(flat, unit(least - 0.01)).otherwise(F.greatest(lo, F.lit(0.0)))
        high = F.when(flat, unit(most + 0.01)).otherwise(F.least(hi, F.lit(1.0)))
    return r.select(*keys, F.when(least.isNotNull(), low).alias("low"), F.when(least.isNotNull(), high).alias("high"))


def difference_limit(df: DataFrame, value: str, least: float = 0.05) -> DataFrame:
    """One row: a symmetric limit, the 95th percentile of absolute differences, at least ``least``."""
    found = quantiles(df.select(F.abs(F.col(value)).alias("v")), [], "v", {"limit": (0.95, "linear")})
    return found.select(F.greatest(F.coalesce("limit", F.lit(least)), F.lit(least)).alias("limit"))
