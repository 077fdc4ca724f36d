"""Feature importance: ranks, correlations, mutual information, and the ensemble made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import fresh
from .ranks import column_quantiles, join_null_safe, running_totals

#: Weights of the importance score's parts.
WEIGHTS = {"mutual_info": 0.20, "abs_spearman": 0.15, "split_importance": 0.20, "gain_importance": 0.45}


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``name``: rank of each distinct value of a group, ties averaged, from counts of values combined before the shuffle."""
    (weight,) = fresh([*df.columns, name], "weight")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(weight))
    return weighted_ranks(counted, keys, value, weight, name)


def weighted_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """As ``average_ranks``, of rows that stand for ``weight`` equal ones."""
    count, upto, whole = fresh([*df.columns, name], "count", "upto", "whole")
    counts = df.groupBy(*keys, value).agg(F.sum(weight).alias(count))
    ranked = running_totals(counts, keys, value, {count: (upto, whole)})
    return ranked.select(*keys, value, (F.col(upto) - (F.col(count) - 1) / 2).alias(name))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least_pairs: int = 10) -> DataFrame:
    """Rank correlation per group; null for fewer than ``least_pairs`` pairs or a constant side."""
    keys = list(keys)
    weight, rank_x, rank_y = fresh(df.columns, "weight", "rank_x", "rank_y")
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias(weight))
    ranked = join_null_safe(pairs, weighted_ranks(pairs, keys, x, weight, rank_x), [*keys, x])
    ranked = join_null_safe(ranked, weighted_ranks(pairs, keys, y, weight, rank_y), [*keys, y])
    w, rx, ry = F.col(weight), F.col(rank_x), F.col(rank_y)
    s = ranked.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"), F.sum(w * rx * rx).alias("xx"), F.sum(w * ry * ry).alias("yy"), F.sum(w * rx * ry).alias("xy")
    )
    n = F.col("n")
    vx, vy = n * F.col("xx") - F.col("sx") * F.col("sx"), n * F.col("yy") - F.col("sy") * F.col("sy")
    rho = (n * F.col("xy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    return s.select(*keys, "n", F.when((n >= least_pairs) & (vx > 0) & (vy > 0), rho).alias("spearman"))


def quantile_edges(train: DataFrame, columns: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Edges that cut each column's training rows into ``bins`` parts of about equal size: a list of at most ``bins`` - 1
    numbers a column, without repeats, empty where a column has no value."""
    found = column_quantiles(train, columns, [k / bins for k in range(1, bins)])
    return {c: sorted({x for x in v if x is not None}) for c, v in found.items()}


def quantile_mutual_information(df: DataFrame, features: Sequence[str], label: str, split: str = "split", bins: int = 10) -> DataFrame:
    """``(feature, mutual_info)``: mutual information (nats) of each feature with a label over the training rows, in quantile
    bins fitted on them. One pass counts the cells of all features, which are stacked and combined before the shuffle."""
    train = df.where(F.col(split) == "train")
    edges = quantile_edges(train, features, bins)
    cells = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("feature"), _bin_of(c, edges[c]).alias("x"))) for c in features]
    stacked = train.select(F.explode(F.array_compact(F.array(*cells))).alias("cell"), F.col(label).alias("y")).select("cell.feature", "cell.x", "y")
    return binned_mutual_information(stacked, ["feature"], "x", "y", range(1, bins))


def _bin_of(x: str, edges: Sequence[float]) -> Column:
    return sum(((F.col(x) >= e).cast("int") for e in edges), F.lit(0))


def binned_mutual_information(df: DataFrame, keys: Sequence[str], x: str, y: str, edges: Sequence[float]) -> DataFrame:
    """Mutual information (nats) of a binned feature and a label per group, from joint counts. ``edges`` cut the bins; a
    value on an edge is above it."""
    keys = list(keys)
    joint = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, _bin_of(x, edges).alias("__b"), F.col(y).alias("__y")).agg(F.count("*").alias("__c"))
    over = lambda *c: F.sum("__c").over(Window.partitionBy(*keys, *c))
    c = F.col("__c").cast("double")
    part = joint.withColumn("__m", c / over() * F.log(c * over() / (over("__b") * over("__y"))))
    return part.groupBy(*keys).agg(F.sum("__m").alias("mutual_info"))


def max_normalised(column: str) -> Column:
    """Null to 0, divided by the largest; 0 throughout if that is not positive."""
    v = F.coalesce(F.col(column), F.lit(0.0))
    top = F.max(v).over(Window.partitionBy())
    return F.when(top > 0, v / top).otherwise(F.lit(0.0))


def importance_ensemble(tables: Sequence[DataFrame], features: DataFrame, key: str = "feature", weights: dict[str, float] | None = None) -> DataFrame:
    """Left joins of score tables on the features, each score divided by its largest, and their weighted sum."""
    weights = weights or WEIGHTS
    out = features
    for t in tables:
        out = out.join(t, key, "left")
    out = out.withColumns({f"{c}_norm": max_normalised(c) for c in weights})  # a row a feature
    return out.withColumn("importance_score", sum((F.col(f"{c}_norm") * w for c, w in weights.items()), F.lit(0.0)))


def stacked(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(feature, x, y)``: one row for each row and feature, nulls and values that are no number left out."""
    cell = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")))
    cells = F.explode(F.array_compact(F.array(*[cell(c) for c in features])))
    return df.where(F.col(label).isNotNull()).select(cells.alias("cell"), F.col(label).cast("int").alias("y")).select("cell.feature", "cell.x", "y")


def abs_spearman(df: DataFrame, features: Sequence[str], label: str, least_pairs: int = 10) -> DataFrame:
    """``(feature, abs_spearman)`` of each feature with a label."""
    return spearman(stacked(df, features, label), ["feature"], "x", "y", least_pairs).select("feature", F.abs("spearman").alias("abs_spearman"))


def global_ranking(scores: DataFrame, feature: str, group: str, score: str, parts: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Per feature: number of scores, mean, median and largest, and the mean of each part as ``mean_{part}``; ``rank`` by mean
    score, then by the mean of the part ``tie``, then by name."""
    keys = [feature, group]
    table = scores.groupBy(*keys).agg(F.count(score).alias("n_targets"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), *[F.avg(c).alias(f"mean_{c}") for c in parts])
    median = F.percentile(score, 0.5).alias("median_score")  # a score a target
    table = join_null_safe(table, scores.groupBy(*keys).agg(median), keys)
    order = [F.desc_nulls_last("mean_score"), *([F.desc_nulls_last(f"mean_{tie}")] if tie else []), feature]
    return table.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a row a feature


def family_summary(ranking: DataFrame, group: str) -> DataFrame:
    return ranking.groupBy(group).agg(F.count("*").alias("n_features"), F.avg("mean_score").alias("mean_score"), F.max("mean_score").alias("best_score"), F.min("rank").alias("best_rank"))


def top_per_family(ranking: DataFrame, group: str, per_family: int, total: int, families: Sequence[str] | None = None) -> DataFrame:
    """The best of each family, then the best of those overall, by rank."""
    rows = ranking if families is None else ranking.where(F.col(group).isin(*families))
    place = F.row_number().over(Window.partitionBy(group).orderBy("rank"))
    return rows.withColumn("family_rank", place).where(F.col("family_rank") <= per_family).orderBy("rank").limit(total)
