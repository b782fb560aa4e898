"""Statistics over runs and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import rounded

#: Critical points of the studentised range (0.05) over sqrt(2), for 2 to 15 methods.
NEMENYI_Q = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391)


def whole_mean(x: Column) -> Column:
    """Mean of values of six digits: whole millionths are summed, so that no order of summing shows in the result."""
    return F.sum(F.rint(x * 1e6).cast("long")) / F.count(x) / 1e6


def fold_summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, spread and range of values of six digits."""
    x = F.col(value)
    return values.groupBy(*by).agg(F.count(x).alias("n"), rounded(whole_mean(x)).alias("mean"), rounded(F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias("std"), rounded(F.min(x)).alias("min"), rounded(F.max(x)).alias("max"))


def holm(tests: DataFrame, by: list[str], name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values; a null p stays null and is never rejected."""
    order = Window.partitionBy(*by).orderBy(p, name)
    known = tests.where(F.col(p).isNotNull())
    ranked = known.withColumns({"_i": F.row_number().over(order), "_m": F.count("*").over(Window.partitionBy(*by))})
    raised = ranked.withColumn("adjusted", F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_m") - F.col("_i") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    judged = raised.withColumn("rejected", F.col("adjusted") <= alpha)
    rest = tests.where(F.col(p).isNull()).select(*by, name, p, F.lit(None).cast("double").alias("adjusted"), F.lit(False).alias("rejected"))
    return judged.select(*by, name, p, rounded(F.col("adjusted")).alias("adjusted"), "rejected").unionByName(rest)


def mean_ranks(scores: DataFrame, fold: str, method: str, score: str) -> DataFrame:
    """Friedman ranks: the best of a fold has rank 1, ties share their mean."""
    best = Window.partitionBy(fold).orderBy(F.desc(score))
    ranked = scores.select(fold, method, F.rank().over(best).alias("r"), F.count("*").over(Window.partitionBy(fold, score)).alias("t"))
    return ranked.groupBy(method).agg(rounded(F.avg(F.col("r") + (F.col("t") - 1) / 2)).alias("mean_rank"), F.count("*").alias("n_folds"))


def nemenyi_distance(methods: int, folds: int) -> float:
    return NEMENYI_Q[methods - 2] * (methods * (methods + 1) / (6 * folds)) ** 0.5


def cliffs_delta(rows: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """P(a > b) - P(a < b) between the two sides, from counts of distinct values rather than from pairs."""
    counts = rows.groupBy(*by, value).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    up = Window.partitionBy(*by).orderBy(value)
    below = counts.withColumn("b_below", F.sum("b").over(up) - F.col("b")).withColumn("b_all", F.sum("b").over(Window.partitionBy(*by)))
    wins = F.sum(F.col("a") * (F.col("b_below") - (F.col("b_all") - F.col("b_below") - F.col("b"))))
    both = F.sum("a") * F.max("b_all")
    delta = below.groupBy(*by).agg(F.when(both > 0, rounded(wins / both)).alias("delta"))
    size = F.abs("delta")
    return delta.withColumn("band", F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").when(size.isNotNull(), "large"))


def inflation(runs: DataFrame, model: str, split: str, value: str, splits: list[str]) -> DataFrame:
    """Mean score of each model under each split as columns, and the drop from the first to the second."""
    table = runs.groupBy(model).pivot(split, splits).agg(whole_mean(F.col(value)))
    drop = F.col(splits[0]) - F.col(splits[1])
    return table.select(model, *[rounded(F.col(s)).alias(s) for s in splits], rounded(drop).alias("drop"), (drop >= 0.02).alias("passes"))


def wilcoxon(first: list[float], second: list[float], fewest: int = 6) -> float | None:
    """Two-sided exact p of the signed-rank test over a few paired runs; null under ``fewest`` pairs, 1 if all are equal.

    Pairs without a difference are left out; tied differences share their mean
    rank. Ranks are doubled, so that the distribution counts in whole numbers.
    """
    if len(first) != len(second):
        raise ValueError("runs are not paired")
    if len(first) < fewest:
        return None
    differences = sorted((a - b for a, b in zip(first, second, strict=True) if a != b), key=abs)
    if not differences:
        return 1.0
    sizes = [abs(d) for d in differences]
    doubled = [sizes.index(s) + 1 + len(sizes) - sizes[::-1].index(s) for s in sizes]
    ways = {0: 1}
    for rank in doubled:
        more = dict(ways)
        for total, n in ways.items():
            more[total + rank] = more.get(total + rank, 0) + n
        ways = more
    positive = sum(r for r, d in zip(doubled, differences, strict=True) if d > 0)
    low = min(positive, sum(doubled) - positive)
    return min(1.0, 2 * sum(n for total, n in ways.items() if total <= low) / 2 ** len(doubled))
