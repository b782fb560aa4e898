"""Detection metrics from one tied-score curve.

Scores are counted per group and distinct value first, and running counts go
over slices of the scores, so a group of any size is never in one task. ``by`` names the columns of a fold, replica or host;
a metric over everything passes a constant column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import rounded
from .ranges import odds_slice, running


def curve(scored: DataFrame, by: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Cumulative true and false positives at each distinct score, from the highest."""
    y = F.col(label).cast("long")
    return counted_curve(scored.select(*by, score, y.alias("p"), (1 - y).alias("q")), by, score)


def counted_curve(counts: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """The same of rows that stand for ``p`` positives and ``q`` negatives each."""
    counts = counts.groupBy(*by, score).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    totals = counts.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    upto = running(counts, by, [(score, False)], {"tp": F.col("p"), "fp": F.col("q")}, slice_of=odds_slice(score))
    theirs = totals.select(*(F.col(c).alias(f"_of_{c}") for c in by), "pos", "neg")
    return upto.join(F.broadcast(theirs), [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]).select(*by, score, "p", "q", "tp", "fp", "pos", "neg")


def average_precision(points: DataFrame, by: list[str]) -> DataFrame:
    step = F.when(F.col("pos") > 0, F.col("p") / F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return points.groupBy(*by).agg(rounded(F.sum(step)).alias("ap"))


def roc_auc(points: DataFrame, by: list[str]) -> DataFrame:
    """By the trapezoid rule, in whole numbers until the last division."""
    area = F.sum(F.col("q") * (2 * F.col("tp") - F.col("p")))
    both = F.max("pos") * F.max("neg")
    return points.groupBy(*by).agg(F.when(both > 0, rounded(area / (2 * both))).alias("auc"))


def roc_corners(points: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Curve points where the direction changes; the last always stays."""
    line = Window.partitionBy(*by).orderBy(F.desc(score))
    next_p, next_q = F.lead("p").over(line), F.lead("q").over(line)
    bends = F.coalesce(F.col("p") * next_q != F.col("q") * next_p, F.lit(True))
    return points.withColumn("_bends", bends).where("_bends").drop("_bends")


def tpr_at_fpr(points: DataFrame, by: list[str], most: float, score: str = "score") -> DataFrame:
    """The best true-positive rate at a false-positive rate of at most ``most``, with its highest threshold.

    The curve begins at (0, 0) above every score: both rates are 0 and the threshold null if no corner is in reach.
    """
    held = roc_corners(points, by, score).where((F.col("pos") > 0) & (F.col("neg") > 0))
    best = held.groupBy(*by).agg(F.max(F.when(F.col("fp") / F.col("neg") <= most, F.struct("tp", F.col(score).alias("s"), "fp", "pos", "neg"))).alias("b"))
    rate = lambda a, n: F.coalesce(rounded(F.col(f"b.{a}") / F.col(f"b.{n}")), F.lit(0.0))
    return best.select(*by, rate("tp", "pos").alias("tpr"), rate("fp", "neg").alias("fpr"), rounded(F.col("b.s")).alias("threshold"))


def ppv_at_base_rates(rates: DataFrame, by: list[str], base_rates: list[float], per_day: int = 1440) -> DataFrame:
    """Precision in deployment and false alerts a day at each base rate."""
    at = F.explode(F.array(*[F.lit(b) for b in base_rates])).alias("base_rate")
    hit = F.col("tpr") * F.col("base_rate")
    false = F.col("fpr") * (1 - F.col("base_rate"))
    out = rates.select(*by, "tpr", "fpr", at)
    return out.select(*by, "base_rate", F.when(hit + false > 0, rounded(hit / (hit + false))).alias("ppv"), rounded(F.col("fpr") * per_day).alias("alerts_per_day"))


def confusion(scored: DataFrame, by: list[str], threshold: float, score: str = "score", label: str = "y") -> DataFrame:
    """Counts at a threshold, precision, recall (null if undefined), and the Matthews coefficient (0 if undefined)."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.groupBy(*by).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(below > 0, (tp * tn - fp * fn) / F.sqrt(below)).otherwise(F.lit(0.0))
    part = lambda a, b: F.when(a + b > 0, rounded(a / (a + b)))
    return counts.withColumns({"precision": part(tp, fp), "recall": part(tp, fn), "mcc": rounded(mcc)})


def _bin(x: Column, bins: int) -> Column:
    """Number of the bin (lo, hi] of [0, 1], the first closed, by comparison with the edges themselves."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.aggregate(edges, F.lit(0), lambda n, e: n + (x > e).cast("int"))


def calibration_error(scored: DataFrame, by: list[str], bins: int = 15, score: str = "score", label: str = "y") -> DataFrame:
    """Expected calibration error within each true class."""
    binned = scored.groupBy(*by, label, _bin(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"), F.avg(score).alias("mean"))
    return binned.groupBy(*by, label).agg(rounded(F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def histogram(scored: DataFrame, by: list[str], bins: int = 20, score: str = "score") -> DataFrame:
    """Counts in equal bins [lo, hi) of [0, 1], the last closed."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    at = F.aggregate(edges, F.lit(0), lambda n, e: n + (F.col(score) >= e).cast("int"))
    return scored.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def risk_coverage(scored: DataFrame, by: list[str], confidence: Column, tie: str, wrong: Column) -> DataFrame:
    """Area under the risk-coverage curve and risk at full, half and a fifth of the coverage; the most confident first, ties by ``tie``."""
    rows = scored.select(*by, confidence.alias("_sure"), F.col(tie).alias("_tie"), wrong.cast("long").alias("_wrong"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).select(*(F.col(c).alias(f"_of_{c}") for c in by), "n")
    rows = running(rows, by, [("_sure", False), ("_tie", True)], {"k": F.lit(1), "err": F.col("_wrong")})
    rows = rows.join(sizes, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    rows = rows.withColumns({"risk": F.col("err") / F.col("k"), "before": F.try_divide(F.col("err") - F.col("_wrong"), F.col("k") - 1)})
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("risk")))
    area = F.coalesce(F.sum((F.col("risk") + F.col("before")) / 2 / F.col("n")), F.lit(0.0))
    half, fifth = F.greatest(F.floor(F.col("n") / 2), F.lit(1)), F.greatest(F.floor(F.col("n") / 5), F.lit(1))
    return rows.groupBy(*by).agg(rounded(area).alias("aurc"), rounded(at(F.col("n"))).alias("risk_full"), rounded(at(half)).alias("risk_half"), rounded(at(fifth)).alias("risk_fifth"))
