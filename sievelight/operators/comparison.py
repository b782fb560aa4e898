"""What detectors score under several splits of the same rows, and how much of that is repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..tables import discard, staged
from . import curves, detectors

BY = ["features", "split"]


def compared(rows: DataFrame, parts: dict[str, DataFrame], feature_sets: dict[str, list[str]], label: str, detector: str = "boosted_trees", threshold: float = 0.5, seed: int = 0) -> DataFrame:
    """``features, split, n_train, n_test, positives, ap, mcc`` of one detector, fitted anew for every split and set of features.

    Rows have a ``row_id``, the features (not named ``y``, ``part`` or ``split``)
    and a label of 0 and 1; those without a label are left out. Sets of features show what some columns give away: the
    same rows with and without the calendar, say. Rows with their parts are written
    once and read by every fit, all scores are written once and every metric is an
    aggregate over them; a split without test rows has no line, one without
    positives no average precision. A split without training rows scores as the
    detector does, ``memory`` 0 throughout.
    """
    columns, fit = list(dict.fromkeys(c for cs in feature_sets.values() for c in cs)), detectors.detector(detector)
    known = rows.where(F.col(label).isNotNull()).select("row_id", F.col(label).cast("int").alias("y"), *columns)
    placed = scored = None
    for split, part in parts.items():
        one = known.join(part.where("part IN ('train', 'test')").select("row_id", "part"), "row_id").withColumn("split", F.lit(split))
        placed = one if placed is None else placed.unionByName(one)
    placed = staged(placed, "placed-rows")
    sizes = placed.groupBy("split").agg(F.count_if(F.col("part") == "train").alias("n_train")).collect()  # a row a split
    for split in parts:
        of = placed.where(F.col("split") == split)
        train, test = of.where("part = 'train'"), of.where("part = 'test'")
        for name, chosen in feature_sets.items():
            one = fit(train, test, chosen, "y", seed=seed).join(test.select("row_id", "y"), "row_id").select(F.lit(name).alias("features"), F.lit(split).alias("split"), "y", "score")
            scored = one if scored is None else scored.unionByName(one)
    scored = staged(scored, "compared-splits")
    discard(placed)
    n_train = F.coalesce(*[F.when(F.col("split") == s.split, s.n_train) for s in sizes], F.lit(0)).cast("long")
    counts = scored.groupBy(*BY).agg(n_train.alias("n_train"), F.count("*").alias("n_test"), F.sum("y").cast("long").alias("positives"))
    ap = curves.average_precision(curves.curve(scored, BY), BY)
    mcc = curves.confusion(scored, BY, threshold).select(*BY, "mcc")
    return counts.join(ap, BY).join(mcc, BY).select(*BY, "n_train", "n_test", "positives", "ap", "mcc")


def gaps(scores: DataFrame, easy: str, strict: str) -> DataFrame:
    """``features, easy_ap, strict_ap, ap_gap, mcc_gap``: what each set of features loses from the easy split to the strict one."""
    of = lambda split, value: F.max(F.when(F.col("split") == split, F.col(value)))
    both = scores.groupBy("features").agg(of(easy, "ap").alias("easy_ap"), of(strict, "ap").alias("strict_ap"), of(easy, "mcc").alias("_e"), of(strict, "mcc").alias("_s"))
    return both.select("features", "easy_ap", "strict_ap", rounded(F.col("easy_ap") - F.col("strict_ap")).alias("ap_gap"), rounded(F.col("_e") - F.col("_s")).alias("mcc_gap"))


def repeated(rows: DataFrame, parts: dict[str, DataFrame], features: list[str]) -> DataFrame:
    """``split, n_test, twins, opposed, share``: test rows whose features occur in training, and those of them never with their own label.

    One count a pattern, split and part, so a pattern of any size is summed in
    parts before it is shuffled. Labels are in the column ``y``.
    """
    keys = [f"_k{i}" for i in range(len(features))]
    patterns = rows.select("row_id", "y", *[detectors.comparable(rows, c).alias(k) for c, k in zip(features, keys, strict=True)])
    out = None
    for split, part in parts.items():
        one = patterns.join(part.select("row_id", "part"), "row_id").select(F.lit(split).alias("split"), "y", "part", *keys)
        out = one if out is None else out.unionByName(one)
    train, test = F.col("part") == "train", F.col("part") == "test"
    counts = out.groupBy("split", *keys).agg(
        F.count_if(test).alias("n"),
        F.count_if(train).alias("seen"),
        *[F.count_if(c & (F.col("y") == y)).alias(f"{n}{y}") for n, c in (("train", train), ("test", test)) for y in (0, 1)],
    )
    twin = F.col("seen") > 0
    opposed = F.when(F.col("train0") == 0, F.col("test0")).otherwise(0) + F.when(F.col("train1") == 0, F.col("test1")).otherwise(0)
    total = counts.groupBy("split").agg(F.sum("n").alias("n_test"), F.sum(F.when(twin, F.col("n")).otherwise(0)).alias("twins"), F.sum(F.when(twin, opposed).otherwise(0)).alias("opposed"))
    return total.withColumn("share", rounded(F.col("twins") / F.greatest(F.col("n_test"), F.lit(1))))
