"""Profiles of feature tables and the segment cost model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import rounded


def log_moments(rows: DataFrame, by: list[str], stretch: str, value: str) -> DataFrame:
    """Mean of the logs of positive values, pooled spread within stretches (at least 1e-3), and spread between stretch means."""
    logs = rows.where(F.col(value) > 0).withColumn("lx", F.log(value))
    own = logs.groupBy(*by, stretch).agg(F.count("*").alias("n"), F.avg("lx").alias("m"), (F.var_pop("lx") * F.count("*")).alias("ss"), F.sum("lx").alias("s"))
    wide = F.col("n") >= 5
    between = F.var_samp(F.when(wide, F.col("m"))) - F.avg(F.when(wide, F.col("ss") / (F.col("n") - 1) / F.col("n")))
    free = F.sum(F.col("n") - 1)
    return own.groupBy(*by).agg(
        rounded(F.sum("s") / F.sum("n")).alias("mu"),
        rounded(F.greatest(F.coalesce(F.sqrt(F.try_divide(F.sum("ss"), free)), F.lit(0.0)), F.lit(1e-3))).alias("sigma"),
        rounded(F.when(F.count_if(wide) >= 3, F.sqrt(F.greatest(between, F.lit(0.0)))).otherwise(0.0)).alias("tau"),
    )


def pattern_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    code = sum((F.col(c).cast("int") * (1 << i) for i, c in enumerate(columns)), F.lit(0))
    return rows.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def kth_largest(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Per column its k-th largest value (the smallest if there are fewer) and whether all values are whole.

    Values are counted first, so ranking runs over distinct values.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("p")
    counts = rows.select(pairs).select("p.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("c"))
    down = Window.partitionBy("column").orderBy(F.desc("value"))
    ranked = counts.withColumn("upto", F.sum("c").over(down))
    kth = F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("value"))), F.min("value"))
    return ranked.groupBy("column").agg(rounded(kth).alias("kth"), F.bool_and(F.col("value") == F.rint("value")).alias("whole"))


def repeats_previous(rows: DataFrame, key: list[str], at: list[str], columns: list[str]) -> DataFrame:
    """Share of rows that equal the row before them on their timeline."""
    line = Window.partitionBy(*key).orderBy(*at)
    same = [F.col(c).eqNullSafe(F.lag(c).over(line)) for c in columns]
    equal = same[0]
    for s in same[1:]:
        equal = equal & s
    marked = rows.select(*key, (equal & (F.row_number().over(line) > 1)).alias("equal"))
    return marked.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("equal").alias("repeats"))


def segment_costs(grid: DataFrame, entries: int, hash_s: float, sign_s: float, verify_s: float) -> DataFrame:
    """Modelled seconds of a log of ``entries`` for each ``segment`` length of the grid."""
    s, n = F.col("segment").cast("double"), float(entries)
    k = F.ceil(n / s).cast("double")
    asked = float(max(1, entries // 100))
    append = n * (1 + F.log2(s)) * hash_s + (k - 1) * sign_s
    verify = asked * (F.log2(s) * hash_s + verify_s)
    fetch = 0.3 * asked * (2e-4 + F.log2(k) * 5e-6)
    recovery = n / 1e5 * 2 * s * hash_s
    return grid.select("segment", append.alias("append_s"), verify.alias("verify_s"), fetch.alias("fetch_s"), recovery.alias("recovery_s"), (append + verify + fetch + recovery).alias("total_s"))


def cheapest(costs: DataFrame) -> DataFrame:
    """The segment with the least total, the shortest of equals."""
    return costs.agg(F.min_by("segment", F.struct("total_s", "segment")).alias("segment"), F.min("total_s").alias("total_s"))


def robust_scaled(rows: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """(x - median) / interquartile range, both of the training rows alone; a range up to 1e-12 counts as 1."""
    stats = rows.where(train).agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        low, mid, high = stats[c]
        out[c] = rounded((F.col(c) - F.lit(mid)) / F.lit(high - low if high - low > 1e-12 else 1.0))
    return rows.withColumns(out)
