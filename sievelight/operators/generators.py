"""Synthetic corpora of host windows, drawn from hashes so that every run and every partitioning agrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal by Box and Muller."""
    a, b = uniform(seed, F.lit("a"), *keys), uniform(seed, F.lit("b"), *keys)
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * b)


def host_windows(spark: SparkSession, replicas: int = 8, hosts: int = 6, windows: int = 1440, prevalence: float = 0.06, seed: int = 0, features: int = 8, step: int = 60, start: int = 1_700_000_000) -> DataFrame:
    """Long-lived hosts with bursts of positives, availability that depends on the label, and copied quiet rows.

    Bursts are 12 windows long and begin often enough for the prevalence. Positive
    windows shift all features; the last tenth of the hosts cannot be labelled.
    """
    n = replicas * hosts * windows
    rows = spark.range(n).select(
        F.col("id").alias("row_id"), (F.col("id") / (hosts * windows)).cast("long").alias("replica"), ((F.col("id") / windows).cast("long") % hosts).alias("host"), (F.col("id") % windows).alias("w")
    )
    burst = F.floor(F.col("w") / 12)
    y = (uniform(seed, F.lit("burst"), F.col("replica"), F.col("host"), burst) < prevalence).cast("int")
    rows = rows.withColumns({"y": y, "window_start": F.lit(start) + F.col("w") * step, "labellable": F.col("host") < math.ceil(hosts * 0.9)})
    rows = rows.withColumn("y", F.when(F.col("labellable"), F.col("y")).otherwise(0))
    copied = uniform(seed, F.lit("copy"), F.col("row_id")) < 0.05
    key = F.when(copied & (F.col("y") == 0), F.col("w") - F.col("w") % 10).otherwise(F.col("w"))
    level = {f"x{i}": F.exp(0.5 * i + 0.8 * F.col("y") + normal(seed, F.lit(f"x{i}"), F.col("replica"), F.col("host"), key)) for i in range(features)}
    has = {f"has_{m}": uniform(seed, F.lit(m), F.col("row_id")) < F.when(F.col("y") == 1, 0.95).otherwise(rate) for m, rate in (("m1", 0.7), ("m2", 0.9), ("m4", 0.8))}
    return rows.withColumns(level | has)


def contract_violations(rows: DataFrame) -> DataFrame:
    """Counts of broken rules of a window table, in one pass."""
    return rows.agg(
        F.count_if(~F.col("y").isin(0, 1)).alias("label_not_binary"), F.count_if((F.col("y") == 1) & ~F.col("labellable")).alias("positive_unlabellable"), F.count_if(F.col("window_start").isNull()).alias("no_window")
    )
