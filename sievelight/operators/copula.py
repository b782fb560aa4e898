"""Normal scores within groups and their pooled correlations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from ..tables import scratch, staged
from .ranges import running

#: Rows that a group, a column in it and a pair need; least eigenvalue of a correlation matrix.
SUPPORT, LEAST_EIGENVALUE = 20, 1e-2


def mid_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, value``, its ``copies``, and ``rank`` (from 1, the mean of ties) among the ``n`` values of the group.

    Equal values are counted first, and the counts, written once, run over slices
    of the values, so a group of any size is never in one task.
    """
    counts = staged(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("copies")), "value-counts")
    totals = counts.groupBy(*by).agg(F.sum("copies").alias("n"))
    upto = running(counts, by, [(value, True)], {"upto": F.col("copies")})
    return upto.join(totals, by).select(*by, value, "copies", "n", (F.col("upto") - (F.col("copies") - 1) / 2).alias("rank"))


def normal_scores(rows: DataFrame, by: list[str], value: str, support: int = SUPPORT) -> DataFrame:
    """``by, value, z``: normal scores of the mid-ranks, with mean 0 and spread 1 in their group.

    Groups with under ``support`` values or one value only have no scores.
    """
    ranks = staged(mid_ranks(rows, by, value).withColumn("z", normal.quantile(F.col("rank") / (F.col("n") + 1))), "ranks")
    mean = F.sum(F.col("z") * F.col("copies")) / F.sum("copies")
    square = F.sum(F.col("z") * F.col("z") * F.col("copies")) / F.sum("copies")
    wide = ranks.groupBy(*by).agg(F.count("*").alias("distinct"), F.max("n").alias("n"), mean.alias("m"), F.sqrt(square - mean * mean).alias("sd"))
    wide = wide.where((F.col("n") >= support) & (F.col("distinct") > 1) & (F.col("sd") > 0)).select(*by, "m", "sd")
    return ranks.join(wide, by).select(*by, value, ((F.col("z") - F.col("m")) / F.col("sd")).alias("z"))


def _grams(k: int):
    """Sums of products, and counts of rows that have both, of a task's rows by class: one row per class and pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            classes = np.array(batch.column("class").to_pylist(), object)
            z = np.column_stack([np.asarray(batch.column(f"z{i}").to_numpy(zero_copy_only=False), np.float64) for i in range(k)])
            for c in dict.fromkeys(classes):
                own = z[classes == c]
                there = ~np.isnan(own)
                own = np.where(there, own, 0.0)
                s, n = found.get(c, (0, 0))
                found[c] = (s + own.T @ own, n + there.astype(np.int64).T @ there.astype(np.int64))
        a, b = np.tril_indices(k)
        for c, (s, n) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(s[a, b]), pa.array(n[a, b])], names=["class", "a", "b", "s", "n"])

    return run


def correlations(rows: DataFrame, key: str, label: str, group: list[str], columns: list[str], support: int = SUPPORT) -> DataFrame:
    """``class, a, b, s, n, correlation`` of normal scores within groups, pooled over the groups of a class, for b <= a.

    A null value is absent. Only groups of ``support`` rows of a class count, and
    pairs that fewer rows have are uncorrelated. ``a`` and ``b`` number the
    columns. Each task hands on one matrix a class; the matrices are then summed.
    What several steps read (values, their counts, their ranks) is written once.
    """
    with scratch(rows.sparkSession):
        sums = staged(_sums(rows, key, label, group, columns, support), "correlations", lasting=True)
    found = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("n") >= support, F.col("s") / F.col("n")).otherwise(0.0)
    return sums.withColumn("correlation", found)


def _sums(rows: DataFrame, key: str, label: str, group: list[str], columns: list[str], support: int) -> DataFrame:
    """``class, a, b, s, n``: sums of products of scores and numbers of rows."""
    named = rows.select(F.col(key).alias("_key"), F.col(label).cast("string").alias("class"), *group, *columns)
    by = ["class", *group]
    large = named.groupBy(*by).count().where(F.col("count") >= support).select(*by)
    named = named.join(large, by)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])).alias("p")
    long = staged(named.select("_key", *by, pairs).select("_key", *by, "p.*").where("value IS NOT NULL"), "values")
    cell = [*by, "column"]
    scores = normal_scores(long, cell, "value", support)
    scored = long.join(scores, [*cell, "value"])
    wide = scored.groupBy("_key", "class").agg(*(F.max(F.when(F.col("column") == i, F.col("z"))).alias(f"z{i}") for i in range(len(columns)))).drop("_key")
    parts = wide.mapInArrow(_grams(len(columns)), "class string, a int, b int, s double, n long")
    return parts.groupBy("class", "a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def repaired(pairs: DataFrame, size: int, least: float = LEAST_EIGENVALUE) -> dict[str, np.ndarray]:
    """For each class its correlation matrix with no eigenvalue under ``least`` and ones on the diagonal.

    ``pairs`` (``size * (size + 1) / 2`` rows a class) reach the driver; a matrix
    has a row and column for each feature, not for each row of the table.
    """
    out: dict[str, np.ndarray] = {}
    for r in pairs.select("class", "a", "b", "correlation").collect():
        c = out.setdefault(r["class"], np.eye(size))
        c[r.a, r.b] = c[r.b, r.a] = r.correlation
    for name, c in out.items():
        values, vectors = np.linalg.eigh(c)
        raised = (vectors * np.maximum(values, least)) @ vectors.T
        scale = np.sqrt(np.diag(raised))
        out[name] = np.clip(raised / np.outer(scale, scale), -1.0, 1.0)
    return out


def copula(rows: DataFrame, key: str, label: str, group: list[str], columns: list[str], support: int = SUPPORT, digits: int = 2) -> DataFrame:
    """``class, a, b, r``: the lower triangle of each class's repaired matrix."""
    matrices = repaired(correlations(rows, key, label, group, columns, support), len(columns))
    found = [(c, a, b, round(float(m[a, b]), digits) + 0.0) for c, m in sorted(matrices.items()) for a in range(len(columns)) for b in range(a + 1)]
    return rows.sparkSession.createDataFrame(found, "class string, a int, b int, r double")
