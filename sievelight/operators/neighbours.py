"""Exact k nearest neighbours of query rows among training rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on either side; one task compares one block with one block.
BLOCK = 2048


def nearest(queries: DataFrame, train: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """``query_id, train_id, rank`` of the k nearest by Euclidean distance; ties to the smaller train id.

    Both sides have ``id`` and ``v`` (array of numbers). Queries are a stated set
    held against all training rows: each pair of blocks is one task, which keeps
    the best k of its block, and those are ranked again.
    """
    q_blocks = blocks or max(1, -(-queries.count() // BLOCK))
    t_blocks = blocks or max(1, -(-train.count() // BLOCK))
    spread = lambda df, side, own, other, n, m: df.select(F.lit(side).alias("side"), "id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))
    both = spread(queries, 0, "i", "j", q_blocks, t_blocks).unionByName(spread(train, 1, "j", "i", t_blocks, q_blocks))

    def best(group: pa.Table) -> pa.Table:
        side, ids = group.column("side").to_numpy(), group.column("id").to_numpy()
        vectors = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids[side == 1], kind="stable")
        t_ids, t = ids[side == 1][order], vectors[side == 1][order]
        out = ([], [], [])
        for query_id, q in zip(ids[side == 0].tolist(), vectors[side == 0], strict=True):
            if not len(t_ids):
                break
            d = ((t - q) ** 2).sum(axis=1)  # differences first: equal points have distance exactly zero
            top = np.argsort(d, kind="stable")[:k]
            out[0].extend([query_id] * len(top))
            out[1].extend(t_ids[top].tolist())
            out[2].extend(d[top].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "train_id": pa.array(out[1], pa.int64()), "d": pa.array(out[2], pa.float64())})

    found = both.groupBy("i", "j").applyInArrow(best, "query_id long, train_id long, d double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "train_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def others(found: DataFrame, k: int) -> DataFrame:
    """The k nearest without the query itself, from its k + 1 nearest."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.where("query_id != train_id").withColumn("rank", rank).where(F.col("rank") <= k)


def memory_scores(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of positive neighbours, the j-th weighing 2 to the power 1 - j: ``query_id, score``."""
    w = F.pow(F.lit(2.0), 1 - F.col("rank"))
    joined = found.join(labels.select(F.col("id").alias("train_id"), "y"), "train_id")
    return joined.groupBy("query_id").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("score"))
