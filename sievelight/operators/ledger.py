"""A tamper-evident log: leaf hashes, Merkle levels, roots, inclusion paths."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_verdict(window_id: Column, host_hash: Column, ts_bucket: Column, verdict: Column, score: Column, sha: Column) -> Column:
    """The six fields as JSON with sorted keys and no spaces; texts are escaped, the score is a text."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)
    text = lambda c: F.regexp_replace(quoted(c), r"\]$", "")
    fields = {"host_hash": text(host_hash), "model_git_sha": text(sha), "score": text(score), "ts_bucket": ts_bucket.cast("string"), "verdict": verdict.cast("int").cast("string"), "window_id": text(window_id)}
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def leaf_hash(entry: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), entry.cast("binary")), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def next_level(nodes: DataFrame) -> DataFrame:
    """Pair neighbours ``idx, hash``; an odd last node rises unchanged."""
    sides = nodes.groupBy(F.floor(F.col("idx") / 2).cast("long").alias("up")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("idx") % 2 == 1, F.col("hash"))).alias("r"))
    return sides.select(F.col("up").alias("idx"), F.when(F.col("r").isNull(), F.col("l")).otherwise(node_hash(F.col("l"), F.col("r"))).alias("hash"))


def levels(leaves: DataFrame, size: int, keep: Callable[[DataFrame], DataFrame] = lambda level: level) -> DataFrame:
    """All nodes ``level, idx, hash`` of the tree over leaves 0 to ``size`` - 1; ``keep`` may store each level for the next."""
    nodes, out, level, n = leaves.select("idx", "hash"), None, 0, size
    while True:
        now = nodes.select(F.lit(level).alias("level"), "idx", "hash")
        out = now if out is None else out.unionByName(now)
        if n <= 1:
            return out
        nodes, level, n = keep(next_level(nodes)), level + 1, -(-n // 2)


def _node(left: str, right: str) -> str:
    return hashlib.sha256(b"\x01" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()


def root(leaves: DataFrame, size: int, width: int = 12) -> DataFrame:
    """The root as one row ``hash``: aligned subtrees of 2 to the ``width`` nodes are hashed in tasks of their own, then their roots."""

    def subtree(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("idx").to_numpy())
        hashes = [group.column("hash")[int(i)].as_py() for i in order]
        while len(hashes) > 1:  # an odd last node rises unchanged
            hashes = [_node(*hashes[i : i + 2]) if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
        return pa.table({"idx": pa.array([group.column("up")[0].as_py()], pa.int64()), "hash": pa.array(hashes, pa.string())})

    nodes = leaves.select(F.col("idx").cast("long").alias("idx"), "hash")
    while size > 1:
        nodes = nodes.withColumn("up", F.shiftright("idx", width)).groupBy("up").applyInArrow(subtree, "idx long, hash string")
        size = -(-size // (1 << width))
    return nodes.select("hash")


def inclusion_paths(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """For each leaf the siblings from the bottom up: ``idx, level, sibling, hash``; levels without one are skipped."""
    depth = nodes.select("level").distinct()
    wanted = leaves.select(F.col("idx").alias("leaf")).join(F.broadcast(depth))  # a row per level
    place = F.expr("shiftright(leaf, level)")
    wanted = wanted.withColumn("sibling", F.when(place % 2 == 0, place + 1).otherwise(place - 1))
    found = nodes.select("level", F.col("idx").alias("sibling"), "hash")
    return wanted.join(found, ["level", "sibling"]).select(F.col("leaf").alias("idx"), "level", "sibling", "hash")


def root_of(hashes: list[str]) -> str:
    """Root of a few leaf hashes on the driver."""
    if not hashes:
        return hashlib.sha256(b"").hexdigest()
    while len(hashes) > 1:
        paired = [hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest() for a, b in zip(hashes[::2], hashes[1::2], strict=False)]
        hashes = paired + hashes[len(paired) * 2 :]
    return hashes[0]


def verify_inclusion(leaf: str, idx: int, size: int, path: list[str], root: str) -> bool:
    """Whether the path leads from the leaf to the root; malformed input is false."""
    try:
        at, last, node = idx, size - 1, bytes.fromhex(leaf)
        if not 0 <= idx < size:
            return False
        rest = [bytes.fromhex(p) for p in path]
        while last > 0:
            if at % 2 or at < last:
                sibling = rest.pop(0)
                node = hashlib.sha256(b"\x01" + (sibling + node if at % 2 else node + sibling)).digest()
            at, last = at // 2, last // 2
        return not rest and node.hex() == root
    except (ValueError, IndexError, TypeError):
        return False


def segments(entries: DataFrame, length: int) -> DataFrame:
    """Add ``segment`` and ``place``: the first segment holds ``length`` entries, later ones one less after their anchor."""
    later = F.floor((F.col("idx") - length) / (length - 1)) + 1
    segment = F.when(F.col("idx") < length, 0).otherwise(later).cast("long")
    place = F.when(F.col("idx") < length, F.col("idx")).otherwise((F.col("idx") - length) % (length - 1) + 1)
    return entries.withColumns({"segment": segment, "place": place})
