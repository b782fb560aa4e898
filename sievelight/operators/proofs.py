"""Consistency proofs, signed tree heads and chains of segments."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ledger import root_of


def blocks_of(start: int, stop: int) -> list[tuple[int, int]]:
    """Aligned power-of-two blocks ``(level, idx)`` that cover leaves start to stop, from the left."""
    out = []
    while start < stop:
        level = (start & -start).bit_length() - 1 if start else (stop - start).bit_length() - 1
        while start + (1 << level) > stop:
            level -= 1
        out.append((level, start >> level))
        start += 1 << level
    return out


def _folded(hashes: list[str]) -> str:
    """The hash over blocks of falling size, folded from the right."""
    node = hashes[-1]
    for h in reversed(hashes[:-1]):
        node = hashlib.sha256(b"\x01" + bytes.fromhex(h) + bytes.fromhex(node)).hexdigest()
    return node


def consistency_proof(nodes: DataFrame, old: int, new: int) -> dict[str, list[str]]:
    """Hashes of the blocks of the old tree, and of those that the new tree adds (each at most two per level).

    ``nodes`` are the new tree's complete nodes. Only the named blocks are read.
    """
    first, added = blocks_of(0, old), blocks_of(old, new)
    wanted = {*first, *added}
    levels = {level for level, _ in wanted}
    rows = nodes.where(F.col("level").isin(*levels) & F.struct("level", "idx").isin(*[F.struct(F.lit(a).alias("level"), F.lit(b).cast("long").alias("idx")) for a, b in wanted])).collect()
    known = {(r.level, r.idx): r.hash for r in rows}
    return {"old": [known[b] for b in first], "added": [known[b] for b in added]}


def verify_consistency(old: int, new: int, old_root: str, new_root: str, proof: dict[str, list[str]]) -> bool:
    """Whether the new tree begins with all of the old one; malformed proofs are false."""
    try:
        first, added = blocks_of(0, old), blocks_of(old, new)
        if len(first) != len(proof["old"]) or len(added) != len(proof["added"]) or not 0 < old <= new:
            return False
        if _folded(proof["old"]) != old_root:
            return False
        stack: list[tuple[int, int, str]] = []
        for (level, idx), h in zip([*first, *added], [*proof["old"], *proof["added"]], strict=True):
            stack.append((level, idx, h))
            while len(stack) > 1 and stack[-1][0] == stack[-2][0] and stack[-2][1] % 2 == 0 and stack[-1][1] == stack[-2][1] + 1:
                (lv, i, left), (_, _, right) = stack[-2:]
                stack[-2:] = [(lv + 1, i // 2, hashlib.sha256(b"\x01" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest())]
        return _folded([h for _, _, h in stack]) == new_root
    except (KeyError, ValueError, TypeError, IndexError):
        return False


def path_ranges(first: int, size: int) -> list[tuple[int, int]]:
    """Ranges of leaves whose subtree hashes show that the tree over ``first`` leaves begins the tree over ``size`` (RFC 6962), in the order of a proof."""
    if not 0 < first < size:
        return []
    low, high, whole, out = 0, size, True, []
    while first != high:
        middle = low + (1 << (high - low - 1).bit_length() - 1)
        if first <= middle:
            out.append((middle, high))
            high = middle
        else:
            out.append((low, middle))
            low, whole = middle, False
    return ([] if whole else [(low, high)]) + out[::-1]


def consistency_path(nodes: DataFrame, first: int, size: int) -> list[str]:
    """The proof of RFC 6962 that the tree over ``first`` leaves begins the one over ``size``.

    ``nodes`` (``level, idx, hash``) are the complete nodes of the larger tree;
    only the aligned blocks of the proof's ranges are read, a few for each level.
    """
    ranges = path_ranges(first, size)
    blocks = {r: blocks_of(*r) for r in ranges}
    wanted = {b for bs in blocks.values() for b in bs}
    if not wanted:
        return []
    named = F.struct("level", "idx").isin(*[F.struct(F.lit(a).alias("level"), F.lit(b).cast("long").alias("idx")) for a, b in wanted])
    known = {(r.level, r.idx): r.hash for r in nodes.where(F.col("level").isin(*{a for a, _ in wanted}) & named).collect()}
    return [_folded([known[b] for b in blocks[r]]) for r in ranges]


def verify_consistency_path(first: int, first_root: str, size: int, size_root: str, path: list[str]) -> bool:
    """Whether a proof of RFC 6962 shows that the old tree begins the new one; malformed proofs are false."""
    try:
        if not 0 <= first <= size:
            return False
        if first == 0 or first == size:
            return not path and (first == 0 or first_root == size_root)
        ranges = path_ranges(first, size)
        if len(ranges) != len(path) or any(len(bytes.fromhex(h)) != 32 for h in path):
            return False
        known = dict(zip(ranges, path, strict=True))
        if all(low >= first for low, _ in ranges):
            known[0, first] = first_root  # the old tree is a whole subtree of the new one

        def root(low: int, high: int) -> str:
            if (low, high) in known:
                return known[low, high]
            middle = low + (1 << (high - low - 1).bit_length() - 1)
            return hashlib.sha256(b"\x01" + bytes.fromhex(root(low, middle)) + bytes.fromhex(root(middle, high))).hexdigest()

        return root(0, first) == first_root and root(0, size) == size_root
    except (ValueError, TypeError, IndexError, RecursionError, AttributeError):
        return False


class Signer:
    """Ed25519 keys and signatures of the JVM that runs the session."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._pair = self._jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()

    def sign(self, payload: bytes) -> str:
        s = self._jvm.java.security.Signature.getInstance("Ed25519")
        s.initSign(self._pair.getPrivate())
        s.update(payload)
        return bytes(s.sign()).hex()

    def verify(self, payload: bytes, signature: str) -> bool:
        try:
            s = self._jvm.java.security.Signature.getInstance("Ed25519")
            s.initVerify(self._pair.getPublic())
            s.update(payload)
            return bool(s.verify(bytes.fromhex(signature)))
        except Exception:  # noqa: BLE001 - a malformed signature is a wrong one
            return False


def tree_head(log_id: str, size: int, root: str, clock: int) -> bytes:
    return json.dumps({"log_id": log_id, "root": root, "timestamp": clock, "tree_size": size}, sort_keys=True, separators=(",", ":")).encode()


def segment_roots(entries: DataFrame) -> DataFrame:
    """Root of each segment's own entries ``segment, place, hash``; a task holds one segment's hashes, whose number is the segment length."""
    import pyarrow as pa

    def root(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("place").to_pylist(), group.column("hash").to_pylist(), strict=True))
        return pa.table({"segment": [group.column("segment")[0].as_py()], "n": [len(rows)], "root": [root_of([h for _, h in rows])]})

    return entries.groupBy("segment").applyInArrow(root, "segment long, n long, root string")


def chain_breaks(chain: DataFrame) -> DataFrame:
    """Segments ``segment, root, anchor_root`` whose anchor is not the root before them."""
    line = Window.partitionBy(F.lit(0)).orderBy("segment")  # one row per segment
    return chain.withColumn("before", F.lag("root").over(line)).where("segment > 0 AND NOT (anchor_root <=> before)")
