"""Log templates: messages with variable parts masked, alike ones merged.

A tree of fixed depth (replica, number of tokens, first token) leads to leaves
that are mined apart from each other, in a batch (here) or as keyed state of a
stream (``streaming.templates``), by the same rule.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import masked_template
from ..tables import staged
from .ranges import running

#: Share of tokens that must agree; open templates of a leaf (where the reference bounds those of a replica).
ALIKE, MOST = 0.6, 4096
#: Buckets of leaves; a leaf is in one of them.
BUCKETS = 4096
WILD = "<*>"


class Leaf:
    """Templates of one leaf. A message joins the oldest open one that agrees in ``alike`` of its tokens; tokens that differ become wild.

    Of ``most`` open templates the one that was joined longest ago is closed for
    another: it keeps its number and its messages and is joined no more.
    """

    def __init__(self, size: int, alike: float = ALIKE, most: int = MOST):
        self.size, self.alike, self.most = size, alike, most
        self.codes = {WILD: 0}
        self.known = np.zeros((size, 64), np.int32)  # a template's tokens in each column
        self.numbers = np.zeros(64, np.int64)
        self.joined = np.zeros(64, np.int64)
        self.open = 0
        self.clock = 0
        self.next = 0
        self.closed: dict[int, str] = {}
        self.changed: set[int] = set()  # columns

    def _coded(self, tokens: Sequence[str]) -> np.ndarray:
        return np.array([self.codes.setdefault(t, len(self.codes)) for t in tokens], np.int32)

    def _column(self) -> int:
        if self.open == self.most:
            i = int(self.joined[: self.open].argmin())
            self.closed[int(self.numbers[i])] = self.text(i)
            return i
        if self.open == self.known.shape[1]:
            more = min(2 * self.open, self.most) - self.open
            self.known = np.hstack([self.known, np.zeros((self.size, more), np.int32)])
            self.numbers, self.joined = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.numbers, self.joined))
        self.open += 1
        return self.open - 1

    def restore(self, number: int, text: str, joined: int) -> None:
        i = self._column()
        self.known[:, i], self.numbers[i], self.joined[i] = self._coded(text.split(" ")), number, joined

    def text(self, i: int) -> str:
        words = list(self.codes)
        return " ".join(words[c] for c in self.known[:, i])

    def place(self, masked: str) -> int:
        """The number of the message's template, a new one if none fits."""
        tokens = self._coded(masked.split(" "))
        fits = np.flatnonzero((self.known[:, : self.open] == tokens[:, None]).sum(axis=0) >= self.alike * self.size)
        if len(fits):
            i = int(fits[self.numbers[fits].argmin()])
            self.known[self.known[:, i] != tokens, i] = 0
        else:
            i = self._column()
            self.known[:, i], self.numbers[i] = tokens, self.next
            self.next += 1
        self.joined[i] = self.clock
        self.clock += 1
        self.changed.add(i)
        return int(self.numbers[i])

    def texts(self) -> dict[int, str]:
        words = list(self.codes)
        return self.closed | {int(self.numbers[i]): " ".join(words[c] for c in self.known[:, i]) for i in range(self.open)}


def leaves(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines with ``masked`` and the ``size`` and ``head`` that lead to their leaf."""
    masked = lines.withColumn("masked", masked_template(F.col("message")))
    tokens = F.split("masked", " ")
    return masked.withColumns({"size": F.size(tokens), "head": tokens[0]})


def _distinct(lines: DataFrame, by: list[str], order: Sequence[str]) -> DataFrame:
    counts = leaves(lines, by).groupBy(*by, "size", "head", "masked").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))
    replica = F.to_json(F.struct(*by)) if by else F.lit("")
    keyed = counts.select(replica.alias("_replica"), "size", "head", "masked", "n", *(F.col(f"first.{c}").cast("long").alias(f"first{i}") for i, c in enumerate(order)), *by)
    return keyed.withColumn("bucket", F.pmod(F.xxhash64("_replica", "size", "head"), F.lit(BUCKETS)))


def _mined(bucket: pa.Table, n_order: int, alike: float, most: int):
    """Leaf by leaf the rows in order of first sight, each with its template's number, and the templates' texts."""
    groups: dict[tuple, list[int]] = {}
    replicas, sizes, heads, masked = (bucket.column(c).to_pylist() for c in ("_replica", "size", "head", "masked"))
    firsts = list(zip(*(bucket.column(f"first{i}").to_pylist() for i in range(n_order)), strict=True))
    for i, key in enumerate(zip(replicas, sizes, heads, strict=True)):
        groups.setdefault(key, []).append(i)
    for key, rows in sorted(groups.items()):
        rows.sort(key=lambda i: (firsts[i], masked[i]))
        leaf = Leaf(key[1], alike, most)
        numbers = [leaf.place(masked[i]) for i in rows]
        yield rows, numbers, leaf.texts(), firsts


def assigned(lines: DataFrame, by: list[str] = (), order: Sequence[str] = ("seq",), alike: float = ALIKE, most: int = MOST) -> DataFrame:
    """``by, masked, n, number, template`` of the distinct masked messages; numbers count the templates of a leaf."""
    by = list(by)

    def run(bucket: pa.Table) -> pa.Table:
        at, number, text = [], [], []
        for rows, numbers, texts, _ in _mined(bucket, len(order), alike, most):
            at += rows
            number += numbers
            text += [texts[k] for k in numbers]
        return bucket.select([*by, "masked", "n"]).take(pa.array(at, pa.int64())).append_column("number", pa.array(number, pa.int64())).append_column("template", pa.array(text, pa.string()))

    kinds = "".join(f"`{c}` {t}, " for c, t in lines.dtypes if c in by)
    return _distinct(lines, by, order).groupBy("bucket").applyInArrow(run, f"{kinds}masked string, n long, number long, template string")


def summary(lines: DataFrame, by: list[str] = (), order: Sequence[str] = ("seq",), alike: float = ALIKE, most: int = MOST) -> DataFrame:
    """``by, template, n`` (lines) and ``template_id``, from 1 in order of first sight, of each template.

    ``lines`` have ``message`` and the whole numbers ``order`` (their order of
    arrival). Distinct masked messages are counted by Spark and mined leaf by leaf
    in order of first sight; templates of a leaf that end up equal are one. Lines
    that repeat a place in the order go by their texts. Only templates leave the
    tasks, and they are numbered over slices of the order.
    """
    by = list(by)
    n_order = len(order)

    def run(bucket: pa.Table) -> pa.Table:
        counts = bucket.column("n").to_pylist()
        found: dict[tuple[int, str], list] = {}
        for leaf, (rows, numbers, texts, firsts) in enumerate(_mined(bucket, n_order, alike, most)):
            for i, k in zip(rows, numbers, strict=True):
                own = found.setdefault((leaf, texts[k]), [0, firsts[i], i])
                own[0] += counts[i]
        rows = list(found.values())
        own = bucket.select(by).take(pa.array([r[2] for r in rows], pa.int64()))
        out = {c: own.column(c) for c in by} | {"template": pa.array([t for _, t in found], pa.string()), "n": pa.array([r[0] for r in rows], pa.int64())}
        out |= {f"first{i}": pa.array([r[1][i] for r in rows], pa.int64()) for i in range(n_order)}
        which = bucket.column("bucket")[0].as_py()
        return pa.table(out | {"place": pa.array([which * (1 << 40) + i for i in range(len(rows))], pa.int64())})

    kinds = "".join(f"`{c}` {t}, " for c, t in lines.dtypes if c in by)
    numbers = [f"first{i}" for i in range(n_order)] + ["place"]
    merged = _distinct(lines, by, order).groupBy("bucket").applyInArrow(run, f"{kinds}template string, n long, {', '.join(f'{c} long' for c in numbers)}")
    merged = staged(merged, "templates")  # read for the slices and for the numbers
    return running(merged, by, [(c, True) for c in numbers], {"template_id": F.lit(1)}).select(*by, "template", "n", "template_id")


def mine(lines: DataFrame, by: list[str] = (), order: Sequence[str] = ("seq",), alike: float = ALIKE, most: int = MOST) -> DataFrame:
    """``by, masked, n, template, template_id`` of the distinct masked messages; see ``summary`` for the ids."""
    by = list(by)
    ids = summary(lines, by, order, alike, most).select(*(F.col(c).alias(f"_of_{c}") for c in by), F.col("template").alias("_template"), "template_id")
    found = assigned(lines, by, order, alike, most)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("template") == F.col("_template")]
    return found.join(ids, same).select(*by, "masked", "n", "template", "template_id")


def window_features(lines: DataFrame, found: DataFrame, by: list[str], replica: list[str] = (), at: str = "seq") -> DataFrame:
    """Eight features of each window's templates; new ones are those whose first line in the replica is in the window."""
    replica = list(replica)
    tagged = lines.withColumn("masked", masked_template(F.col("message"))).join(found.select(*replica, "masked", "template_id"), [*replica, "masked"])
    first = tagged.groupBy(*replica, "template_id").agg(F.min(at).alias("born"))
    tagged = tagged.join(first, [*replica, "template_id"])
    counts = tagged.groupBy(*by, "template_id").agg(F.count("*").alias("c"), F.min(at).alias("s"), F.max((F.col(at) == F.col("born")).cast("int")).alias("new"), F.sum(F.length("message")).alias("chars"), F.max(F.length("message")).alias("longest"))
    n = F.sum("c")
    return counts.groupBy(*by).agg(
        n.alias("n_events"),
        F.count("*").alias("n_templates"),
        (F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("entropy"),
        F.max_by("template_id", F.struct("c", -F.col("s"))).alias("dominant_id"),
        (F.max("c") / n).alias("dominant_frac"),
        F.sum("new").alias("n_new"),
        (F.sum("chars") / n).alias("mean_length"),
        F.max("longest").alias("max_length"),
    )
