"""Splits of rows into train, val and test as tables of ``row_id`` and ``part``.

Chance is the order of ``md5(seed | row_id)``, the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running


class SplitError(ValueError):
    """A split left a part empty or without positives, or groups on both sides."""


def chance(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def placed_by_chance(rows: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Add each row's place ``k`` (from 1) in its group's hash order and the group's size ``n``.

    Rows are numbered within slices of equal leading hex digits, and slices are
    offset by their counts, so a group of any size is never in one task.
    """
    drawn = rows.withColumn("_c", chance(seed, F.col("row_id"))).withColumn("_s", F.substring("_c", 1, 3))
    counts = drawn.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(*by, "_s", (upto - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("n"))
    local = F.row_number().over(Window.partitionBy(*by, "_s").orderBy("_c", "row_id"))
    return drawn.withColumn("_k", local).join(counts, [*by, "_s"]).withColumn("k", F.col("_before") + F.col("_k")).drop("_c", "_s", "_k", "_before")


def random_stratified(rows: DataFrame, label: str, seed: int, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Within each class the first shares in hash order."""
    ranked = placed_by_chance(rows.where(F.col(label).isNotNull()).select("row_id", label), [label], seed)
    first, second = F.floor(F.col("n") * train + 0.5), F.floor(F.col("n") * (train + val) + 0.5)
    return ranked.select("row_id", F.when(F.col("k") <= first, "train").when(F.col("k") <= second, "val").otherwise("test").alias("part"))


def chronological(rows: DataFrame, at: str, gap: float, train: float = 0.6, val: float = 0.2, by: list[str] = ()) -> DataFrame:
    """The earliest rows train, the next validate; rows within ``gap`` after an earlier part's last go.

    ``by`` makes a timeline of each key. The gap after validation counts from the
    validation rows that were left. Time ties go by ``row_id``. Without ``by`` the
    rows are counted by time first, and the counts are summed over slices of time.
    """
    keys = list(by)
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    counts = rows.groupBy(*keys, at).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    counts = running(counts, keys, [(at, True)], {"upto": F.col("c")}).join(sizes, keys).select(*keys, at, (F.col("upto") - F.col("c")).alias("before"), "n")
    tied = Window.partitionBy(*keys, at).orderBy("row_id")
    ranked = rows.select("row_id", at, *keys).withColumn("place", F.row_number().over(tied)).join(counts, [*keys, at])
    k = F.col("before") + F.col("place")
    first, second = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + val))
    parts = ranked.select("row_id", at, *keys, F.when(k <= first, "train").when(k <= second, "val").otherwise("test").alias("part"))
    ends = parts.groupBy(*keys).agg(F.max(F.when(F.col("part") == "train", F.col(at))).alias("end_train"))
    parts = parts.join(ends, keys).where((F.col("part") != "val") | (F.col(at) > F.col("end_train") + gap))
    ends = parts.groupBy(*keys).agg(F.max(F.when(F.col("part") == "val", F.col(at))).alias("end_val"))
    parts = parts.join(ends, keys).where((F.col("part") != "test") | (F.col(at) > F.coalesce(F.col("end_val"), F.col("end_train")) + gap))
    return parts.select("row_id", "part")


def without_shared_groups(parts: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Validation rows of groups that train, and test rows of groups that train or validate, go."""
    joined = parts.join(rows.select("row_id", group), "row_id")
    first = joined.groupBy(group).agg(F.min(F.when(F.col("part") == "train", 0).when(F.col("part") == "val", 1).otherwise(2)).alias("first"))
    place = F.when(F.col("part") == "train", 0).when(F.col("part") == "val", 1).otherwise(2)
    return joined.join(first, group).where(place == F.col("first")).select("row_id", "part")


def by_groups(rows: DataFrame, group: str, seed: int, test: float = 0.2, val: float = 0.2) -> DataFrame:
    """Whole groups go to a part, in hash order of the groups."""
    groups = rows.select(F.col(group).alias("row_id")).distinct()
    ranked = placed_by_chance(groups.withColumn("_all", F.lit(0)), ["_all"], seed).withColumnRenamed("row_id", group)
    n_test, n_val = F.ceil(F.col("n") * test), F.ceil(F.col("n") * val)
    part = F.when(F.col("k") <= n_test, "test").when(F.col("k") <= n_test + n_val, "val").otherwise("train")
    return rows.select("row_id", group).join(ranked.select(group, part.alias("part")), group).select("row_id", "part")


def cross_corpus(rows: DataFrame, home: Column, seed: int, val: float = 0.2) -> DataFrame:
    """The rows of one corpus train, its first share in hash order validates, and all other rows test."""
    ranked = placed_by_chance(rows.select("row_id", F.coalesce(home, F.lit(False)).alias("_home")), ["_home"], seed)
    return ranked.select("row_id", F.when(~F.col("_home"), "test").when(F.col("k") <= F.floor(F.col("n") * val), "val").otherwise("train").alias("part"))


def leave_one_out(rows: DataFrame, replica: str, seed: int, val: float = 0.2) -> DataFrame:
    """A fold per replica: it tests, whole other replicas validate, the rest train.

    The replicas themselves are paired with each other (few rows), never the rows.
    """
    names = rows.select(replica).distinct()
    others = names.select(F.col(replica).alias("fold")).join(names, F.col("fold") != F.col(replica))
    own = Window.partitionBy("fold")
    ranked = others.withColumns({"k": F.row_number().over(own.orderBy(chance(seed, F.concat("fold", F.lit("|"), replica)), replica)), "n": F.count("*").over(own)})
    part = F.when(F.col("k") <= F.greatest(F.lit(1), F.rint(F.col("n") * val)), "val").otherwise("train")
    plan = ranked.select("fold", replica, part.alias("part")).unionByName(names.select(F.col(replica).alias("fold"), replica, F.lit("test").alias("part")))
    return rows.select("row_id", replica).join(plan, replica).select("fold", "row_id", "part")


def purged(parts: DataFrame, rows: DataFrame, stretch: str) -> DataFrame:
    """Rows of later parts whose stretch already occurs in an earlier part go."""
    return without_shared_groups(parts, rows, stretch)


def checked(parts: DataFrame, rows: DataFrame, label: str, fewest: int = 1) -> DataFrame:
    """The parts again, or ``SplitError`` if one is empty or has too few positives."""
    found = {r.part: r for r in parts.join(rows.select("row_id", label), "row_id").groupBy("part").agg(F.count("*").alias("n"), F.sum(label).alias("pos")).collect()}
    for part in ("train", "val", "test"):
        if part not in found:
            raise SplitError(f"{part} collapsed to an empty partition")
        if (found[part].pos or 0) < fewest:
            raise SplitError(f"{part} has {found[part].pos or 0} positives")
    return parts


def assert_disjoint(parts: DataFrame, rows: DataFrame, group: str) -> None:
    shared = parts.join(rows.select("row_id", group), "row_id").groupBy(group).agg(F.count_distinct("part").alias("k")).where("k > 1").limit(10).collect()
    if shared:
        raise SplitError(f"groups on several sides: {[r[group] for r in shared]}")
