"""Leakage controls: duplicates, near duplicates, twins across a split, shared groups, floors, permutation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import rounded
from .ranges import odds_slice, running
from .splits import chance, placed_by_chance


def exact_duplicates(rows: DataFrame, columns: list[str], by: list[str] = (), copies: str | None = None) -> DataFrame:
    """Distinct rows, excess copies and members of repeated rows, floats compared at six digits.

    A row stands for as many as its column ``copies`` says, for one without it.
    """
    keys = [F.rint(F.col(c) * 1e6).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes if c in columns]
    groups = rows.groupBy(*by, *keys).agg((F.sum(copies) if copies else F.count("*")).alias("c"))
    n = F.sum("c")
    out = [n.alias("n"), F.count("*").alias("n_unique"), F.sum(F.col("c") - 1).alias("excess"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("members"), rounded(F.sum(F.col("c") - 1) / F.greatest(n, F.lit(1))).alias("fraction")]
    return groups.groupBy(*by).agg(*out) if by else groups.agg(*out)


def twins(test: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Test rows whose key also occurs in train."""
    return test.join(train.select(*keys).distinct(), keys, "left_semi")


def simhash(rows: DataFrame, vector: str, bits: int = 32, seed: int = 0, to: str = "signature") -> DataFrame:
    """Add the signs of random projections of the standardised vector as a number; the matrix depends on seed and size alone."""
    return rows.withColumn(to, simhash_code(rows, vector, bits, seed))


def simhash_code(rows: DataFrame, vector: str, bits: int = 32, seed: int = 0) -> Column:
    """The number that ``simhash`` adds, standardised by ``rows``, for any table with the vector."""
    size = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first()
    if size is None:
        return F.lit(None).cast("long")
    d = size.d
    stats = rows.agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col(vector)[i].cast("double")).alias(f"s{i}") for i in range(d)]).first()
    mean, std = [stats[f"m{i}"] for i in range(d)], [stats[f"s{i}"] or 1.0 for i in range(d)]
    matrix = np.random.default_rng(seed).standard_normal((d, bits))
    scaled = matrix / np.array(std)[:, None]
    shift = np.array(mean) @ scaled
    code = F.lit(0).cast("long")
    for b in range(bits):
        weights = F.array(*[F.lit(float(w)) for w in scaled[:, b]])
        dot = F.aggregate(F.zip_with(F.col(vector), weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
        code = code + F.when(dot > float(shift[b]), F.lit(1 << b)).otherwise(F.lit(0)).cast("long")
    return code


def bucket_report(rows: DataFrame, key: str, copies: str | None = None) -> DataFrame:
    """Rows, distinct buckets, and rows beyond the first of their bucket; a row stands for ``copies`` of them, if named."""
    groups = rows.groupBy(key).agg((F.sum(copies) if copies else F.count("*")).alias("c"))
    return groups.agg(F.sum("c").alias("n"), F.count("*").alias("buckets"), F.sum(F.col("c") - 1).alias("near"))


def group_overlap(parts: DataFrame, group: str) -> DataFrame:
    """For each two parts the number of groups they share."""
    pairs = parts.select(group, "part").distinct()
    other = pairs.select(group, F.col("part").alias("other"))
    return pairs.join(other, group).where("part < other").groupBy("part", "other").agg(F.count("*").alias("shared"))


def pattern_cells(rows: DataFrame, pattern: list[str], label: str, folds: int, seed: int) -> DataFrame:
    """``pattern, fold, p, q, score``: positives and negatives of each fold's rows of a pattern, and the rate of positives of the pattern's rows in the other folds."""
    own = rows.groupBy(*pattern, _floor_fold(folds, seed).alias("fold")).agg(F.count("*").alias("n"), F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    all_folds = Window.partitionBy(*pattern)
    n, p = F.sum("n").over(all_folds) - F.col("n"), F.sum("p").over(all_folds) - F.col("p")
    return own.select(*pattern, "fold", "p", "q", rounded(F.when(n > 0, p / n).otherwise(0.0)).alias("score"))


def _floor_fold(folds: int, seed: int) -> Column:
    return (F.conv(F.substring(chance(seed, F.col("row_id")), 1, 6), 16, 10).cast("long") % folds).cast("int")


def pattern_floor(rows: DataFrame, pattern: list[str], label: str, folds: int, seed: int) -> DataFrame:
    """Out-of-fold rate of positives of each row's pattern: what a detector could know from the pattern alone."""
    cells = pattern_cells(rows, pattern, label, folds, seed).select(*pattern, "fold", "score")
    return rows.withColumn("fold", _floor_fold(folds, seed)).join(cells, [*pattern, "fold"]).select("row_id", F.col(label).alias("y"), "score")


def permuted_labels(rows: DataFrame, label: str, seed: int) -> DataFrame:
    """The same labels in another order: the k-th row of one hash order takes the label of the k-th row of another."""
    own = rows.select("row_id", label)
    left = placed_by_chance(own, [], seed + 1).select("row_id", "k")
    right = placed_by_chance(own, [], seed).select("k", F.col(label).alias("y"))
    return left.join(right, "k").select("row_id", "y")


def dealt_labels(rows: DataFrame, label: str, seed: int) -> Column:
    """The labels permuted, as a column of ``rows``: they are dealt to the rows in hash order, all of the smallest first.

    ``row_id`` must be unique. The order is made of chance alone, so every
    permutation of the labels is as likely as another. Only counts by slice and
    the few rows at which the label changes are looked up: no row moves.
    """
    labels = sorted(((r[0], r[1]) for r in rows.groupBy(label).count().collect()), key=lambda x: (x[0] is not None, x[0]))  # the few labels
    drawn = rows.select(chance(seed, F.col("row_id")).alias("c")).withColumn("s", F.substring("c", 1, 3))
    last, upto = {}, 0
    ends = [upto := upto + n for _, n in labels][:-1]
    before = 0
    for s, n in sorted((r.s, r["count"]) for r in drawn.groupBy("s").count().collect()) if ends else ():  # 4,096 at most
        last |= {(s, e - before): e for e in ends if before < e <= before + n}
        before += n
    place = F.row_number().over(Window.partitionBy("s").orderBy("c"))
    there = drawn.where(F.col("s").isin([s for s, _ in last])).withColumn("k", place).where(F.col("k").isin([k for _, k in last])) if last else None
    at = {last[r.s, r.k]: r.c for r in there.collect() if (r.s, r.k) in last} if last else {}
    own, kind = chance(seed, F.col("row_id")), rows.schema[label].dataType
    value = lambda v: F.lit(v).cast(kind)
    out = None
    for e, (v, _) in zip(ends, labels, strict=False):
        out = F.when(own <= at[e], value(v)) if out is None else out.when(own <= at[e], value(v))
    rest = value(labels[-1][0] if labels else None)
    return rest if out is None else out.otherwise(rest)


def identical_columns(rows: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
    """Pairs of columns that are equal in every row, constant ones left out; one pass over the rows."""
    ends = rows.agg(*[F.struct(F.min(c), F.max(c), F.sum(c)).alias(c) for c in columns]).first()
    alike = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if tuple(ends[a]) == tuple(ends[b]) and ends[a][0] != ends[a][1]]
    if not alike:
        return []
    same = rows.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"{i}") for i, (a, b) in enumerate(alike)]).first()
    return [pair for i, pair in enumerate(alike) if same[i]]


def severity(value: Column, warn: float, fail: float) -> Column:
    return F.when(value > fail, "fail").when(value > warn, "warn").otherwise("pass")


def leave_one_out_floors(rows: DataFrame, replica: str, label: str, patterns: dict[str, list[str]]) -> DataFrame:
    """``replica, seen, n, positives, ap``: what the given columns alone are worth when a replica is held out.

    A row's score is the share of positives among the other replicas' rows with
    its pattern of values, or among all of theirs if they have none. The others'
    counts are all counts less the replica's own, so rows are read once for each
    set of columns and no fold is ever built. Folds of one class have no score.
    """
    out = None
    y = F.col(label).cast("long")
    for name, columns in patterns.items():
        pattern = F.to_json(F.struct(*columns))
        cells = rows.groupBy(F.col(replica).alias("replica"), pattern.alias("pattern")).agg(F.count("*").alias("n"), F.sum(y).alias("p"))
        all_of = cells.groupBy("pattern").agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
        own = cells.groupBy("replica").agg(F.sum("n").alias("own_n"), F.sum("p").alias("own_p"))
        whole = own.agg(F.sum("own_n").alias("whole_n"), F.sum("own_p").alias("whole_p"))
        held = cells.join(all_of, "pattern").join(F.broadcast(own), "replica").join(F.broadcast(whole))  # one row
        rate = F.coalesce(F.try_divide(F.col("all_p") - F.col("p"), F.col("all_n") - F.col("n")), F.try_divide(F.col("whole_p") - F.col("own_p"), F.col("whole_n") - F.col("own_n")))
        points = held.withColumn("score", rounded(rate, 9)).groupBy("replica", "score").agg(F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"), F.max("own_n").alias("n"), F.max("own_p").alias("positives"))
        upto = running(points, ["replica"], [("score", False)], {"tp": F.col("p"), "fp": F.col("q")}, slice_of=odds_slice("score"))
        step = F.col("p") / F.col("positives") * (F.col("tp") / (F.col("tp") + F.col("fp")))
        both = (F.max("positives") > 0) & (F.max("positives") < F.max("n"))
        found = upto.groupBy("replica").agg(F.max("n").alias("n"), F.max("positives").alias("positives"), F.when(both, rounded(F.sum(F.when(F.col("positives") > 0, step)))).alias("ap"))
        found = found.select("replica", F.lit(name).alias("seen"), "n", "positives", "ap")
        out = found if out is None else out.unionByName(found)
    return out


def positives_by_pattern(rows: DataFrame, label: str, flags: list[str], host: str) -> DataFrame:
    """``code, n, share, n_hosts, most_on_one_host`` of the positive rows by pattern of available inputs (a bit for each flag)."""
    code = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(flags)), F.lit(0))
    hosts = rows.where(F.col(label) == 1).groupBy(code.alias("code"), F.col(host).alias("host")).agg(F.count("*").alias("c"))
    by_code = hosts.groupBy("code").agg(F.sum("c").alias("n"), F.count("*").alias("n_hosts"), F.max("c").alias("top"))
    whole = hosts.agg(F.sum("c").alias("whole"))
    return by_code.join(F.broadcast(whole)).select("code", "n", rounded(F.col("n") / F.col("whole")).alias("share"), "n_hosts", rounded(F.col("top") / F.col("n")).alias("most_on_one_host"))  # one row
