"""CSV uploads: delimiter, header, row checks, drift, and the scored result."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts that mean a positive or a negative label, and header names of label columns.
POSITIVE = ("1", "1.0", "true", "yes", "attack", "malicious", "anomaly")
NEGATIVE = ("0", "0.0", "false", "no", "benign", "normal")
LABELS = ("label", "y", "is_attack", "target")


class UploadError(ValueError):
    """An upload that cannot be read at all."""


def normalised(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lstrip("﻿").lower()).strip("_")


def sniffed(head: str) -> str:
    """The delimiter of the first line: the one of comma, semicolon, tab, bar that is most frequent."""
    if "\x00" in head:
        raise UploadError("the file is binary")
    first = head.splitlines()[0] if head else ""
    return max(",;\t|", key=first.count)


def read_csv(spark: SparkSession, path: str, features: list[str]) -> tuple[DataFrame, str | None]:
    """Rows as texts with ``row_id`` and normalised headers, and the label column's name if there is one.

    Features may come in any order; one that is missing or doubled raises; unknown columns are kept.
    """
    head = "\n".join(r.value for r in spark.read.text(path).limit(1).collect())
    rows = spark.read.csv(path, header=True, sep=sniffed(head), multiLine=True, quote='"', escape='"', enforceSchema=False)
    names = [normalised(c) for c in next(csv.reader([head], delimiter=sniffed(head)), [])]
    if doubled := sorted({n for n in names if names.count(n) > 1}):
        raise UploadError(f"columns given twice: {doubled}")
    if missing := [f for f in features if f not in names]:
        raise UploadError(f"columns missing: {missing}")
    rows = rows.toDF(*names)
    label = next((n for n in LABELS if n in names), None)
    return rows.withColumn("row_id", F.monotonically_increasing_id()), label


def parsed(rows: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Features as doubles, ``errors`` naming the cells that are no finite numbers or no label, and ``y`` from the label's text (null if blank)."""
    number = {c: F.trim(F.col(c)).try_cast("double") for c in features}
    wrong = {c: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)) for c, x in number.items()}
    said = F.lower(F.trim(F.coalesce(F.col(label), F.lit("")))) if label else F.lit("")
    y = F.when(said.isin(*POSITIVE), True).when(said.isin(*NEGATIVE), False)
    no_label = [F.when((said != "") & y.isNull(), F.lit(label))] if label else []
    errors = F.array_compact(F.array(*[F.when(w, F.lit(c)) for c, w in wrong.items()], *no_label))
    kept = [c for c in rows.columns if c not in ("y", "errors") and c not in features]
    return rows.select(*kept, y.alias("y"), errors.alias("errors"), *[F.when(~wrong[c], x).alias(c) for c, x in number.items()])


def first_errors(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.where(F.size("errors") > 0).orderBy("row_id").limit(n)


def drift(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Per feature how many values lie outside its known range, most first."""
    counts = rows.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in ranges.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("outside")) for c in ranges])).alias("d")).select("d.*").orderBy(F.desc("outside"), "column")


def with_scores(rows: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every uploaded row with its score and verdict, ``not scored`` where there is none."""
    joined = rows.join(scores.select("row_id", "score"), "row_id", "left")
    return joined.withColumn("verdict", F.when(F.col("score").isNull(), "not scored").when(F.col("score") >= threshold, "attack").otherwise("benign"))


def templates(rows: DataFrame, flag: str, n: int) -> DataFrame:
    """A few rows to start from, flagged ones first."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(flag), "row_id"))
    return rows.orderBy(F.desc(flag), "row_id").limit(n).withColumn("place", place)
