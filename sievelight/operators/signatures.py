"""Digests of sets of rows that do not depend on their order, and steps fitted on a set that they name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import rounded


class TrainingSetChanged(ValueError):
    """A fitted step is asked to go with a training set that is not the one it was fitted on."""


def set_digest(key: Column) -> Column:
    """An aggregate: the count of rows and the sums of the four 32-bit parts of their keys' hashes.

    Rows that repeat count each time. Sums are whole numbers, so any grouping and
    order of the rows gives the same text.
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    parts = [F.coalesce(F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")), F.lit(0)).cast("string") for i in range(4)]
    return F.concat_ws("-", F.count(key.isNull()).cast("string"), *parts)


def signatures(parts: DataFrame, by: list[str], key: str = "row_id") -> DataFrame:
    """``by, signature`` of the sets of rows."""
    return parts.groupBy(*by).agg(set_digest(F.col(key)).alias("signature"))


@dataclass(frozen=True)
class Scaler:
    """Median and spread of each column over the training rows, and the signature of those."""

    middle: dict[str, float]
    spread: dict[str, float]
    signature: str

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: rounded((F.col(c) - F.lit(self.middle[c])) / F.lit(self.spread[c])) for c in self.middle})

    def for_training(self, train: DataFrame, key: str = "row_id") -> Scaler:
        """This scaler, or ``TrainingSetChanged`` if ``train`` is not the set it was fitted on."""
        check_signature(self.signature, train, key)
        return self


def check_signature(signature: str, train: DataFrame, key: str = "row_id") -> None:
    found = train.agg(set_digest(F.col(key)).alias("s")).first().s
    if found != signature:
        raise TrainingSetChanged(f"fitted on {signature}, asked to go with {found}")


def fit_scaler(train: DataFrame, columns: list[str], key: str = "row_id") -> Scaler:
    """One aggregate over the training rows; a spread up to 1e-12 counts as 1."""
    quartiles = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns]
    r = train.agg(set_digest(F.col(key)).alias("_signature"), *quartiles).first()
    if any(r[c] is None for c in columns):
        raise ValueError("no training rows")
    wide = {c: r[c][2] - r[c][0] for c in columns}
    return Scaler({c: r[c][1] for c in columns}, {c: w if w > 1e-12 else 1.0 for c, w in wide.items()}, r["_signature"])
