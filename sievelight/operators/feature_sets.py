"""Feature columns by modality: flat projections, feature sets, availability masks, event lists, attributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of each modality, and the flags that say whether a window has it. Host identity is always there.
MODALITIES = ("m1", "m2", "m3", "m4")
WIDTHS = {"m1": 8, "m2": 24, "m3": 2, "m4": 8}
FEATURE_SETS = {"all": MODALITIES, "m2": ("m2",)}


def slice_columns(modality: str) -> list[str]:
    return [f"{modality}_{i}" for i in range(WIDTHS[modality])]


def feature_columns(which: str = "all") -> list[str]:
    """The columns that a model with a feature set sees."""
    if which not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {which!r}: one of {', '.join(FEATURE_SETS)}")
    return [c for m in FEATURE_SETS[which] for c in slice_columns(m)]


def masked_to(rows: DataFrame, which: str) -> DataFrame:
    """Rows in which all that a feature set does not see is zero and marked absent; the width stays."""
    seen = set(feature_columns(which))
    hidden = {c: F.lit(0.0) for m in MODALITIES for c in slice_columns(m) if c not in seen and c in rows.columns}
    absent = {f"has_{m}": F.lit(False) for m in ("m1", "m2", "m4") if m not in FEATURE_SETS[which] and f"has_{m}" in rows.columns}
    return rows.withColumns(hidden | absent)


def any_nonzero(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c) != 0, F.lit(False)) for c in columns))


def quiet(rows: DataFrame, columns: list[str], identity: list[str]) -> Column:
    """Whether all compared columns but those of identity are zero."""
    return ~any_nonzero([c for c in columns if c not in identity])


def derived_mask(rows: DataFrame, slices: dict[str, list[str]]) -> DataFrame:
    """``has_*`` of each modality: some value of its columns is not zero."""
    return rows.withColumns({f"has_{m}": any_nonzero(columns) for m, columns in slices.items()})


def recovered_mask(rows: DataFrame, m1: list[str], m4: list[str], sources: str) -> DataFrame:
    """``has_m1, has_m2, has_m4`` where a present network window may be all zeros: it is what the number of sources leaves over.

    ``mask_error`` marks rows whose number of sources disagrees with the columns.
    """
    one, four = any_nonzero(m1), any_nonzero(m4)
    left = F.rint(F.col(sources)).cast("int") - one.cast("int") - four.cast("int")
    return rows.withColumns({"has_m1": one, "has_m2": left == 1, "has_m4": four, "mask_error": F.coalesce(~left.isin(0, 1), F.lit(True))})


def list_summary(ids: Column, gaps: Column) -> dict[str, Column]:
    """Of a padded event list (id 0 is no event): number of events, of different ones, mean gap."""
    real = F.filter(ids, lambda x: x > 0)
    n = F.size(real)
    total = F.aggregate(F.zip_with(ids, gaps, lambda i, g: F.when(i > 0, g.cast("double")).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return {"n_events": n, "n_distinct": F.size(F.array_distinct(real)), "mean_gap": F.when(n > 0, total / n).otherwise(0.0)}


def flat(rows: DataFrame, keys: list[str], arrays: dict[str, int], ids: str, gaps: str, mask: list[str]) -> DataFrame:
    """One table of numbers: arrays column by column, the event list's summary, and the mask as 0 or 1."""
    values = [F.get(F.col(a), i).cast("double").alias(f"{a}_{i}") for a, n in arrays.items() for i in range(n)]
    summary = [c.cast("double").alias(n) for n, c in list_summary(F.col(ids), F.col(gaps)).items()]
    return rows.select(*keys, *values, *summary, *[F.col(m).cast("double").alias(m) for m in mask])


def four_flags(m1: Column, m2: Column, m4: Column) -> Column:
    """Availability of all four modalities from the three that may be absent."""
    return F.array(m1, m2, F.lit(True), m4)


def uniform_attribution() -> Column:
    return F.array_repeat(F.lit(1.0 / len(MODALITIES)), len(MODALITIES))


def dominant_modality(attribution: Column) -> Column:
    """The name of the largest share; the first of equal ones."""
    return F.element_at(F.array(*map(F.lit, MODALITIES)), F.array_position(attribution, F.array_max(attribution)).cast("int"))


def mean_attribution(rows: DataFrame, by: list[str], attribution: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(F.get(F.col(attribution), i)).alias(m) for i, m in enumerate(MODALITIES)])


def window_summary(rows: DataFrame, replica: str, start: str, y: str, labellable: str, mask: list[str]) -> DataFrame:
    """One row: windows, replicas, positives, labellable ones, share with each modality, mean number present, hours covered."""
    flags = [F.col(m).cast("int") for m in mask]
    n = F.count("*")
    return rows.agg(
        n.alias("n_windows"),
        F.count_distinct(replica).alias("n_replicas"),
        F.sum(F.col(y).cast("int")).alias("n_positive"),
        F.count_if(labellable).alias("n_labellable"),
        F.count_if(~F.col(labellable)).alias("n_unlabellable"),
        *[(F.sum(f) / n).alias(f"rate_{m}") for f, m in zip(flags, mask, strict=True)],
        (F.sum(reduce(lambda a, b: a + b, flags)) / n).alias("mean_present"),
        F.coalesce((F.max(start) - F.min(start)) / 3600, F.lit(0.0)).alias("hours"),
    )
