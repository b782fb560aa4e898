"""Running sums in an order over groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the order; no slice of a group holds much more than its share of all rows.
SLICES = 200


def _slices(rows: DataFrame, key: str, slices: int) -> tuple[list[float], list[float]]:
    """Quantiles of a numeric column, and those of them that are the value of a whole slice or more."""
    found = rows.select(F.col(key).cast("double").alias("v")).approxQuantile("v", [i / slices for i in range(1, slices)], 0.5 / slices)
    return sorted(set(found)), sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})


def _slice_of(key: str, edges: list[float], heavy: list[float]) -> Column:
    """Twice the number of quantiles below the value; a value that fills slices has a number of its own."""
    v = F.col(key).cast("double")
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < v)) if edges else F.lit(0)
    return 2 * below + (F.when(v.isin(heavy), 1).otherwise(0) if heavy else F.lit(0))


def running(rows: DataFrame, by: list[str], order: list[tuple[str, bool]], sums: dict[str, Column], slices: int = SLICES, slice_of: Column | None = None) -> DataFrame:
    """Add for each name in ``sums`` its running sum within ``by``, the own row included.

    ``order`` names numeric columns and whether they ascend; together they must
    order the rows of a group. Rows are cut into slices at quantiles of the first
    column, and where one value fills slices at those of the second. Sums run
    within slices and are offset by the sums of the slices before. Nulls come
    first in ascending and last in descending order. ``slice_of``, a whole number
    that never falls as the first column rises, spares the look at the quantiles.
    """
    cuts = []
    if slice_of is not None:
        rows, cuts = rows.withColumn("_slice0", slice_of if order[0][1] else -slice_of), ["_slice0"]
    for i, (key, up) in enumerate([] if cuts else order[:2]):
        edges, heavy = _slices(rows, key, slices)
        cut = _slice_of(key, edges, heavy)
        if i:
            first_heavy = F.pmod(F.col("_slice0"), F.lit(2)) == 1
            cut = F.when(first_heavy, cut).otherwise(0)
        cuts.append(f"_slice{i}")
        rows = rows.withColumn(f"_slice{i}", cut if up else -cut)
        if not heavy:
            break
    kept = [c for c in rows.columns if c not in cuts]
    rows = rows.select(*kept, *cuts, *(x.alias(f"_add_{n}") for n, x in sums.items()))
    ordered = [F.asc(c) if up else F.desc(c) for c, up in order]
    local = Window.partitionBy(*by, *cuts).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(*cuts).rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    cells = rows.groupBy(*by, *cuts).agg(*(F.sum(f"_add_{n}").alias(n) for n in sums))
    cells = cells.select(*(F.col(c).alias(f"_of_{c}") for c in [*by, *cuts]), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    inside = rows.select(*kept, *cuts, *(F.sum(f"_add_{n}").over(local).alias(f"_here_{n}") for n in sums))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, *cuts]]
    return inside.join(cells, same).select(*kept, *((F.col(f"_before_{n}") + F.col(f"_here_{n}")).alias(n) for n in sums))


def odds_slice(share: str) -> Column:
    """Slices of numbers between 0 and 1, finer towards both ends; one slice each for 0 and below and for 1 and above."""
    p = F.col(share).cast("double")
    odds = F.floor(16 * F.log2(p / (1 - p)))
    return F.when(p <= 0, -2000).when(p >= 1, 2000).otherwise(F.coalesce(F.greatest(F.least(odds, F.lit(1999)), F.lit(-1999)), F.lit(-2001))).cast("int")
