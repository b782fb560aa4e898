"""How far labels cover what was recorded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import rounded


def coverage(rows: DataFrame, bundle: str, part: str, labelled: Column) -> DataFrame:
    """``bundle, part, n, n_labelled, share, n_parts, n_parts_labelled`` of each part of each bundle, of bundles (part null), and of all (both null).

    One pass: parts are counted first, and both coarser levels are sums of them.
    ``level`` tells the three apart, as names may be null themselves.
    """
    parts = rows.groupBy(F.col(bundle).alias("bundle"), F.col(part).alias("part")).agg(F.count("*").alias("n"), F.count_if(labelled).alias("n_labelled"))
    rolled = parts.rollup("bundle", "part").agg(
        (F.grouping("bundle") + F.grouping("part")).cast("int").alias("gaps"), F.sum("n").alias("n"), F.sum("n_labelled").alias("n_labelled"), F.count("*").alias("n_parts"), F.count_if(F.col("n_labelled") > 0).alias("n_parts_labelled")
    )
    level = F.when(F.col("gaps") == 0, "part").when(F.col("gaps") == 1, "bundle").otherwise("all")
    return rolled.select(level.alias("level"), "bundle", "part", "n", "n_labelled", rounded(F.col("n_labelled") / F.col("n")).alias("share"), "n_parts", "n_parts_labelled")


def coverage_markdown(found: DataFrame, most: int = 500) -> str:
    """Bundles and the total as a table in text; more than ``most`` bundles are refused."""
    rows = found.where("level != 'part'").orderBy(F.col("level") == "all", "bundle").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} bundles")
    lines = ["| bundle | rows | labelled | share | parts | parts labelled |", "|-|-:|-:|-:|-:|-:|"]
    return "\n".join([*lines, *(f"| {'all' if r.level == 'all' else r.bundle or '-'} | {r.n} | {r.n_labelled} | {r.share:.4f} | {r.n_parts} | {r.n_parts_labelled} |" for r in rows)])


def stacked(replicas: dict[str, DataFrame], to: str = "replica") -> DataFrame:
    """The rows of all replicas with the name of theirs; all must have the same columns."""
    if not replicas:
        raise ValueError("no replicas")
    first = sorted(next(iter(replicas.values())).columns)
    for name, rows in replicas.items():
        if sorted(rows.columns) != first:
            raise ValueError(f"{name} has columns {sorted(set(rows.columns) ^ set(first))} that others lack or lacks theirs")
    return reduce(DataFrame.unionByName, (rows.withColumn(to, F.lit(name)) for name, rows in replicas.items()))


def unrecorded(texts: DataFrame, numerals: Column, recorded: DataFrame, rendering: str) -> DataFrame:
    """Rows of ``texts`` with each ``numeral`` of theirs that no recorded rendering equals; both sides are counted before they meet."""
    found = texts.withColumn("numeral", F.explode(F.array_distinct(numerals)))
    known = recorded.select(F.col(rendering).alias("numeral")).distinct()
    missing = found.select("numeral").distinct().join(known, "numeral", "left_anti")
    return found.join(missing, "numeral", "left_semi")
