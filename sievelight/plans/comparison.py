"""Queries that compare a random split of host windows with a chronological one, by set of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison, splits
from ..operators.windows import network_features, tumbled
from ..tables import discard, staged
from .base import EVENTS, WIDE, events, query, r
from .evaluation import CHRON, GAP, R0, SEED

COUNTS, CALENDAR = ["n_events", "n_click", "n_purchase"], ["quarter", "weekday"]
SETS = {"counts": COUNTS, "calendar": CALENDAR, "counts and calendar": [*COUNTS, *CALENDAR]}


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host windows with counts and with what the calendar alone says; those with an error are positive."""
    rows = network_features(tumbled(events(spark, sf_dir), WIDE), ["host", "window_start"])
    at = F.col("window_start").cast("long")
    calendar = ((at / WIDE).cast("long") % 4).alias("quarter"), ((at / 86400).cast("long") % 7).alias("weekday")
    return rows.select(F.concat_ws("|", "host", "window_start").alias("row_id"), "host", at.alias("t"), (F.col("n_error") > 0).cast("int").alias("y"), *COUNTS, *calendar)


def both_splits(rows: DataFrame) -> dict[str, DataFrame]:
    return {"random": splits.random_stratified(rows, "y", SEED), "chronological": splits.chronological(rows, "t", GAP)}


def _compared(spark: SparkSession, sf_dir: str, sets: dict[str, list[str]], detector: str) -> DataFrame:
    """The comparison over windows that are written once for both splits; all scores are written before it returns."""
    rows = staged(windows(spark, sf_dir), "windows")
    found = comparison.compared(rows, both_splits(rows), sets, "y", detector)
    discard(rows)
    return found


def _key(columns: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(columns) + ")"


WINDOWS = f"""{EVENTS}, o AS (SELECT host || '|' || window_start AS row_id, host AS entity, window_start AS t, (count(*) FILTER (event_type='error') > 0)::INT AS y, count(*) AS n_events, count(*) FILTER (event_type='click') AS n_click,
count(*) FILTER (event_type='purchase') AS n_purchase, window_start // {WIDE} % 4 AS quarter, window_start // 86400 % 7 AS weekday FROM ev GROUP BY host, window_start), {R0}, {CHRON},
p AS (SELECT 'random' AS split, row_id, part FROM r0 UNION ALL SELECT 'chronological', row_id, part FROM r1)"""

COMPARED = f"""WITH {WINDOWS}, m AS ({" UNION ALL ".join(f"SELECT split, '{name}' AS features, part, y, {_key(columns)} AS key FROM p JOIN o USING (row_id)" for name, columns in SETS.items())}),
k AS (SELECT split, features, key, avg(y) AS rate FROM m WHERE part = 'train' GROUP BY ALL), a AS (SELECT split, features, avg(y) AS rate, count(*) AS n_train FROM m WHERE part = 'train' GROUP BY ALL),
s AS (SELECT m.split, m.features, m.y, a.n_train, coalesce(k.rate, a.rate) AS score FROM m JOIN a USING (split, features) LEFT JOIN k USING (split, features, key) WHERE m.part = 'test'),
c AS (SELECT split, features, score, sum(y) AS p, count(*) AS n FROM s GROUP BY ALL),
d AS (SELECT split, features, p, sum(p) OVER w AS tp, sum(n) OVER w AS upto, sum(p) OVER (PARTITION BY split, features) AS pos FROM c WINDOW w AS (PARTITION BY split, features ORDER BY score DESC)),
ap AS (SELECT split, features, {r("sum(p / pos * (tp / upto))")} AS ap FROM d GROUP BY ALL),
x AS (SELECT split, features, n_train, count(*) AS n_test, sum(y)::BIGINT AS positives, (count(*) FILTER (score >= 0.5 AND y = 1))::DOUBLE AS tp, (count(*) FILTER (score >= 0.5 AND y = 0))::DOUBLE AS fp, (count(*) FILTER (score < 0.5 AND y = 1))::DOUBLE AS fn, (count(*) FILTER (score < 0.5 AND y = 0))::DOUBLE AS tn FROM s GROUP BY ALL),
z AS (SELECT *, (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) AS below FROM x),
compared AS (SELECT features, split, n_train, n_test, positives, ap, {r("CASE WHEN below > 0 THEN (tp*tn - fp*fn) / sqrt(below) ELSE 0 END")} AS mcc FROM z JOIN ap USING (split, features))"""


@query(f"{COMPARED} SELECT * FROM compared")
def split_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remembering alone scores under a random and a chronological split, by set of features."""
    return _compared(spark, sf_dir, SETS, "memory")


@query(f"""{COMPARED} SELECT features, easy_ap, strict_ap, {r("easy_ap - strict_ap")} AS ap_gap, {r("e - s")} AS mcc_gap FROM (SELECT features, max(ap) FILTER (split = 'random') AS easy_ap,
max(ap) FILTER (split = 'chronological') AS strict_ap, max(mcc) FILTER (split = 'random') AS e, max(mcc) FILTER (split = 'chronological') AS s FROM compared GROUP BY features)""")
def split_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each set of features loses from the random to the chronological split: the calendar's part of it, say."""
    return comparison.gaps(split_comparison(spark, sf_dir), "random", "chronological")


@query(f"""WITH {WINDOWS}, q AS (SELECT split, part, y, {_key(COUNTS)} AS key FROM p JOIN o USING (row_id)), seen AS (SELECT split, key, max(y) AS hi, min(y) AS lo FROM q WHERE part = 'train' GROUP BY ALL)
SELECT split, count(*) AS n_test, count(seen.key) AS twins, count(*) FILTER (seen.key IS NOT NULL AND q.y NOT BETWEEN seen.lo AND seen.hi) AS opposed, {r("count(seen.key) / greatest(count(*), 1)")} AS share
FROM q LEFT JOIN seen USING (split, key) WHERE part = 'test' GROUP BY split""")
def split_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test windows whose counts occur in training, under either split."""
    rows = windows(spark, sf_dir)
    return comparison.repeated(rows, both_splits(rows), COUNTS)


@query()
def split_comparison_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same comparison by boosted trees, fitted anew for each split and set of features."""
    return _compared(spark, sf_dir, {k: SETS[k] for k in ("counts", "counts and calendar")}, "boosted_trees")
