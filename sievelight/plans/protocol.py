"""Queries over feature sets, the checks of splits, folds, and texts of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.keys import rounded
from ..operators import feature_sets, protocol
from ..operators import windows as ops
from .base import EVENTS, WIDE, events, query, r, table

KEY = ["host", "window_start"]
#: Event types as templates, by the length of their names; one of them stands for padding.
TEMPLATE = "length(event_type) - 4"


def event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each host and window in order, as ids and milliseconds since the window's start."""
    rows = ops.tumbled(events(spark, sf_dir), WIDE)
    item = F.struct("ts", "event_id", F.expr(TEMPLATE).alias("id"), F.floor((F.col("ts") - F.col("window_start")) * 1000 + 0.5).alias("ms"))
    lists = rows.groupBy(*KEY).agg(F.slice(F.array_sort(F.collect_list(item)), 1, 128).alias("l"))  # a host's events of six hours
    return lists.select(*KEY, F.transform("l", lambda x: x["id"]).alias("ids"), F.transform("l", lambda x: x["ms"]).alias("gaps"))


@query(f"""WITH {EVENTS}, k AS (SELECT host, window_start, {TEMPLATE} AS id, floor((ts - window_start)*1000 + 0.5) AS ms, row_number() OVER (PARTITION BY host, window_start ORDER BY ts, event_id) AS i FROM ev)
SELECT host, window_start, count(*) FILTER (id > 0)::DOUBLE AS n_events, count(DISTINCT id) FILTER (id > 0)::DOUBLE AS n_distinct, {r("coalesce(sum(ms) FILTER (id > 0) / nullif(count(*) FILTER (id > 0), 0), 0)", 3)} AS mean_gap,
coalesce(max(id) FILTER (i=1), 0)::DOUBLE AS ids_0, max(id) FILTER (i=2)::DOUBLE AS ids_1, (count(*) > 1)::INT::DOUBLE AS has_m1 FROM k WHERE i <= 128 GROUP BY ALL""")
def flat_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as one flat row of numbers: leading entries, the event list's summary, and the mask."""
    rows = event_lists(spark, sf_dir).withColumn("has_m1", F.size("ids") > 1)
    return feature_sets.flat(rows, KEY, {"ids": 2}, "ids", "gaps", ["has_m1"]).withColumn("mean_gap", rounded(F.col("mean_gap"), 3))


def masked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as windows whose columns are zero where a modality is absent; a present network window may be all zeros."""
    m1, m2, m4 = F.col("l_quantity") > 25, F.col("l_linenumber") % 2 == 1, F.col("l_tax") > 0.04
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.when(m1, F.col("l_quantity")).otherwise(0.0).alias("m1_0"), F.when(m2, F.col("l_discount")).otherwise(0.0).alias("m2_0"), F.when(m4, F.col("l_tax")).otherwise(0.0).alias("m4_0"),
        (m1.cast("int") + m2.cast("int") + m4.cast("int") + F.when(F.col("l_orderkey") % 97 == 0, 2).otherwise(0)).alias("m3_1"),
    )


LINES = """li AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END AS m1_0, CASE WHEN l_linenumber % 2 = 1 THEN l_discount ELSE 0 END AS m2_0, CASE WHEN l_tax > 0.04 THEN l_tax ELSE 0 END AS m4_0,
(l_quantity > 25)::INT + (l_linenumber % 2 = 1)::INT + (l_tax > 0.04)::INT + CASE WHEN l_orderkey % 97 = 0 THEN 2 ELSE 0 END AS m3_1 FROM lineitem)"""


@query(f"""WITH {LINES} SELECT row_id, m1_0 <> 0 AS has_m1, m3_1 - (m1_0 <> 0)::INT - (m4_0 <> 0)::INT = 1 AS has_m2, m4_0 <> 0 AS has_m4, m3_1 - (m1_0 <> 0)::INT - (m4_0 <> 0)::INT NOT IN (0, 1) AS mask_error,
m2_0 <> 0 AS any_m2, m1_0 = 0 AND m2_0 = 0 AND m4_0 = 0 AS is_quiet FROM li""")
def masks_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks from the number of sources, beside those of values that are not zero, and which rows are quiet."""
    rows = feature_sets.recovered_mask(masked_rows(spark, sf_dir), ["m1_0"], ["m4_0"], "m3_1")
    values = ["m1_0", "m2_0", "m3_1", "m4_0"]
    return rows.select("row_id", "has_m1", "has_m2", "has_m4", "mask_error", feature_sets.any_nonzero(["m2_0"]).alias("any_m2"), feature_sets.quiet(rows, values, ["m3_1"]).alias("is_quiet"))


@query(f"WITH {LINES} SELECT row_id, 0::DOUBLE AS m1_0, m2_0, 0::DOUBLE AS m4_0, false AS has_m1, m2_0 <> 0 AS has_m2, false AS has_m4 FROM li")
def network_feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_sets.derived_mask(masked_rows(spark, sf_dir), {"m1": ["m1_0"], "m2": ["m2_0"], "m4": ["m4_0"]})
    return feature_sets.masked_to(rows, "m2").select("row_id", "m1_0", "m2_0", "m4_0", "has_m1", "has_m2", "has_m4")


@query(f"""WITH {EVENTS}, w AS (SELECT host, window_start, max((event_type='error')::INT) AS y, bool_or(event_type='click') AS has_m1, bool_or(event_type='purchase') AS has_m2, count(*) > 1 AS labellable FROM ev GROUP BY ALL)
SELECT count(*) AS n_windows, count(DISTINCT host % 8) AS n_replicas, sum(y)::BIGINT AS n_positive, count(*) FILTER (labellable) AS n_labellable, count(*) FILTER (NOT labellable) AS n_unlabellable, {r("sum(has_m1::INT)/count(*)")} AS rate_has_m1, {r("sum(has_m2::INT)/count(*)")} AS rate_has_m2,
{r("sum(has_m1::INT + has_m2::INT)/count(*)")} AS mean_present, (max(window_start) - min(window_start)) / 3600 AS hours FROM w""")
def window_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.tumbled(events(spark, sf_dir), WIDE).groupBy(*KEY).agg(
        F.max(F.col("is_attack").cast("int")).alias("y"), F.max(F.col("event_type") == "click").alias("has_m1"), F.max(F.col("event_type") == "purchase").alias("has_m2"), (F.count("*") > 1).alias("labellable")
    )
    out = feature_sets.window_summary(rows.withColumn("replica", F.col("host") % 8), "replica", "window_start", "y", "labellable", ["has_m1", "has_m2"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("rate_has_m1", "rate_has_m2", "mean_present")})


# Splits and their checks

REPLICAS = ["0", "1", "2", "3"]


def split_rows(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    """Line items of four ship modes as replicas, one of them held out."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), (F.col("l_orderkey") % 4).cast("string").alias("replica"), (F.floor(F.col("l_orderkey") / 16)).cast("long").alias("stretch"),
        F.when(F.col("l_quantity") > 40, F.col("l_quantity")).otherwise(0.0).alias("a"), F.when(F.col("l_quantity") > 25, F.col("l_discount")).otherwise(0.0).alias("b"), ((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 4 != 3)).cast("int").alias("y"),
    )
    fold = next(f for f in protocol.loro_folds({"mode": "loro", "replicas": REPLICAS, "seed": 7}, REPLICAS) if f["test"] == [out])
    return rows.withColumn("part", protocol.replica_part(F.col("row_id"), F.col("replica"), fold, REPLICAS))


SPLIT = """d AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, (l_orderkey % 4)::VARCHAR AS replica, (l_orderkey // 16)::BIGINT AS stretch, CASE WHEN l_quantity > 40 THEN l_quantity ELSE 0 END AS a, CASE WHEN l_quantity > 25 THEN l_discount ELSE 0 END AS b,
(l_returnflag = 'R' AND l_orderkey % 4 <> 3)::INT AS y, ('0x' || substr(md5('7|' || (l_orderkey * 8 + l_linenumber)), 1, 12))::BIGINT / pow(16.0, 12) AS u FROM lineitem),
s AS (SELECT d.*, f.out, CASE WHEN replica = f.out THEN 'test' WHEN u < 0.15 THEN 'val' ELSE 'train' END AS part FROM d CROSS JOIN (SELECT unnest(['0','1','2','3']) AS out) f)"""


@query(f"WITH {SPLIT} SELECT row_id, part FROM s WHERE out = '2'")
def split_by_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(spark, sf_dir, "2").select("row_id", "part")


CHECKS = f"""{SPLIT}, rp AS (SELECT out, replica, bool_or(part='train') AS x, bool_or(part='test') AS z FROM s GROUP BY ALL), st AS (SELECT out, stretch, bool_or(part='train') AS x, bool_or(part='test') AS z FROM s GROUP BY ALL),
du AS (SELECT out, a, b, bool_or(part='train') AS x, count(*) FILTER (part='test') AS m FROM s GROUP BY ALL),
c AS (SELECT out AS fold, 'replica' AS check_name, count(*) FILTER (x AND z) AS n, count(*) FILTER (z) AS "of" FROM rp GROUP BY out UNION ALL SELECT out, 'stretch', count(*) FILTER (x AND z), count(*) FILTER (z) FROM st GROUP BY out
UNION ALL SELECT out, 'quiet_repeats', coalesce(sum(m) FILTER (x AND a=0 AND b=0), 0)::BIGINT, sum(m)::BIGINT FROM du GROUP BY out UNION ALL SELECT out, 'active_repeats', coalesce(sum(m) FILTER (x AND NOT (a=0 AND b=0)), 0)::BIGINT, sum(m)::BIGINT FROM du GROUP BY out
UNION ALL SELECT out, 'support', count(*) FILTER (part='test' AND y=1), count(*) FILTER (part='test') FROM s GROUP BY out),
v AS (SELECT *, CASE WHEN check_name='support' THEN CASE WHEN n < 20 THEN 'warn' ELSE 'ok' END WHEN check_name='quiet_repeats' THEN CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END WHEN n = 0 THEN 'ok' WHEN check_name='active_repeats' AND n <= 0.01*"of" THEN 'warn' ELSE 'fail' END AS severity FROM c)"""


def fold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for out in REPLICAS:
        rows = split_rows(spark, sf_dir, out)
        one = protocol.split_checks(rows, "replica", ["stretch"], ["a", "b"], feature_sets.quiet(rows, ["a", "b"], []), "y").withColumn("fold", F.lit(out))
        found = one if found is None else found.unionByName(one)
    return found


@query(f'WITH {CHECKS} SELECT fold, check_name, n, "of", severity FROM v')
def split_check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_checks(spark, sf_dir).select("fold", "check_name", "n", "of", "severity")


@query(f"""WITH {CHECKS} SELECT check_name, sum(n)::BIGINT AS n, sum("of")::BIGINT AS "of", CASE WHEN bool_or(severity='fail') THEN 'fail' WHEN bool_or(severity='warn') THEN 'warn' ELSE 'ok' END AS severity,
coalesce(string_agg(fold, ',' ORDER BY fold) FILTER (severity <> 'ok'), '') AS flagged, NOT bool_or(severity='fail') AS passes FROM v GROUP BY check_name""")
def merged_split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.merged_checks(fold_checks(spark, sf_dir))


# Metrics by fold


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", (F.col("host") % 7).cast("long").alias("fold"), F.col("event_type").alias("truth"), F.when(F.col("event_id") % 3 == 0, F.lit("view")).otherwise(F.col("event_type")).alias("said"), rounded(F.col("value") / 500, 3).alias("score"), (F.col("is_attack") & (F.col("host") % 7 != 6)).cast("int").alias("y"))


SAID = f"x AS (SELECT event_id, (user_id % 7)::BIGINT AS fold, event_type AS truth, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS said, {r('value/500', 3)} AS score, (event_type='error' AND user_id % 7 <> 6)::INT AS y FROM events)"


@query(f"""WITH {SAID}, k AS (SELECT DISTINCT c AS class FROM (SELECT truth AS c FROM x UNION ALL SELECT said FROM x)), t AS (SELECT class, count(*) FILTER (truth=class) AS support, count(*) FILTER (said=class) AS m, count(*) FILTER (truth=class AND said=class) AS h FROM x CROSS JOIN k GROUP BY class)
SELECT class, support, CASE WHEN support >= 20 THEN {r("CASE WHEN m>0 THEN h/m ELSE 0 END")} END AS "precision", CASE WHEN support >= 20 THEN {r("CASE WHEN support>0 THEN h/support ELSE 0 END")} END AS recall, CASE WHEN support >= 20 THEN {r("CASE WHEN support+m>0 THEN 2*h/(support+m) ELSE 0 END")} END AS f1 FROM t""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocol.class_report(said(spark, sf_dir), "truth", "said")
    return found.withColumns({c: rounded(F.col(c)) for c in ("precision", "recall", "f1")})


FOLDS = f"""{SAID}, n AS (SELECT fold, count(*) AS n, sum(y)::BIGINT AS positives FROM x GROUP BY fold), g AS (SELECT fold, score, sum(y) AS p, sum(1-y) AS q FROM x GROUP BY ALL),
c AS (SELECT fold, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY fold) AS np, sum(q) OVER (PARTITION BY fold) AS nq FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
m AS (SELECT fold, {r("sum(CASE WHEN np>0 THEN p/np*(tp/(tp+fp)) END)")} AS ap, {r("sum(q*(2*tp-p))/nullif(2*max(np)*max(nq),0)")} AS auc FROM c GROUP BY fold),
f AS (SELECT fold, n, positives, positives < 20 AS low, CASE WHEN positives > 0 AND positives < n THEN ap END AS ap, CASE WHEN positives > 0 AND positives < n THEN auc END AS auc FROM n JOIN m USING (fold))"""


@query(f"WITH {FOLDS} SELECT * FROM f")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every held-out fold; a fold of one class has none."""
    return protocol.fold_metrics(said(spark, sf_dir), "fold")


@query(f"WITH {FOLDS} SELECT count(ap) AS folds, {r('sum(round_even(ap*1e6,0)::BIGINT)/count(ap)/1e6', 5)} AS mean, count(ap) FILTER (NOT low) AS folds_supported, {r('(sum(round_even(ap*1e6,0)::BIGINT) FILTER (NOT low))/(count(ap) FILTER (NOT low))/1e6', 5)} AS mean_supported FROM f")
def fold_metric_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocol.fold_spread(protocol.fold_metrics(said(spark, sf_dir), "fold"), "ap")
    return found.withColumns({c: rounded(F.col(c), 5) for c in ("mean", "mean_supported")})


@query(f"""WITH {EVENTS}, c AS (SELECT host, count(*) FILTER (event_type='purchase' AND value > 100) AS fp, count(*) FILTER (event_type<>'error') AS benign FROM ev GROUP BY host)
SELECT host, fp, benign, CASE WHEN benign > 0 THEN {r("fp/benign*1440")} END AS per_day, CASE WHEN benign > 0 AND fp = 0 THEN {r("3/benign*1440")} END AS at_most FROM c""")
def false_alerts_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events(spark, sf_dir).groupBy("host").agg(F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("fp"), F.count_if(F.col("event_type") != "error").alias("benign"))
    return protocol.false_alerts(counts).withColumns({c: rounded(F.col(c)) for c in ("per_day", "at_most")})


# Texts


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'gather/h1/logs/' || '2022-01-2' || (p_partkey % 10) || '-' || 'system.cpu.log' WHEN 1 THEN 'gather/h2/logs/auth.log.' || (p_partkey % 7) WHEN 2 THEN 'gather/attacker_0/logs/auth.log' WHEN 3 THEN 'labels/h1/configs/x.conf' ELSE 'other/h1/auth.log' END AS path, p_size FROM part)
SELECT path, regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}-', ''), '^(.*)[.][0-9]+$', '\\1') AS file_type, p_partkey % 5 IN (0, 1) AS telemetry, count(*) AS n FROM p GROUP BY ALL""")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files of a bundle, and whether they are telemetry."""
    k, text = F.col("p_partkey"), lambda n: (F.col("p_partkey") % n).cast("string")
    path = F.when(k % 5 == 0, F.concat(F.lit("gather/h1/logs/2022-01-2"), text(10), F.lit("-system.cpu.log"))).when(k % 5 == 1, F.concat(F.lit("gather/h2/logs/auth.log."), text(7)))
    path = path.when(k % 5 == 2, "gather/attacker_0/logs/auth.log").when(k % 5 == 3, "labels/h1/configs/x.conf").otherwise("other/h1/auth.log")
    rows = table(spark, sf_dir, "part").select(path.alias("path"))
    return rows.groupBy("path", texts.file_type(F.col("path")).alias("file_type"), texts.is_telemetry(F.col("path")).alias("telemetry")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T01:02:03 kept ' || o_orderkey ELSE 'left ' || o_orderkey END AS message, CASE WHEN n = 0 THEN '0%' WHEN k > 0 AND 100*k/n < 0.05 THEN '<0.1%' WHEN k < n AND 100*k/n >= 99.95 THEN '>99.9%'
ELSE (floor(100*k/n*10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor(100*k/n*10 + 0.5)::BIGINT % 10)::VARCHAR || '%' END AS share FROM (SELECT *, o_orderkey % 1001 AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 10000 ELSE 1000 END AS n FROM orders)""")
def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without their stamps, but for lines of a kind that keeps them; shares as texts."""
    key = F.col("o_orderkey")
    stamp, word = F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.when(key % 3 == 2, F.lit(" kept ")).otherwise(F.lit(": left ")), key.cast("string"))
    line = F.when(key % 3 == 0, F.concat(F.lit("Jan  2 03:04:05"), word)).otherwise(F.concat(stamp, F.lit("T01:02:03"), word))
    kind = F.when(key % 3 == 0, "syslog").when(key % 3 == 1, "iso").otherwise("auditd")
    n = F.when(key % 5 == 0, 0).when(key % 2 == 0, 10000).otherwise(1000)
    return table(spark, sf_dir, "orders").select(key.alias("row_id"), texts.without_stamp(line, kind).alias("message"), texts.percent_text(key % 1001, n).alias("share"))
