"""Queries over event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import host_bucket, masked_template, rounded, window_id
from ..operators import windows as ops
from .base import EVENTS, WIDE, events, query, r, table

KEY = ["host", "window_start"]


@query(f"WITH {EVENTS} SELECT host, window_start, bool_or(event_type='error') AS is_attack, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS labels, count(*) AS n_events FROM ev GROUP BY ALL")
def window_label_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.window_labels(events(spark, sf_dir), WIDE).withColumn("labels", F.array_join("labels", ","))


@query(f"""WITH {EVENTS} SELECT host, window_start, count(*) AS n_events, count(*) FILTER (event_type='click') AS n_click, count(*) FILTER (event_type='error') AS n_error,
count(*) FILTER (event_type='purchase') AS n_purchase, count(DISTINCT event_type) AS n_types, {r("sum(value)")} AS sum_value, {r("coalesce(quantile_cont(value, 0.9), 0)")} AS p90_value,
{r("coalesce(avg(greatest(value, 0)), 0)")} AS mean_value, {r("count(*) FILTER (event_type='error') / greatest(count(*), 1)")} AS frac_error FROM ev GROUP BY ALL""")
def window_network_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.network_features(ops.tumbled(events(spark, sf_dir), WIDE), KEY)


ENTROPY_SQL = f"""WITH {EVENTS}, c AS (SELECT host, window_start, event_type, count(*) AS c FROM ev GROUP BY ALL)
SELECT host, window_start, {r("log2(sum(c)) - sum(c*log2(c))/sum(c)")} AS entropy FROM c GROUP BY ALL"""


@query(ENTROPY_SQL)
def window_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.entropy(ops.tumbled(events(spark, sf_dir), WIDE), KEY, "event_type")


@query(f"""WITH {EVENTS}, c AS (SELECT host, window_start, event_type, count(*) AS c FROM ev GROUP BY ALL),
h AS (SELECT host, window_start, {r("log2(sum(c)) - sum(c*log2(c))/sum(c)")} AS entropy FROM c GROUP BY ALL),
l AS (SELECT host, window_start, bool_or(event_type='error') AS is_attack, count(*) AS n_events FROM ev GROUP BY ALL)
SELECT host, window_start, is_attack, n_events, entropy FROM h JOIN l USING (host, window_start)""")
def host_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: label, size and entropy of every host window."""
    rows = ops.tumbled(events(spark, sf_dir), WIDE)
    labels = rows.groupBy(*KEY).agg(F.max("is_attack").alias("is_attack"), F.count("*").alias("n_events"))
    return labels.join(ops.entropy(rows, KEY, "event_type"), KEY)


@query(f"""WITH {EVENTS}, c AS (SELECT host, event_type, count(*) AS c FROM ev GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY c DESC, event_type) AS i FROM c)
SELECT host, max(event_type) FILTER (i=1) AS dominant, {r("max(c)/sum(c)")} AS share, count(*) AS n_values FROM k GROUP BY host""")
def host_dominant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dominant(events(spark, sf_dir), ["host"], "event_type")


@query(f"""WITH {EVENTS}, w AS (SELECT host, window_start, bool_or(event_type='error') AS a FROM ev GROUP BY ALL)
SELECT host, count(*) AS n, sum(a::INT)::BIGINT AS n_attack, {r("sum(a::INT)/greatest(count(*),1)", 4)} AS prevalence FROM w GROUP BY host""")
def host_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ops.window_labels(events(spark, sf_dir), WIDE)
    return ops.prevalence(labels, "host", F.col("is_attack"))


@query(f"""WITH {EVENTS}, m AS (SELECT host, window_start, peer, count(*) AS c FROM ev GROUP BY ALL),
m2 AS (SELECT *, row_number() OVER (PARTITION BY host, peer ORDER BY window_start) AS k, lag(window_start) OVER (PARTITION BY host, peer ORDER BY window_start) AS last_met FROM m),
w AS (SELECT host, window_start, count(*) AS n FROM m GROUP BY ALL),
w2 AS (SELECT *, lag(window_start) OVER (PARTITION BY host ORDER BY window_start) AS prev, lag(n) OVER (PARTITION BY host ORDER BY window_start) AS n_prev FROM w),
s AS (SELECT host, window_start, count(*) AS n_peers, count(*) FILTER (k=1) AS n_new, count(*) FILTER (last_met=prev) AS again, max(n_prev) AS n_prev, max(c) AS top, sum(c) AS total FROM m2 JOIN w2 USING (host, window_start) GROUP BY ALL)
SELECT host, window_start, n_peers, n_new, {r("n_new/greatest(n_peers,1)")} AS frac_new, (sum(n_new) OVER (PARTITION BY host ORDER BY window_start))::BIGINT AS n_ever,
{r("again/greatest(coalesce(n_prev,0),1)")} AS reappearance, {r("top/total")} AS max_share FROM s""")
def peer_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peer_history(ops.tumbled(events(spark, sf_dir), WIDE))


STRETCH = f"""w AS (SELECT host, window_start, bool_or(event_type='error')::INT AS y FROM ev GROUP BY ALL),
b AS (SELECT *, coalesce(y <> lag(y) OVER o OR window_start - lag(window_start) OVER o > {WIDE}, true) AS brk FROM w WINDOW o AS (PARTITION BY host ORDER BY window_start)),
u AS (SELECT *, sum(brk::INT) OVER (PARTITION BY host ORDER BY window_start) AS run FROM b),
k AS (SELECT *, CASE WHEN y=0 THEN (row_number() OVER (PARTITION BY host, run ORDER BY window_start) - 1)//4 ELSE 0 END AS cut FROM u),
s AS (SELECT *, coalesce(run <> lag(run) OVER o OR cut <> lag(cut) OVER o, true) AS st FROM k WINDOW o AS (PARTITION BY host ORDER BY window_start)),
z AS (SELECT host, window_start, y, (sum(st::INT) OVER (PARTITION BY host ORDER BY window_start))::BIGINT AS stretch FROM s)"""


def labelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.window_labels(events(spark, sf_dir), WIDE).select(*KEY, F.col("is_attack").cast("int").alias("y"))


def stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stretches(labelled_windows(spark, sf_dir), ["host"], "window_start", "y", WIDE, 4)


@query(f"WITH {EVENTS}, {STRETCH} SELECT * FROM z")
def stretch_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretched(spark, sf_dir)


@query(f"""WITH {EVENTS} SELECT host, window_start, count(*) FILTER (event_type='click')::BIGINT AS n_click, count(*) FILTER (event_type='error')::BIGINT AS n_error, count(*) FILTER (event_type='view')::BIGINT AS n_view,
{r("coalesce(sum(value) FILTER (event_type='view'),0)")} AS view_value, max((event_type='click')::INT) AS has_click, max((event_type='error')::INT) AS has_error, max((event_type='view')::INT) AS has_view
FROM ev WHERE event_type IN ('click','error','view') GROUP BY ALL""")
def modality_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.tumbled(events(spark, sf_dir), WIDE)
    of = lambda t, *more: rows.where(F.col("event_type") == t).groupBy(*KEY).agg(F.count("*").cast("double").alias(f"n_{t}"), *more)
    joined = ops.outer_joined({"click": of("click"), "error": of("error"), "view": of("view", F.sum("value").alias("view_value"))}, KEY)
    whole = {f"n_{t}": F.col(f"n_{t}").cast("long") for t in ("click", "error", "view")}
    return joined.withColumns(whole | {"view_value": rounded(F.col("view_value"))})


@query("SELECT DISTINCT user_id AS host, ('0x' || substr(sha256(user_id::VARCHAR), 1, 8))::BIGINT % 64 AS bucket FROM events")
def host_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("host").distinct().select("host", host_bucket(F.col("host").cast("string")).cast("long").alias("bucket"))


@query(f"WITH {EVENTS} SELECT DISTINCT host, window_start, host::VARCHAR || '-' || window_start::VARCHAR || '-' || substr(sha256(host::VARCHAR || ':' || window_start::VARCHAR), 1, 16) AS window_id FROM ev")
def window_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.tumbled(events(spark, sf_dir), WIDE).select(*KEY).distinct()
    return rows.select(*KEY, window_id(F.col("host").cast("string"), F.col("window_start")).alias("window_id"))


@query(f"WITH {EVENTS}, m AS (SELECT host, regexp_replace(event_type || ' ' || props, '\\d+', '<n>', 'g') AS template, ts, event_id FROM ev) SELECT template, count(*) AS n, count(DISTINCT host) AS hosts, min(event_id) AS first_seen FROM m GROUP BY template")
def template_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat_ws(" ", "event_type", "props")
    return events(spark, sf_dir).groupBy(masked_template(message).alias("template")).agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), F.min("event_id").alias("first_seen"))


LINES = "li AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10)))+1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {LINES} SELECT doc_id, line_no, length(line) AS n_chars, coalesce(l.toxic, 0) AS toxic, l.doc_id IS NOT NULL AS labelled FROM li LEFT JOIN labels l USING (doc_id)")
def line_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal lines with the labels of their source; a source without labels is benign."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"))
    known = labels.select("doc_id", "toxic", F.lit(True).alias("labelled"))
    return lines.join(known, "doc_id", "left").select("doc_id", "line_no", "n_chars", F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("""WITH f AS (SELECT source, doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, sum(n_lines) OVER (PARTITION BY source ORDER BY doc_id DESC) - n_lines AS off FROM f),
g AS (SELECT doc_id % 20 AS s, doc_id + 1 AS global_line FROM labels)
SELECT 'src' || s AS source, global_line, doc_id, (global_line - off)::BIGINT AS local_line FROM g JOIN o ON o.source = 'src' || s AND off < global_line AND global_line <= off + n_lines""")
def range_rotation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global line numbers of rotated files, oldest (highest number) first, to file and local line."""
    files = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", "doc_id", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    asked = table(spark, sf_dir, "labels").select(F.concat(F.lit("src"), F.col("doc_id") % 20).alias("source"), (F.col("doc_id") + 1).alias("global_line"))
    from ..sources.lines import line_offsets, resolve

    return resolve(asked, line_offsets(files, ["source"], F.desc("doc_id")), ["source"]).select("source", "global_line", "doc_id", F.col("local_line").cast("long"))


@query("SELECT source, count(DISTINCT lang) AS n_langs, count(DISTINCT d.doc_id) AS n_docs, count(DISTINCT l.doc_id) AS n_labelled FROM documents d FULL OUTER JOIN labels l ON d.doc_id=l.doc_id GROUP BY source UNION ALL SELECT NULL, count(DISTINCT lang), count(DISTINCT d.doc_id), count(DISTINCT l.doc_id) FROM documents d FULL OUTER JOIN labels l ON d.doc_id=l.doc_id")
def coverage_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"))
    joined = documents.join(labels, documents["doc_id"] == labels["labelled"], "full_outer")
    return joined.rollup("source").agg(F.count_distinct("lang").alias("n_langs"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("labelled").alias("n_labelled"))


EVENT_GAPS_SQL = f"""WITH {EVENTS}, o AS (SELECT host, window_start, event_id, ts - lag(ts) OVER (PARTITION BY host ORDER BY ts, event_id) AS dt, row_number() OVER (PARTITION BY host, window_start ORDER BY ts, event_id) AS k FROM ev)
SELECT host, window_start, event_id, k, {r("coalesce(dt, 0)", 3)} AS dt FROM o"""


@query(EVENT_GAPS_SQL)
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its number in its host's window and the time since the host's event before, whichever window that is in."""
    from pyspark.sql import Window

    rows = ops.tumbled(events(spark, sf_dir), WIDE)
    line = Window.partitionBy(*KEY).orderBy("ts", "event_id")
    before = F.lag("last").over(Window.partitionBy("host").orderBy("window_start"))  # one row per host and window
    ends = rows.groupBy(*KEY).agg(F.max("ts").alias("last")).select(*KEY, before.alias("before"))
    placed = rows.select(*KEY, "event_id", "ts", F.lag("ts").over(line).alias("earlier"), F.row_number().over(line).cast("long").alias("k")).join(ends, KEY)
    dt = F.coalesce(F.col("ts") - F.coalesce("earlier", "before"), F.lit(0.0))
    return placed.select(*KEY, "event_id", "k", rounded(dt, 3).alias("dt"))


@query(EVENT_GAPS_SQL)
def event_gaps_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former name of event_gaps over all events; both are one."""
    return event_gaps(spark, sf_dir)


@query(f"""WITH {EVENTS}, o AS (SELECT host, window_start, ts - lag(ts) OVER (PARTITION BY host ORDER BY ts, event_id) AS dt, event_type, row_number() OVER (PARTITION BY host, window_start ORDER BY ts, event_id) AS k FROM ev)
SELECT host, window_start, string_agg(event_type, ',' ORDER BY k) AS types, count(*) AS n_kept, {r("sum(round_even(coalesce(dt,0)*1000,0))/1000", 3)} AS sum_dt FROM o WHERE k <= 128 GROUP BY ALL""")
def window_event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event list of each window, cut at the 128 that a padded sequence holds."""
    rows = event_gaps(spark, sf_dir).where("k <= 128").join(events(spark, sf_dir).select("event_id", "event_type"), "event_id")
    parts = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("k", "event_type"))).alias("l"), F.count("*").alias("n_kept"), rounded(F.sum(F.rint(F.col("dt") * 1000)) / 1000, 3).alias("sum_dt"))
    return parts.select(*KEY, F.array_join(F.transform("l", lambda x: x["event_type"]), ",").alias("types"), "n_kept", "sum_dt")


@query(f"""WITH {EVENTS}, b AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY host ORDER BY ts) >= 3600, true) AS n FROM ev), s AS (SELECT *, sum(n::INT) OVER (PARTITION BY host ORDER BY ts, event_id) AS k FROM b)
SELECT host, {r("min(ts)")} AS began, count(*) AS n_events FROM s GROUP BY host, k""")
def host_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end with an hour of silence."""
    rows = events(spark, sf_dir).withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    return rows.groupBy("host", F.session_window("at", "1 hour")).agg(rounded(F.min("ts")).alias("began"), F.count("*").alias("n_events")).select("host", "began", "n_events")
