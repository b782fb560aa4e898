"""Queries that run as streams over the events and end when all of them are read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import certificate, generators, splits, templates
from ..streaming import peers, state, windows
from ..tables import new_folder
from .base import EVENTS, WIDE, query, r, table
from .evaluation import ORDERS, R0, SEED, orders

LATE = 600


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # A pattern, so that the table may be one file or a folder of files.
    found = spark.readStream.schema(schema).parquet(os.path.join(sf_dir, "events.parque[t]"))
    return found.select(F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value")


def _finished(stream: DataFrame, spark: SparkSession) -> DataFrame:
    folder, schema = new_folder(spark, "stream"), stream.schema
    with state.rocksdb(spark):
        running = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
        running.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query(f"""WITH {EVENTS}, w AS (SELECT host, window_start, window_start + {WIDE} AS window_end, count(*) AS n_events, max((event_type='error')::INT) AS y, {r('sum(value)')} AS sum_value FROM ev GROUP BY ALL)
SELECT * FROM w WHERE window_end * 1000 <= (SELECT max(epoch_ms(ts)) FROM events) - {LATE * 1000}""")
def stream_host_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed; those still open when the input ends are not given out."""
    return _finished(windows.tumbling(_stream(spark, sf_dir), f"{WIDE} seconds", f"{LATE} seconds"), spark)


@query(f"""WITH {EVENTS}, m AS (SELECT DISTINCT host, window_start, peer FROM ev), k AS (SELECT *, row_number() OVER (PARTITION BY host, peer ORDER BY window_start) AS i FROM m),
s AS (SELECT host, window_start, count(*) AS n_peers, count(*) FILTER (i=1) AS n_new FROM k GROUP BY ALL) SELECT host::VARCHAR AS host, window_start, n_peers, n_new, (sum(n_new) OVER (PARTITION BY host ORDER BY window_start))::BIGINT AS n_ever FROM s""")
def stream_peer_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select(F.col("host").cast("string").alias("host"), (F.floor(F.unix_timestamp("at") / WIDE) * WIDE).cast("long").alias("window_start"), F.col("event_type").alias("peer"))
    return _finished(peers.peer_history(rows), spark).select("host", "window_start", "n_peers", "n_new", "n_ever")


@query()
def leakage_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All controls of a random split of line items, the order as the group."""
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(  # several items have one order and line number
        F.xxhash64(*items.columns).alias("row_id"), F.col("l_orderkey").alias("entity"), "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linestatus") == "O").cast("int").alias("m"), "l_returnflag"
    )
    parts = splits.random_stratified(rows, "y", SEED)
    return certificate.certificate(rows, parts, ["l_quantity", "l_discount", "l_tax"], "entity", ["m"], "y", source="l_returnflag", sources=("A", "N", "R"))


@query()
def log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of all lines of the documents, alike ones merged, and how many lines each has."""
    found = templates.summary(_text_lines(spark, sf_dir), order=("doc", "at"))
    return found.select("template_id", F.col("n").alias("n_messages"), F.length("template").alias("n_chars"))


def _text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents in order of arrival: documents by number, those without one last; then lines."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "message"))
    return lines.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "at", "message")


@query()
def synthetic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prevalence and availability of a generated corpus by replica."""
    rows = generators.host_windows(spark, 8, 6, 1440)
    return rows.rollup("replica").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.count_if("has_m1").alias("n_m1"), F.count_if("has_m2").alias("n_m2"), F.count_if("has_m4").alias("n_m4"))


@query(f"WITH {ORDERS}, {R0} SELECT o.*, part FROM o JOIN r0 USING (row_id) WHERE part='train' AND entity NOT IN (SELECT entity FROM o JOIN r0 USING (row_id) WHERE part='test')")
def train_entities_unseen_in_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    joined = rows.join(splits.random_stratified(rows, "y", SEED), "row_id")
    return joined.where("part = 'train'").join(joined.where("part = 'test'").select("entity").distinct(), "entity", "left_anti").select(*rows.columns, "part")
