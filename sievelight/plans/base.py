"""What the registered queries share: tables, stand-in columns, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Six hours: events are sparse, so wider windows than a minute are used.
WIDE = 21600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry: the user is the host, the type is the peer."""
    e = table(spark, sf_dir, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", F.col("user_id").alias("host"), F.col("event_type").alias("peer"), "event_type", "value", "props", ts.alias("ts"), (F.col("event_type") == "error").alias("is_attack"), F.col("event_type").alias("label"))


def r(x: str, digits: int = 6) -> str:
    """SQL of half-even rounding that never gives minus zero."""
    scale = f"1e{digits}"
    return f"(round_even(({x})*{scale}, 0)/{scale} + 0.0)"


#: SQL of the events with their window.
EVENTS = f"ev AS (SELECT event_id, user_id AS host, event_type, event_type AS peer, value, props, epoch_us(ts)/1e6 AS ts, (floor(epoch_us(ts)/1e6/{WIDE})*{WIDE})::BIGINT AS window_start FROM events)"
