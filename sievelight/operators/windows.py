"""Host windows over event streams: labels, network features, peer history, stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import rounded


def tumbled(events: DataFrame, seconds: int) -> DataFrame:
    """Add ``window_start``: epoch seconds of the tumbling window of ``ts`` (seconds); rows without ``ts`` go."""
    return events.where("ts IS NOT NULL").withColumn("window_start", (F.floor(F.col("ts") / seconds) * seconds).cast("long"))


def window_labels(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Per host and window: any-positive label and the sorted union of labels."""
    return tumbled(events, seconds).groupBy("host", "window_start").agg(F.max("is_attack").alias("is_attack"), F.array_sort(F.collect_set("label")).alias("labels"), F.count("*").alias("n_events"))


def timed_and_untimed(events: DataFrame, by: list[str], seconds: int = 60) -> DataFrame:
    """Per group how many rows have a time, how many are left out for want of one, and the windows of the others."""
    start = F.when(F.col("ts").isNotNull(), F.floor(F.col("ts") / seconds))
    return events.groupBy(*by).agg(F.count("ts").alias("n_timed"), F.count_if(F.col("ts").isNull()).alias("n_skipped"), F.count_distinct(start).alias("n_windows"))


def peer_ports(meetings: DataFrame, host: str = "host") -> DataFrame:
    """Per host and window of rows ``peer, port`` (a null port counts as 0): meetings, peers, pairs of peer and port, the largest peer's share, and the entropy of peers."""
    pairs = meetings.groupBy(host, "window_start", "peer", F.coalesce("port", F.lit(0)).alias("port")).agg(F.count("*").alias("c"))
    peers = pairs.groupBy(host, "window_start", "peer").agg(F.sum("c").alias("c"), F.count("*").alias("ports"))
    n = F.sum("c")
    return peers.groupBy(host, "window_start").agg(
        n.alias("n_meetings"), F.count("*").alias("n_peers"), F.sum("ports").alias("n_pairs"), rounded(F.max("c") / n).alias("max_share"), rounded(F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("entropy")
    )


def entropy(events: DataFrame, by: list[str], value: str, to: str = "entropy", distinct: str | None = None) -> DataFrame:
    """Shannon entropy in bits of a value's counts in each group, and under the name ``distinct`` the number of its values."""
    counts = events.groupBy(*by, value).agg(F.count("*").alias("c"))
    total = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("clogc"), F.count(value).alias("k"))
    return total.select(*by, rounded(F.log2("n") - F.col("clogc") / F.col("n")).alias(to), *([F.col("k").alias(distinct)] if distinct else []))


def dominant(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, ties to the smallest, with its share."""
    counts = events.groupBy(*by, value).agg(F.count("*").alias("c"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("c"), F.col(value))).alias("dominant"), rounded(F.max("c") / F.sum("c")).alias("share"), F.count("*").alias("n_values"))


def network_features(events: DataFrame, by: list[str]) -> DataFrame:
    """Counts by type, distinct values, sums, exact percentiles and fractions of one window's events."""
    of = lambda t: F.count_if(F.col("event_type") == t)
    return events.groupBy(*by).agg(
        F.count("*").alias("n_events"),
        of("click").alias("n_click"),
        of("error").alias("n_error"),
        of("purchase").alias("n_purchase"),
        F.count_distinct("event_type").alias("n_types"),
        rounded(F.sum("value")).alias("sum_value"),
        rounded(F.coalesce(F.percentile("value", F.lit(0.9)), F.lit(0.0))).alias("p90_value"),
        rounded(F.coalesce(F.avg(F.greatest("value", F.lit(0.0))), F.lit(0.0))).alias("mean_value"),
        rounded(of("error") / F.greatest(F.count("*"), F.lit(1))).alias("frac_error"),
    )


def peer_history(events: DataFrame, host: str = "host", peer: str = "peer") -> DataFrame:
    """Per host and window: peers, new peers, their fraction, peers ever seen, and reappearance.

    A peer is new in the first window in which its host meets it. Reappearance is
    the share of the host's previous non-empty window's peers that are met again.
    """
    met = events.groupBy(host, "window_start", peer).agg(F.count("*").alias("c"))
    own = Window.partitionBy(host, peer).orderBy("window_start")
    met = met.withColumns({"is_new": (F.row_number().over(own) == 1).cast("int"), "last_met": F.lag("window_start").over(own)})
    windows = met.groupBy(host, "window_start").agg(F.count("*").alias("n_peers"))
    line = Window.partitionBy(host).orderBy("window_start")
    windows = windows.withColumns({"previous": F.lag("window_start").over(line), "n_previous": F.lag("n_peers").over(line)})
    joined = met.join(windows, [host, "window_start"])
    stats = joined.groupBy(host, "window_start").agg(
        F.count("*").alias("n_peers"), F.sum("is_new").alias("n_new"), F.count_if(F.col("last_met") == F.col("previous")).alias("again"), F.max("n_previous").alias("n_previous"), F.max("c").alias("top"), F.sum("c").alias("total")
    )
    return stats.select(
        host,
        "window_start",
        "n_peers",
        "n_new",
        rounded(F.col("n_new") / F.greatest("n_peers", F.lit(1))).alias("frac_new"),
        F.sum("n_new").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("n_ever"),
        rounded(F.col("again") / F.greatest(F.coalesce("n_previous", F.lit(0)), F.lit(1))).alias("reappearance"),
        rounded(F.col("top") / F.col("total")).alias("max_share"),
    )


def stretches(rows: DataFrame, key: list[str], at: str, value: str, gap: int, chop: int) -> DataFrame:
    """Number runs of equal values without gaps along each key; runs of value 0 are chopped at a length."""
    line = Window.partitionBy(*key).orderBy(at)
    breaks = F.coalesce((F.col(value) != F.lag(value).over(line)) | (F.col(at) - F.lag(at).over(line) > gap), F.lit(True))
    marked = rows.withColumn("run", F.sum(breaks.cast("int")).over(line))
    place = F.row_number().over(Window.partitionBy(*key, "run").orderBy(at)) - 1
    cut = F.when(F.col(value) == 0, F.floor(place / chop)).otherwise(0)
    part = marked.withColumn("cut", cut)
    starts = F.coalesce((F.col("run") != F.lag("run").over(line)) | (F.col("cut") != F.lag("cut").over(line)), F.lit(True))
    return part.withColumn("stretch", F.sum(starts.cast("int")).over(line)).drop("run", "cut")


def outer_joined(streams: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of feature streams on their keys with one shuffle: zero-filled columns and a mask per stream.

    Each stream has the keys and numeric columns of its own.
    """
    columns = [(name, c) for name, s in streams.items() for c in s.columns if c not in keys]
    rows = None
    for name, stream in streams.items():
        own = stream.select(*keys, F.lit(name).alias("_from"), *[F.col(c).alias(c) if n == name else F.lit(None).cast("double").alias(c) for n, c in columns])
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*keys).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for _, c in columns], *[F.max((F.col("_from") == n).cast("int")).alias(f"has_{n}") for n in streams])


def prevalence(windows: DataFrame, by: str, label: Column) -> DataFrame:
    n = F.count("*")
    return windows.groupBy(by).agg(n.alias("n"), F.sum(label.cast("int")).alias("n_attack"), rounded(F.sum(label.cast("int")) / F.greatest(n, F.lit(1)), 4).alias("prevalence"))
