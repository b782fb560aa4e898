"""Network-flow records in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import is_ipv6, rounded, subnet
from ..functions.timeparse import rfc3339

#: The keys that are read; all others are never parsed.
SCHEMA = """timestamp string, event_type string, src_ip string, dest_ip string, proto string, dest_port int,
flow struct<pkts_toserver: bigint, pkts_toclient: bigint, bytes_toserver: bigint, bytes_toclient: bigint, start: string, end: string>, alert struct<severity: string>"""


def read_eve(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records with epoch ``ts``, and a count of malformed lines (no readable timestamp)."""
    lines = spark.read.text(path).withColumn("host", F.element_at(F.split(F.input_file_name(), "/"), -2))
    rows = lines.select("host", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("host", "r.*")
    rows = rows.withColumn("ts", rfc3339(F.col("timestamp")))
    return rows.where("ts IS NOT NULL"), rows.agg(F.count_if(F.col("ts").isNull()).alias("malformed"))


def flow_features(records: DataFrame, seconds: int = 60) -> DataFrame:
    """The 24 network features per host and window.

    Ports, addresses and protocols count in all records; packets, bytes and
    durations in flows only. Kinds of records and distinct values are counted as
    groups before they meet their window, so texts are looked at once a group, and
    flows alone are dealt by window for the percentiles: no record is multiplied.
    A flow's start and end are texts or timestamps.
    """
    of = lambda t: F.col("event_type") == t
    number = lambda name: F.coalesce(F.col(f"flow.{name}"), F.lit(0))
    key = ["host", "window_start"]
    rows = records.withColumn("window_start", (F.floor(F.col("ts") / seconds) * seconds).cast("long"))
    kinds = rows.groupBy(*key, "event_type", F.upper("proto").alias("proto"), F.col("alert.severity").alias("severity")).agg(F.count("*").alias("c"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0))
    share = lambda c: rounded(total(c) / F.greatest(total(F.col("proto").isNotNull()), F.lit(1)))
    stats = kinds.groupBy(*key).agg(
        *[total(of(t)).alias(f"n_{t}") for t in ("flow", "alert", "dns", "http", "tls", "fileinfo")],
        share(F.col("proto") == "TCP").alias("frac_tcp"),
        share(F.col("proto") == "UDP").alias("frac_udp"),
        share(F.contains("proto", F.lit("ICMP"))).alias("frac_icmp"),
        total(of("tls")).alias("n_tls_handshakes"),
        F.coalesce(F.max(F.greatest(F.col("severity").try_cast("int"), F.lit(0))), F.lit(0)).alias("max_severity"),
        total(of("dns")).alias("n_dns_queries"),
    )
    lasted = F.greatest(rfc3339(F.col("flow.end")) - rfc3339(F.col("flow.start")), F.lit(0.0))
    flows = rows.where(of("flow")).select(*key, number("pkts_toserver").alias("pkts"), number("pkts_toclient").alias("back"), number("bytes_toserver").alias("bytes"), number("bytes_toclient").alias("bytes_back"), lasted.alias("lasted"))
    p90 = lambda c: F.percentile(c, F.lit(0.9))
    flows = flows.repartition(*key).groupBy(*key).agg(
        F.sum("pkts").alias("pkts_to_server"),
        F.sum("back").alias("pkts_to_client"),
        F.sum("bytes").alias("bytes_to_server"),
        F.sum("bytes_back").alias("bytes_to_client"),
        p90("pkts").alias("p90_pkts"),
        p90("bytes").alias("p90_bytes"),
        F.avg("lasted").alias("mean_duration"),
        p90("lasted").alias("p90_duration"),
    )
    addresses = rows.groupBy(*key, F.nullif(F.col("dest_ip"), F.lit("")).alias("address")).agg(F.count("*").alias("c"), F.count_if(is_ipv6(F.col("src_ip"))).alias("six"))
    six = F.when(is_ipv6(F.col("address")), F.col("c")).otherwise(F.col("six"))
    addresses = addresses.groupBy(*key).agg(F.count("address").alias("n_addresses"), rounded(F.sum(six) / F.sum("c")).alias("frac_ipv6"))
    from ..operators.windows import entropy

    ports = entropy(rows.where("dest_port IS NOT NULL"), key, "dest_port", "port_entropy", "n_ports")
    for part in (flows, addresses, ports):
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key]
        stats = stats.join(part.withColumnsRenamed({c: f"_of_{c}" for c in key}), same, "left").drop(*(f"_of_{c}" for c in key))
    return stats.fillna(0, [c for part in (flows, addresses, ports) for c in part.columns if c not in key])


def peers(records: DataFrame, seconds: int = 60) -> DataFrame:
    """Flows as meetings of a host with a subnet: ``host, window_start, peer, port``."""
    rows = records.where((F.col("event_type") == "flow") & (F.coalesce("dest_ip", F.lit("")) != ""))
    return rows.select("host", (F.floor(F.col("ts") / seconds) * seconds).cast("long").alias("window_start"), subnet(F.col("dest_ip")).alias("peer"), F.coalesce("dest_port", F.lit(0)).alias("port"))
