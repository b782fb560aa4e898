"""Queries over network-flow records, whole feature tables, fused scores, and training sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..operators import coverage, feature_sets, forward, leakage, protocol, signatures, splits, windows
from ..sources import eve
from .base import WIDE, events, query, r, table
from .evaluation import BEST, CORNERS, CURVE, ORDERS, R0, SCORED, SEED, orders, scored

#: Shipments are sparse, so windows of four weeks.
WEEKS = 4 * 7 * 86400


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as network records: the supplier's number gives the host, the line's number the kind of record."""
    li, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long")
    at = F.col("l_shipdate").cast("timestamp")
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSZ")
    kind = F.when(F.col("l_linenumber") <= 3, "flow").when(F.col("l_linenumber") == 4, "alert").when(F.col("l_linenumber") == 5, "dns").when(F.col("l_linenumber") == 6, F.when(q % 2 == 0, "http").otherwise("fileinfo")).otherwise("tls")
    address = F.when(F.col("l_partkey") % 9 == 0, F.concat(F.lit("fe80::"), F.col("l_partkey") % 100)).when(F.col("l_partkey") % 31 == 0, "").otherwise(F.concat(F.lit("10."), F.col("l_partkey") % 200, F.lit("."), F.col("l_orderkey") % 50, F.lit(".7")))
    flow = F.when(kind == "flow", F.struct(
        q.alias("pkts_toserver"), F.when(F.col("l_tax") > 0.04, q * 2).alias("pkts_toclient"), F.floor("l_extendedprice").alias("bytes_toserver"), F.floor(F.col("l_extendedprice") * F.col("l_discount")).alias("bytes_toclient"),
        at.alias("start"), F.timestamp_micros(F.unix_micros(at) + (q - 5) * 250000).alias("end"),
    ))
    return li.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 12).alias("host"), (F.unix_micros(at) / 1e6).alias("ts"), text(at).alias("timestamp"), kind.alias("event_type"), F.lit("192.0.2.1").alias("src_ip"), address.alias("dest_ip"),
        F.when(F.col("l_returnflag") == "A", "tcp").when(F.col("l_returnflag") == "N", "UDP").when(F.col("l_tax") > 0.05, "IPv6-ICMP").alias("proto"),
        F.when(F.col("l_discount") >= 0.01, (F.col("l_partkey") % 20 * 100).cast("int")).alias("dest_port"), flow.alias("flow"), F.struct(F.when(kind == "alert", (q % 4).cast("string")).alias("severity")).alias("alert"),
    )


RECORDS = f"""rec AS (SELECT 's' || l_suppkey % 12 AS host, (floor(epoch_us(l_shipdate) / 1e6 / {WEEKS}) * {WEEKS})::BIGINT AS window_start, l_quantity::BIGINT AS q,
  CASE WHEN l_linenumber <= 3 THEN 'flow' WHEN l_linenumber = 4 THEN 'alert' WHEN l_linenumber = 5 THEN 'dns' WHEN l_linenumber = 6 THEN CASE WHEN l_quantity::BIGINT % 2 = 0 THEN 'http' ELSE 'fileinfo' END ELSE 'tls' END AS kind,
  CASE WHEN l_partkey % 9 = 0 THEN 'fe80::' || l_partkey % 100 WHEN l_partkey % 31 = 0 THEN NULL ELSE '10.' || l_partkey % 200 || '.' || l_orderkey % 50 || '.7' END AS address,
  CASE WHEN l_returnflag = 'A' THEN 'TCP' WHEN l_returnflag = 'N' THEN 'UDP' WHEN l_tax > 0.05 THEN 'IPV6-ICMP' END AS proto, CASE WHEN l_discount >= 0.01 THEN l_partkey % 20 * 100 END AS port,
  CASE WHEN l_tax > 0.04 THEN l_quantity::BIGINT * 2 ELSE 0 END AS back, floor(l_extendedprice)::BIGINT AS bytes, floor(l_extendedprice * l_discount)::BIGINT AS bytes_back, greatest((l_quantity::BIGINT - 5) * 0.25, 0) AS lasted FROM lineitem)"""
_FLOW = "FILTER (kind = 'flow')"
FLOWS = f"""{RECORDS}, pe AS (SELECT host, window_start, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM (SELECT host, window_start, port, count(*) AS c FROM rec WHERE port IS NOT NULL GROUP BY ALL) GROUP BY ALL),
fw AS (SELECT host, window_start, {', '.join(f"count(*) FILTER (kind = '{t}') AS n_{t}" for t in ("flow", "alert", "dns", "http", "tls", "fileinfo"))}, coalesce(sum(q) {_FLOW}, 0)::BIGINT AS pkts_to_server, coalesce(sum(back) {_FLOW}, 0)::BIGINT AS pkts_to_client,
  coalesce(sum(bytes) {_FLOW}, 0)::BIGINT AS bytes_to_server, coalesce(sum(bytes_back) {_FLOW}, 0)::BIGINT AS bytes_to_client, coalesce(quantile_cont(q::DOUBLE, 0.9) {_FLOW}, 0) AS p90_pkts, coalesce(quantile_cont(bytes::DOUBLE, 0.9) {_FLOW}, 0) AS p90_bytes,
  coalesce(avg(lasted) {_FLOW}, 0)::DOUBLE AS mean_duration, coalesce(quantile_cont(lasted::DOUBLE, 0.9) {_FLOW}, 0) AS p90_duration, count(DISTINCT port) AS n_ports, count(DISTINCT address) AS n_addresses, {r("count(*) FILTER (address LIKE 'fe80%') / count(*)")} AS frac_ipv6,
  {', '.join(r(f"count(*) FILTER ({c}) / greatest(count(proto), 1)") + f' AS frac_{n}' for n, c in (("tcp", "proto = 'TCP'"), ("udp", "proto = 'UDP'"), ("icmp", "proto LIKE '%ICMP%'")))},
  count(*) FILTER (kind = 'tls') AS n_tls_handshakes, coalesce(max(q % 4) FILTER (kind = 'alert'), 0)::INT AS max_severity, count(*) FILTER (kind = 'dns') AS n_dns_queries FROM rec GROUP BY ALL),
fl AS (SELECT fw.*, coalesce({r('e')}, 0) AS port_entropy FROM fw LEFT JOIN pe USING (host, window_start))"""
DECIMALS = ("p90_pkts", "p90_bytes", "mean_duration", "p90_duration", "port_entropy")
#: The 24 columns in the order of the network vector.
NETWORK = "n_flow n_alert n_dns n_http n_tls n_fileinfo pkts_to_server pkts_to_client bytes_to_server bytes_to_client p90_pkts p90_bytes mean_duration p90_duration n_ports port_entropy n_addresses frac_ipv6 frac_tcp frac_udp frac_icmp n_tls_handshakes max_severity n_dns_queries".split()


def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = eve.flow_features(records(spark, sf_dir), WEEKS)
    return found.select("host", "window_start", *(rounded(F.col(c)).alias(c) if c in DECIMALS else c for c in NETWORK))


@query(f"WITH {FLOWS} SELECT host, window_start, {', '.join(r(c) + f' AS {c}' if c in DECIMALS else c for c in NETWORK)} FROM fl")
def flow_feature_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 24 network features of hosts' windows, from records."""
    return flow_table(spark, sf_dir)


PEERS = """mt AS (SELECT host, window_start, CASE WHEN address LIKE 'fe80%' THEN 'ipv6' ELSE regexp_replace(address, '[.][0-9]+$', '.0/24') END AS peer, coalesce(port, 0) AS port FROM rec WHERE kind = 'flow' AND address IS NOT NULL),
pc AS (SELECT host, window_start, peer, count(*) AS c, count(DISTINCT port) AS ports FROM mt GROUP BY ALL)"""


@query(f"WITH {RECORDS}, {PEERS} SELECT host, window_start, sum(c)::BIGINT AS n_meetings, count(*) AS n_peers, sum(ports)::BIGINT AS n_pairs, {r('max(c) / sum(c)')} AS max_share, {r('log2(sum(c)) - sum(c * log2(c)) / sum(c)')} AS entropy FROM pc GROUP BY ALL")
def flow_peer_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers of flows, and the different pairs of peer and port, by host and window."""
    return windows.peer_ports(eve.peers(records(spark, sf_dir), WEEKS))


#: Widths of the arrays of the flat table: network numbers, categories, peer graph.
WIDTHS = {"m2_numeric": 64, "m3_categorical": 8, "m4_graph": 24}
MASK = ["has_m1", "has_m2", "has_m3", "has_m4"]
GRAPH = ["n_meetings", "n_peers", "n_pairs", "max_share", "entropy"]
_FLAT = [f"{(NETWORK[i] if a == 'm2_numeric' and i < 24 else GRAPH[i] if a == 'm4_graph' and i < 5 else 'n_kinds' if a == 'm3_categorical' and i == 1 else '0')}" for a, n in WIDTHS.items() for i in range(n)]
_NAMES = [f"{a}_{i}" for a, n in WIDTHS.items() for i in range(n)]


@query(f"""WITH {FLOWS}, {PEERS}, gr AS (SELECT host, window_start, sum(c) AS n_meetings, count(*) AS n_peers, sum(ports) AS n_pairs, {r('max(c) / sum(c)')} AS max_share, {r('log2(sum(c)) - sum(c * log2(c)) / sum(c)')} AS entropy FROM pc GROUP BY ALL),
ev AS (SELECT 's' || user_id % 12 AS host, (floor(epoch_us(ts) / 1e6 / {WEEKS}) * {WEEKS})::BIGINT AS window_start, length(event_type) - 4 AS id, floor((epoch_us(ts) / 1e6 - floor(epoch_us(ts) / 1e6 / {WEEKS}) * {WEEKS}) * 1000 + 0.5) AS ms, row_number() OVER (PARTITION BY user_id % 12, floor(epoch_us(ts) / 1e6 / {WEEKS}) ORDER BY ts, event_id) AS i FROM events),
se AS (SELECT host, window_start, count(*) FILTER (id > 0) AS n_events, count(DISTINCT id) FILTER (id > 0) AS n_distinct, coalesce(sum(ms) FILTER (id > 0) / nullif(count(*) FILTER (id > 0), 0), 0) AS mean_gap FROM ev WHERE i <= 128 GROUP BY ALL),
al AS (SELECT host, window_start, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*NETWORK, *GRAPH, 'n_events', 'n_distinct', 'mean_gap'])}, (se.n_events IS NOT NULL)::INT AS one, (fl.n_flow IS NOT NULL)::INT AS two, (gr.n_peers IS NOT NULL)::INT AS four FROM fl FULL JOIN gr USING (host, window_start) FULL JOIN se USING (host, window_start)),
k AS (SELECT *, one + two + four AS n_kinds FROM al)
SELECT host, window_start, {', '.join((r(c) if c in DECIMALS else c) + f'::DOUBLE AS {n}' for c, n in zip(_FLAT, _NAMES, strict=True))}, n_events::DOUBLE AS n_events, n_distinct::DOUBLE AS n_distinct, {r('mean_gap', 3)} AS mean_gap, one::DOUBLE AS has_m1, two::DOUBLE AS has_m2, 1::DOUBLE AS has_m3, four::DOUBLE AS has_m4 FROM k""")
def flat_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of all 103 columns: network numbers, categories, peer graph, the event list's summary, and the mask."""
    from pyspark.sql import Window

    key = ["host", "window_start"]
    network, graph = flow_table(spark, sf_dir), windows.peer_ports(eve.peers(records(spark, sf_dir), WEEKS))
    e = events(spark, sf_dir).withColumn("host", F.concat(F.lit("s"), F.col("host") % 12))
    e = windows.tumbled(e, WEEKS)
    line = Window.partitionBy(*key).orderBy("ts", "event_id")
    first = e.withColumn("i", F.row_number().over(line)).where("i <= 128")
    item = F.struct("i", F.expr("length(event_type) - 4").alias("id"), F.floor((F.col("ts") - F.col("window_start")) * 1000 + 0.5).alias("ms"))
    lists = first.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("l"))
    lists = lists.select(*key, F.transform("l", lambda x: x["id"]).alias("ids"), F.transform("l", lambda x: x["ms"]).alias("gaps"), F.lit(1).alias("has_m1"))
    rows = network.withColumn("has_m2", F.lit(1)).join(graph.withColumn("has_m4", F.lit(1)), key, "full").join(lists, key, "full")
    rows = rows.fillna(0).withColumn("has_m3", F.lit(1))
    rows = rows.withColumns({"ids": F.coalesce("ids", F.array().cast("array<int>")), "gaps": F.coalesce("gaps", F.array().cast("array<bigint>")), "n_kinds": F.col("has_m1") + F.col("has_m2") + F.col("has_m4")})
    padded = lambda names, n: F.array(*[F.col(c).cast("double") for c in names], *[F.lit(0.0)] * (n - len(names)))
    arrays = {"m2_numeric": padded(NETWORK, 64), "m3_categorical": F.array(F.lit(0.0), F.col("n_kinds").cast("double"), *[F.lit(0.0)] * 6), "m4_graph": padded(GRAPH, 24)}
    return feature_sets.flat(rows.withColumns(arrays), key, WIDTHS, "ids", "gaps", MASK).withColumn("mean_gap", rounded(F.col("mean_gap"), 3))


def _drawn(n: int, m: int, salt: int) -> list[list[float]]:
    """A matrix of fixed numbers between -1 and 1."""
    return [[math.sin(salt + 1.7 * i * m + 0.9 * j) for j in range(m)] for i in range(n)]


def stand_in_weights(embed: int = 8) -> dict:
    """Weights of the right shapes by a rule; a trained network's are read from its export."""
    layer = lambda n, m, salt: {"weight": _drawn(n, m, salt), "bias": _drawn(1, n, salt + 0.5)[0]}
    encoders = [{"linear0": layer(embed, b - a, k), "groupnorm": {"num_groups": 2, "eps": 1e-5, "weight": _drawn(1, embed, k + 0.1)[0], "bias": _drawn(1, embed, k + 0.2)[0]}, "linear1": layer(embed, embed, k + 10)} for k, (a, b) in enumerate(forward.SLICES)]
    return {"encoders": encoders, "fusion": {"gate_linear0": layer(embed, 4 * embed + 4, 20), "gate_linear1": layer(4, embed, 21), "embed_dim": embed}, "head": {"linear0": layer(embed, embed, 30), "linear1": layer(1, embed, 31)}}


@query()
def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, shares of the modalities, and the largest of them, for every window of the flow table."""
    network = flow_table(spark, sf_dir)
    graph = windows.peer_ports(eve.peers(records(spark, sf_dir), WEEKS)).withColumn("has_m4", F.lit(True))
    rows = network.join(graph, ["host", "window_start"], "left")
    small = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    values = {f"m2_{i}": small(c) for i, c in enumerate(NETWORK)} | {f"m4_{i}": small(GRAPH[i]) if i < len(GRAPH) else F.lit(0.0) for i in range(8)} | {f"m1_{i}": F.lit(0.0) for i in range(8)} | {"m3_0": F.lit(1.0), "m3_1": F.lit(2.0)}
    rows = rows.withColumns(values | {"has_m1": F.lit(False), "has_m2": F.lit(True), "has_m3": F.lit(True), "has_m4": F.coalesce("has_m4", F.lit(False))})
    found = forward.with_scores(rows.select("host", "window_start", *feature_sets.feature_columns("all"), *MASK), feature_sets.feature_columns("all"), MASK, stand_in_weights())
    return found.select("host", "window_start", rounded(F.col("score")).alias("score"), *(rounded(F.get("attribution", F.lit(i))).alias(f"share_{m}") for i, m in enumerate(feature_sets.MODALITIES)), feature_sets.dominant_modality(F.col("attribution")).alias("dominant"))


@query(f"""WITH e AS (SELECT user_id % 4 AS replica, CASE WHEN json_extract_string(props, '$.none') IS NULL AND event_id % 50 <> 0 THEN epoch_us(ts) / 1e6 END AS ts FROM events)
SELECT replica, count(ts) AS n_timed, count(*) - count(ts) AS n_skipped, count(DISTINCT floor(ts / {WIDE})) AS n_windows FROM e GROUP BY replica""")
def rows_without_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with and without a time, and windows, by replica; every fiftieth event stands for a line without one."""
    rows = events(spark, sf_dir).withColumns({"replica": F.col("host") % 4, "ts": F.when(F.col("event_id") % 50 != 0, F.col("ts"))})
    return windows.timed_and_untimed(rows, ["replica"], WIDE)


_DIGEST = ", '-', ".join(f"coalesce(sum(('0x' || substr(md5(row_id::VARCHAR), {8 * i + 1}, 8))::BIGINT), 0)" for i in range(4))


@query(f"WITH {ORDERS}, {R0} SELECT part, concat(count(*), '-', {_DIGEST}) AS signature FROM r0 GROUP BY part")
def split_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the rows of each part, whatever their order."""
    return signatures.signatures(splits.random_stratified(orders(spark, sf_dir), "y", SEED), ["part"])


@query(f"""WITH {SCORED}, {CURVE}, {CORNERS}, {BEST}, a AS (SELECT fold, {r('sum(p/pos*(tp/(tp+fp)))')} AS ap, {r('sum(q*(2*tp-p))/(2*max(pos)*max(neg))')} AS auc FROM k GROUP BY fold),
cf AS (SELECT fold, count(*) AS n, sum(y)::BIGINT AS positives, count(*) FILTER (score>=0.5 AND y=1) AS tp, count(*) FILTER (score>=0.5 AND y=0) AS fp, count(*) FILTER (score<0.5 AND y=1) AS fn, count(*) FILTER (score<0.5 AND y=0) AS tn FROM s GROUP BY fold),
bn AS (SELECT fold, y, list_sum(list_transform(range(1,15), lambda e: (score > e/15)::INT)) AS bin, score FROM s), g AS (SELECT fold, y, bin, count(*) AS n, avg(y) AS rate, avg(score) AS mean FROM bn GROUP BY ALL), ec AS (SELECT fold, y, {r('sum(n*abs(rate-mean))/sum(n)')} AS ece FROM g GROUP BY ALL),
o AS (SELECT fold, row_number() OVER w AS k, sum(((score>=0.5)::INT <> y)::INT) OVER w AS err, count(*) OVER (PARTITION BY fold) AS n FROM s WINDOW w AS (PARTITION BY fold ORDER BY abs(score-0.5) DESC, event_id)), p AS (SELECT *, err/k AS risk, lag(err/k) OVER (PARTITION BY fold ORDER BY k) AS before FROM o),
rc AS (SELECT fold, {r('coalesce(sum((risk+before)/2/n),0)')} AS aurc, {r('max(risk) FILTER (k=n)')} AS risk_full, {r('max(risk) FILTER (k=greatest(n//2,1))')} AS risk_half, {r('max(risk) FILTER (k=greatest(n//5,1))')} AS risk_fifth FROM p GROUP BY fold)
SELECT fold, n, positives, tp, fp, fn, tn, ap, auc, {r('tpr')} AS tpr_at_fpr, {r('t.score')} AS at_threshold, coalesce({r('(tp::DOUBLE*tn-fp::DOUBLE*fn)/sqrt(nullif((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn), 0))')}, 0) AS mcc, CASE WHEN tp+fp>0 THEN {r('tp/(tp+fp)')} END AS precision, CASE WHEN tp+fn>0 THEN {r('tp/(tp+fn)')} END AS recall,
(SELECT ece FROM ec WHERE ec.fold = cf.fold AND y = 1) AS ece_positive, (SELECT ece FROM ec WHERE ec.fold = cf.fold AND y = 0) AS ece_negative, aurc, risk_full, risk_half, risk_fifth FROM cf JOIN a USING (fold) JOIN t USING (fold) JOIN rc USING (fold)""")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detection metrics of each fold in one row."""
    return protocol.metric_bundle(protocol.require_clean(scored(spark, sf_dir), ["fold"]), ["fold"], "event_id")


HELD = """h AS (SELECT l_suppkey % 4 AS replica, l_suppkey % 10 AS host, (l_discount > 0.08)::INT AS y, l_quantity > 25 AS has_m1, l_linenumber % 2 = 1 AS has_m2, l_tax > 0.04 AS has_m4 FROM lineitem)"""
FLOORS = {"mask": ["has_m1", "has_m2", "has_m4"], "host": ["host"], "both": ["has_m1", "has_m2", "has_m4", "host"]}


def held_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 4).alias("replica"), (F.col("l_suppkey") % 10).alias("host"), (F.col("l_discount") > 0.08).cast("int").alias("y"), (F.col("l_quantity") > 25).alias("has_m1"), (F.col("l_linenumber") % 2 == 1).alias("has_m2"), (F.col("l_tax") > 0.04).alias("has_m4"))


def _floor_sql(name: str) -> str:
    rate = "coalesce((a.p - c.p) / nullif(a.n - c.n, 0), (w.p - o.p) / nullif(w.n - o.n, 0))"
    return f"""SELECT replica, '{name}' AS seen, max(n)::BIGINT AS n, max(positives)::BIGINT AS positives, CASE WHEN max(positives) > 0 AND max(positives) < max(n) THEN {r("sum(p / nullif(positives, 0) * (tp / (tp + fp)))")} END AS ap FROM (
  SELECT *, sum(p) OVER w2 AS tp, sum(q) OVER w2 AS fp FROM (SELECT c.replica, {r(rate, 9)} AS score, sum(c.p) AS p, sum(c.n - c.p) AS q, max(o.n) AS n, max(o.p) AS positives FROM c_{name} c JOIN a_{name} a USING (k) JOIN o USING (replica) CROSS JOIN w GROUP BY ALL) WINDOW w2 AS (PARTITION BY replica ORDER BY score DESC)) GROUP BY replica"""


_CELLS = ", ".join(f"c_{n} AS (SELECT replica, ({', '.join(c)},) AS k, count(*) AS n, sum(y) AS p FROM h GROUP BY ALL), a_{n} AS (SELECT k, sum(n) AS n, sum(p) AS p FROM c_{n} GROUP BY k)".replace(f"({c[0]},)", f"{c[0]}").replace(",) AS k", ") AS k") for n, c in FLOORS.items())


@query(f"WITH {HELD}, o AS (SELECT replica, count(*) AS n, sum(y) AS p FROM h GROUP BY replica), w AS (SELECT sum(n) AS n, sum(p) AS p FROM o), {_CELLS} " + " UNION ALL ".join(map(_floor_sql, FLOORS)))
def leave_one_out_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of the mask, the host and both, without any feature, on each held-out replica."""
    return leakage.leave_one_out_floors(held_rows(spark, sf_dir), "replica", "y", FLOORS)


@query(f"""WITH {HELD}, c AS (SELECT has_m1::INT + 2 * has_m2::INT + 4 * has_m4::INT AS code, host, count(*) AS c FROM h WHERE y = 1 GROUP BY ALL)
SELECT code, sum(c)::BIGINT AS n, {r('sum(c) / (SELECT sum(c) FROM c)')} AS share, count(*) AS n_hosts, {r('max(c) / sum(c)')} AS most_on_one_host FROM c GROUP BY code""")
def positives_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive rows by pattern of available inputs, and how many of each are on one host."""
    return leakage.positives_by_pattern(held_rows(spark, sf_dir), "y", ["has_m1", "has_m2", "has_m4"], "host")


@query("""WITH d AS (SELECT source AS bundle, lang AS part, quality IS NOT NULL AS labelled FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
p AS (SELECT bundle, part, count(*) AS n, count(*) FILTER (labelled) AS k FROM d GROUP BY ALL)
SELECT CASE grouping(bundle) + grouping(part) WHEN 0 THEN 'part' WHEN 1 THEN 'bundle' ELSE 'all' END AS level, bundle, part, sum(n)::BIGINT AS n, sum(k)::BIGINT AS n_labelled, """ + r("sum(k) / sum(n)") + """ AS share, count(*) AS n_parts, count(*) FILTER (k > 0) AS n_parts_labelled FROM p GROUP BY ROLLUP (bundle, part)""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recorded lines, their source as the bundle and their language as the file: how far labels cover them."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", "left")
    return coverage.coverage(rows, "source", "lang", F.col("quality").isNotNull())


@query("""WITH s AS (SELECT user_id % 4 AS fold, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'NaN'::DOUBLE ELSE value END AS score, CASE WHEN event_id % 101 = 0 THEN 2 ELSE (event_type = 'error')::INT END AS y FROM events)
SELECT fold, count(*) AS n, count(*) FILTER (score IS NULL OR isnan(score)) AS bad_scores, count(*) FILTER (y NOT IN (0, 1)) AS bad_labels FROM s GROUP BY fold""")
def metric_input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by fold that metrics must not be made of; some scores and labels are spoilt for it."""
    e = events(spark, sf_dir)
    score = F.when(F.col("event_id") % 97 == 0, None).when(F.col("event_id") % 89 == 0, float("nan")).otherwise(F.col("value"))
    rows = e.select((F.col("host") % 4).alias("fold"), score.alias("score"), F.when(F.col("event_id") % 101 == 0, 2).otherwise((F.col("event_type") == "error").cast("int")).alias("y"))
    return protocol.input_errors(rows, ["fold"])
