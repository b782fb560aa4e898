"""Queries over the ledger, profiles, the cost model, neighbours, detectors and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..operators import curves, detectors, ledger, neighbours, profiles, splits
from ..tables import staged
from .base import EVENTS, events, query, r, table
from .evaluation import ORDERS, R0, SEED, orders
from .telemetry import STRETCH, labelled_windows, stretched

VERDICTS = """v AS (SELECT event_id AS idx, '{"host_hash":"' || substr(sha256(user_id::VARCHAR), 1, 16) || '","model_git_sha":"0000000","score":"' || printf('%.2f', value) || '","ts_bucket":' || (floor(epoch_us(ts)/1e6/60)*60)::BIGINT || ',"verdict":' || (event_type='error')::INT || ',"window_id":"w' || event_id || '"}' AS entry FROM events)"""
LEAVES = VERDICTS + """, l0 AS (SELECT idx, sha256('\\x00'::BLOB || encode(entry)) AS hash FROM v)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict per event, its number the place in the log."""
    e = events(spark, sf_dir)
    host = F.substring(F.sha2(F.col("host").cast("string").cast("binary"), 256), 1, 16)
    start = (F.floor(F.col("ts") / 60) * 60).cast("long")
    entry = ledger.canonical_verdict(F.concat(F.lit("w"), F.col("event_id")), host, start, F.col("is_attack").cast("int"), F.format_string("%.2f", "value"), F.lit("0000000"))
    return e.select(F.col("event_id").alias("idx"), entry.alias("entry"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("idx", ledger.leaf_hash(F.col("entry")).alias("hash"))


@query(f"WITH {LEAVES} SELECT idx, hash FROM l0")
def ledger_leaf_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(spark, sf_dir)


LEVEL = "SELECT idx//2 AS idx, CASE WHEN max(hash) FILTER (idx%2=1) IS NULL THEN max(hash) FILTER (idx%2=0) ELSE sha256('\\x01'::BLOB || unhex(max(hash) FILTER (idx%2=0)) || unhex(max(hash) FILTER (idx%2=1))) END AS hash FROM {0} GROUP BY idx//2"


@query(f"WITH {LEAVES} {LEVEL.format('l0')}")
def ledger_first_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.next_level(leaves(spark, sf_dir))


@query(f"WITH {LEAVES}" + "".join(f", l{i} AS ({LEVEL.format(f'l{i - 1}')})" for i in range(1, 25)) + " SELECT hash AS root, (SELECT count(*) FROM v) AS size FROM l24")
def ledger_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leaves(spark, sf_dir)
    size = rows.count()
    return ledger.root(rows, size).select(F.col("hash").alias("root"), F.lit(size).cast("long").alias("size"))


#: Of so many top levels the nodes are few, and each is the sibling of many entries.
TOP_LEVELS = 12


PATHS = f"WITH {LEAVES}" + "".join(f", l{i} AS MATERIALIZED ({LEVEL.format(f'l{i - 1}')})" for i in range(1, 25)) + ", nodes AS (" + " UNION ALL ".join(f"SELECT {i} AS level, idx, hash FROM l{i}" for i in range(25)) + ") SELECT l0.idx, n.level, n.idx AS sibling, n.hash FROM nodes n JOIN l0 ON n.idx = xor(l0.idx >> n.level, 1)"


@query(PATHS)
def ledger_inclusion_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path of every entry, from its sibling up to the root."""
    rows = staged(leaves(spark, sf_dir), "ledger-leaves")
    size = rows.count()
    nodes = ledger.levels(rows, size, lambda level: staged(level, "ledger-level"))
    low = max(0, (size - 1).bit_length() - TOP_LEVELS)
    below, above = nodes.where(F.col("level") < low), nodes.where(F.col("level") >= low)
    return ledger.inclusion_paths(below, rows).unionByName(ledger.inclusion_paths(F.broadcast(above), rows))


@query(PATHS.replace("SELECT l0.idx, n.level, n.idx AS sibling, n.hash FROM", "SELECT l0.idx, count(*) AS n_hashes, 32 * count(*) AS n_bytes FROM") + " GROUP BY l0.idx")
def ledger_proof_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and bytes of the inclusion proof of every entry."""
    sizes = ledger_inclusion_paths(spark, sf_dir).groupBy("idx").agg(F.count("*").alias("n_hashes"))
    return sizes.withColumn("n_bytes", 32 * F.col("n_hashes"))


@query(PATHS)
def ledger_whole_inclusion_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former name of ledger_inclusion_paths over all levels; both are one."""
    return ledger_inclusion_paths(spark, sf_dir)


@query(f"WITH {VERDICTS}, s AS (SELECT idx, CASE WHEN idx < 176 THEN 0 ELSE (idx-176)//175 + 1 END AS segment FROM v) SELECT segment, count(*) AS n, min(idx) AS first FROM s GROUP BY segment")
def ledger_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ledger.segments(verdicts(spark, sf_dir).select("idx"), 176)
    return cut.groupBy("segment").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


@query(f"""WITH {EVENTS}, {STRETCH}, x AS (SELECT host, stretch, ln(value) AS lx FROM ev JOIN z USING (host, window_start) WHERE value > 0),
o AS (SELECT host, stretch, count(*) AS n, avg(lx) AS m, var_pop(lx)*count(*) AS ss, sum(lx) AS s FROM x GROUP BY ALL)
SELECT host, {r("sum(s)/sum(n)")} AS mu, {r("greatest(coalesce(sqrt(CASE WHEN sum(n-1)>0 THEN sum(ss)/sum(n-1) END),0),1e-3)")} AS sigma,
{r("CASE WHEN count(*) FILTER (n>=5) >= 3 THEN sqrt(greatest(var_samp(CASE WHEN n>=5 THEN m END) - avg(CASE WHEN n>=5 THEN ss/(n-1)/n END), 0)) ELSE 0 END")} AS tau FROM o GROUP BY host""")
def profile_log_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.windows import tumbled

    rows = tumbled(events(spark, sf_dir), 21600).join(stretched(spark, sf_dir), ["host", "window_start"])
    return profiles.log_moments(rows, ["host"], "stretch", "value")


@query("SELECT (l_discount>0.05)::INT + 2*(l_tax>0.04)::INT + 4*(l_quantity>25)::INT AS code, count(*) AS n FROM lineitem GROUP BY 1")
def profile_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") > 0.05).alias("a"), (F.col("l_tax") > 0.04).alias("b"), (F.col("l_quantity") > 25).alias("c"))
    return profiles.pattern_counts(rows, ["a", "b", "c"])


@query(f"""WITH p AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v DESC) AS i FROM p) SELECT "column", {r('max(v) FILTER (i=20)')} AS kth, bool_and(v=round_even(v,0)) AS whole FROM k GROUP BY 1""")
def profile_kth_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.kth_largest(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], 20)


@query(f"""WITH {EVENTS}, w AS (SELECT host, window_start, bool_or(event_type='error')::INT AS y FROM ev GROUP BY ALL), l AS (SELECT host, y IS NOT DISTINCT FROM lag(y) OVER o AND row_number() OVER o > 1 AS e FROM w WINDOW o AS (PARTITION BY host ORDER BY window_start)) SELECT host, count(*) AS n, count(*) FILTER (e) AS repeats FROM l GROUP BY host""")
def profile_repeats_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.repeats_previous(labelled_windows(spark, sf_dir), ["host"], ["window_start"], ["y"])


COST = "c AS (SELECT s AS segment, 200000*(1+log2(s))*2.84e-7 + (ceil(200000/s)-1)*6.86e-5 AS append_s, 2000*(log2(s)*2.84e-7 + 1.48e-4) AS verify_s, 0.3*2000*(2e-4 + log2(ceil(200000/s))*5e-6) AS fetch_s, 2.0*2*s*2.84e-7 AS recovery_s FROM (SELECT unnest(range(8,65537))::DOUBLE AS s))"


def costs(spark: SparkSession) -> DataFrame:
    return profiles.segment_costs(spark.range(8, 65537).select(F.col("id").alias("segment")), 200_000, 2.84e-7, 6.86e-5, 1.48e-4)


@query(f"WITH {COST} SELECT segment::BIGINT AS segment, {r('append_s')} AS append_s, {r('append_s+verify_s+fetch_s+recovery_s')} AS total_s FROM c")
def cost_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs(spark).select("segment", rounded(F.col("append_s")).alias("append_s"), rounded(F.col("total_s")).alias("total_s"))


@query(f"WITH {COST}, t AS (SELECT segment, append_s+verify_s+fetch_s+recovery_s AS total FROM c) SELECT arg_min(segment, total)::BIGINT AS segment, {r('min(total)', 5)} AS total_s FROM t")
def cost_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.cheapest(costs(spark)).select("segment", rounded(F.col("total_s"), 5).alias("total_s"))


@query(f"""WITH {ORDERS}, {R0}, q AS (SELECT quantile_cont(price,0.25) AS a, quantile_cont(price,0.5) AS b, quantile_cont(price,0.75) AS c FROM o JOIN r0 USING (row_id) WHERE part='train') SELECT row_id, {r('(price-b)/(c-a)')} AS price FROM o CROSS JOIN q""")
def train_only_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    joined = rows.join(splits.random_stratified(rows, "y", SEED), "row_id")
    return profiles.robust_scaled(joined, ["price"], F.col("part") == "train").select("row_id", "price")


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), d AS (SELECT q.vec_id AS query_id, t.vec_id AS train_id, (t.label % 2)::INT AS y, list_sum(list_transform(list_zip(q.v, t.v), lambda p: (p[1]-p[2])*(p[1]-p[2]))) AS d FROM e q JOIN e t ON q.vec_id % 100 = 0 AND t.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, train_id) AS i FROM d) SELECT query_id, {r('sum(y*pow(2.0,1-i))/sum(pow(2.0,1-i))')} AS score FROM k WHERE i<=5 GROUP BY query_id""")
def knn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("label") % 2).alias("y"))
    # Every hundredth vector is a query, held against all others: one neighbour more is sought and the query itself left out.
    found = neighbours.others(neighbours.nearest(rows.where("id % 100 = 0"), rows, 6), 5)
    return neighbours.memory_scores(found, rows).select("query_id", rounded(F.col("score")).alias("score"))


@query(f"SELECT o_orderkey AS row_id, {r(f'''('0x' || substr(md5('{SEED}|' || o_orderkey), 1, 12))::BIGINT / pow(16.0,12)''')} AS score FROM orders")
def random_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.random_scores(orders(spark, sf_dir), SEED).select("row_id", rounded(F.col("score")).alias("score"))


@query(f"WITH {ORDERS}, {R0} SELECT row_id, (SELECT {r('avg(y)')} FROM o JOIN r0 USING (row_id) WHERE part='train') AS score FROM o JOIN r0 USING (row_id) WHERE part='test'")
def majority_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    joined = rows.join(splits.random_stratified(rows, "y", SEED), "row_id")
    return detectors.prevalence_scores(joined.where("part = 'train'"), joined.where("part = 'test'"), "y").select("row_id", rounded(F.col("score")).alias("score"))


def window_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of boosted trees and of logistic regression on host windows, chronological split."""
    from ..operators.windows import network_features, tumbled

    features = ["n_events", "n_click", "n_purchase", "sum_value", "p90_value", "mean_value"]
    rows = network_features(tumbled(events(spark, sf_dir), 21600), ["host", "window_start"])
    rows = rows.select(F.concat_ws("|", "host", "window_start").alias("row_id"), "window_start", (F.col("n_error") > 0).cast("int").alias("y"), *features)
    parts = splits.chronological(rows, "window_start", 21600)
    joined = rows.join(parts, "row_id").drop("window_start")
    train, test = joined.where("part = 'train'"), joined.where("part = 'test'")
    out = None
    for name, scores in (("trees", detectors.boosted_trees(train, test, features, "y", 10)), ("logistic", detectors.logistic(train, test, features, "y"))):
        points = curves.curve(scores.join(test.select("row_id", "y"), "row_id").withColumn("model", F.lit(name)), ["model"])
        ap = curves.average_precision(points, ["model"])
        out = ap if out is None else out.unionByName(ap)
    return out


query()(window_detector)


@query("""WITH c AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 50 = 0 THEN 'x' || c_acctbal ELSE c_acctbal::VARCHAR END AS cell, CASE c_custkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'attack ' WHEN 2 THEN '0' WHEN 3 THEN ' ' WHEN 4 THEN 'perhaps' ELSE 'benign' END AS label FROM customer)
SELECT row_id, try_cast(cell AS DOUBLE) IS NULL OR lower(trim(label)) NOT IN ('', '1', '1.0', 'true', 'yes', 'attack', 'malicious', 'anomaly', '0', '0.0', 'false', 'no', 'benign', 'normal') AS bad,
CASE WHEN lower(trim(label)) IN ('1', '1.0', 'true', 'yes', 'attack', 'malicious', 'anomaly') THEN true WHEN lower(trim(label)) IN ('0', '0.0', 'false', 'no', 'benign', 'normal') THEN false END AS y FROM c""")
def csv_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.uploads import parsed

    c = table(spark, sf_dir, "customer")
    cell = F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("x"), F.col("c_acctbal").cast("string"))).otherwise(F.col("c_acctbal").cast("string"))
    label = F.element_at(F.array(*map(F.lit, ("Yes", "attack ", "0", " ", "perhaps", "benign"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = c.select(F.col("c_custkey").alias("row_id"), cell.alias("cell"), label.alias("label"))
    return parsed(rows, ["cell"], "label").select("row_id", (F.size("errors") > 0).alias("bad"), "y")
