"""Queries over splits, leakage controls and detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..operators import curves, leakage, splits, statistics
from .base import EVENTS, WIDE, events, query, r, table
from .telemetry import STRETCH, stretched

SEED = 7


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows in time with the customer as a long-lived group; open ones are positive."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("entity"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("t"), (F.col("o_orderstatus") == "O").cast("int").alias("y"), F.col("o_totalprice").alias("price"))


ORDERS = "o AS (SELECT o_orderkey AS row_id, o_custkey AS entity, epoch_us(o_orderdate)/1e6 AS t, (o_orderstatus='O')::INT AS y, o_totalprice AS price FROM orders)"
R0 = f"""r0 AS (SELECT row_id, CASE WHEN k <= floor(n*0.6+0.5) THEN 'train' WHEN k <= floor(n*0.8+0.5) THEN 'val' ELSE 'test' END AS part FROM (SELECT row_id, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}|' || row_id), row_id) AS k, count(*) OVER (PARTITION BY y) AS n FROM o))"""
GAP = 86400
CHRON = f"""c0 AS (SELECT row_id, t, entity, row_number() OVER (ORDER BY t, row_id) AS k, count(*) OVER () AS n FROM o),
c1 AS (SELECT row_id, t, entity, CASE WHEN k <= floor(n*0.6) THEN 'train' WHEN k <= floor(n*0.8) THEN 'val' ELSE 'test' END AS part FROM c0),
c2 AS (SELECT * FROM c1 WHERE part <> 'val' OR t > (SELECT max(t) FROM c1 WHERE part='train') + {GAP}),
r1 AS (SELECT row_id, entity, part FROM c2 WHERE part <> 'test' OR t > coalesce((SELECT max(t) FROM c2 WHERE part='val'), (SELECT max(t) FROM c1 WHERE part='train')) + {GAP})"""


@query(f"WITH {ORDERS}, {R0} SELECT * FROM r0")
def split_r0_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return splits.random_stratified(rows, "y", SEED)


@query(f"WITH {ORDERS}, {CHRON} SELECT row_id, part FROM r1")
def split_r1_chronological_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chronological(orders(spark, sf_dir), "t", GAP)


@query(f"WITH {ORDERS}, {CHRON}, g AS (SELECT entity, min(CASE part WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS first FROM r1 GROUP BY entity) SELECT row_id, part FROM r1 JOIN g USING (entity) WHERE first = CASE part WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END")
def split_r2_group_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return splits.without_shared_groups(splits.chronological(rows, "t", GAP), rows, "entity")


@query(f"""WITH {ORDERS}, g AS (SELECT entity, row_number() OVER (ORDER BY md5('{SEED}|' || entity), entity) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM o))
SELECT row_id, CASE WHEN k <= ceil(n*0.2) THEN 'test' WHEN k <= ceil(n*0.2)+ceil(n*0.2) THEN 'val' ELSE 'train' END AS part FROM o JOIN g USING (entity)""")
def split_r2b_group_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.by_groups(orders(spark, sf_dir), "entity", SEED)


REPLICAS = "o AS (SELECT c_custkey AS row_id, r_name AS replica FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)"


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").alias("row_id"), F.col("r_name").alias("replica"), F.col("c_acctbal").alias("x"), (F.col("c_acctbal") < 0).cast("int").alias("y"))


@query(f"""WITH {REPLICAS}, n AS (SELECT DISTINCT replica FROM o), p AS (SELECT a.replica AS fold, b.replica, row_number() OVER (PARTITION BY a.replica ORDER BY md5('{SEED}|' || a.replica || '|' || b.replica), b.replica) AS k, count(*) OVER (PARTITION BY a.replica) AS n FROM n a JOIN n b ON a.replica <> b.replica),
q AS (SELECT fold, replica, CASE WHEN k <= greatest(1, round_even(n*0.2, 0)) THEN 'val' ELSE 'train' END AS part FROM p UNION ALL SELECT replica, replica, 'test' FROM n) SELECT fold, row_id, part FROM o JOIN q USING (replica)""")
def split_r3_leave_replica_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leave_one_out(replicas(spark, sf_dir), "replica", SEED)


@query(f"""WITH o AS (SELECT doc_id AS row_id, lang FROM documents) SELECT row_id, CASE WHEN lang <> 'en' THEN 'test' WHEN k <= floor(n*0.2) THEN 'val' ELSE 'train' END AS part
FROM (SELECT row_id, lang, row_number() OVER (PARTITION BY lang='en' ORDER BY md5('{SEED}|' || row_id), row_id) AS k, count(*) OVER (PARTITION BY lang='en') AS n FROM o)""")
def split_r4_cross_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on one corpus (English), test on the others; a fifth of the training corpus validates."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    return splits.cross_corpus(rows, F.col("lang") == "en", SEED)


TIMELINE = f"""t0 AS (SELECT host || '|' || window_start AS row_id, host, window_start, stretch, row_number() OVER (PARTITION BY host ORDER BY window_start) AS k, count(*) OVER (PARTITION BY host) AS n FROM z),
t1 AS (SELECT row_id, host || '|' || stretch AS st, CASE WHEN k <= floor(n*0.6) THEN 'train' WHEN k <= floor(n*0.8) THEN 'val' ELSE 'test' END AS part FROM t0)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = stretched(spark, sf_dir)
    return z.select(F.concat_ws("|", "host", "window_start").alias("row_id"), "host", "window_start", "y", F.concat_ws("|", "host", "stretch").alias("st"))


@query(f"WITH {EVENTS}, {STRETCH}, {TIMELINE} SELECT row_id, part FROM t1")
def split_per_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chronological(timeline(spark, sf_dir), "window_start", -1, by=["host"])


@query(f"WITH {EVENTS}, {STRETCH}, {TIMELINE}, g AS (SELECT st, min(CASE part WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS first FROM t1 GROUP BY st) SELECT row_id, part FROM t1 JOIN g USING (st) WHERE first = CASE part WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END")
def split_stretch_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir)
    return splits.purged(splits.chronological(rows, "window_start", -1, by=["host"]), rows, "st")


@query(f"WITH {ORDERS}, {R0} SELECT part, count(*) AS n, sum(y)::BIGINT AS positives, {r('avg(y)')} AS prevalence FROM o JOIN r0 USING (row_id) GROUP BY part")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    joined = splits.random_stratified(rows, "y", SEED).join(rows, "row_id")
    return joined.groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), rounded(F.avg("y")).alias("prevalence"))


# Leakage controls


@query(f"WITH c AS (SELECT l_returnflag, l_quantity, l_discount, l_tax, count(*) AS c FROM lineitem GROUP BY ALL) SELECT l_returnflag, sum(c)::BIGINT AS n, count(*) AS n_unique, sum(c-1)::BIGINT AS excess, sum(CASE WHEN c>1 THEN c ELSE 0 END)::BIGINT AS members, {r('sum(c-1)/greatest(sum(c),1)')} AS fraction FROM c GROUP BY l_returnflag")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.exact_duplicates(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])


@query(f"WITH o AS (SELECT doc_id AS row_id, 1 AS y FROM documents), {R0} SELECT d.doc_id FROM documents d JOIN r0 ON d.doc_id=row_id WHERE part='test' AND md5(text) IN (SELECT md5(text) FROM documents JOIN r0 ON doc_id=row_id WHERE part='train')")
def cross_split_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    parts = splits.random_stratified(documents.select(F.col("doc_id").alias("row_id"), F.lit(1).alias("y")), "y", SEED)
    rows = documents.join(parts, documents["doc_id"] == parts["row_id"])
    return leakage.twins(rows.where("part = 'test'"), rows.where("part = 'train'"), ["key"]).select("doc_id")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark) b WHERE length(trim(line)) >= 40 AND list_contains(string_split(d.text, chr(10)), line))")
def benchmark_line_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a long line of the benchmark."""
    line = lambda t, *keep: table(spark, sf_dir, t).select(*keep, F.explode(F.split("text", "\n", -1)).alias("line")).where(F.length(F.trim("line")) >= 40)
    return leakage.twins(line("documents", "doc_id"), line("benchmark"), ["line"]).select("doc_id").distinct()


def simhash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leakage.simhash(table(spark, sf_dir, "embeddings"), "embedding", 32, 0)
    return leakage.bucket_report(rows, "signature")


query()(simhash_buckets)


@query(f"WITH {ORDERS}, {R0}, p AS (SELECT DISTINCT entity, part FROM o JOIN r0 USING (row_id)) SELECT a.part, b.part AS other, count(*) AS shared FROM p a JOIN p b USING (entity) WHERE a.part < b.part GROUP BY ALL")
def group_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return leakage.group_overlap(splits.random_stratified(rows, "y", SEED).join(rows, "row_id"), "entity")


FLOOR = f"""f AS (SELECT event_id AS row_id, (event_type='error')::INT AS y, (value > 10)::INT AS a, (value > 30)::INT AS b, ('0x' || substr(md5('{SEED}|' || event_id), 1, 6))::BIGINT % 5 AS fold FROM events),
g AS (SELECT a, b, fold, count(*) AS n, sum(y) AS p FROM f GROUP BY ALL),
h AS (SELECT a, b, fold, sum(n) OVER (PARTITION BY a, b) - n AS n, sum(p) OVER (PARTITION BY a, b) - p AS p FROM g),
s AS (SELECT row_id, y, {r("CASE WHEN n>0 THEN p/n ELSE 0 END")} AS score FROM f JOIN h USING (a, b, fold))"""


def floor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_id").alias("row_id"), F.col("is_attack").cast("int").alias("y"), (F.col("value") > 10).cast("int").alias("a"), (F.col("value") > 30).cast("int").alias("b"))
    return leakage.pattern_floor(rows, ["a", "b"], "y", 5, SEED)


@query(f"WITH {FLOOR} SELECT * FROM s")
def mask_only_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floor_scores(spark, sf_dir)


@query(f"""WITH o AS (SELECT o_orderkey AS row_id, (o_orderstatus='O')::INT AS y FROM orders), l AS (SELECT row_id, row_number() OVER (ORDER BY md5('{SEED + 1}|' || row_id), row_id) AS k FROM o),
q AS (SELECT y, row_number() OVER (ORDER BY md5('{SEED}|' || row_id), row_id) AS k FROM o) SELECT row_id, y FROM l JOIN q USING (k)""")
def label_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.permuted_labels(orders(spark, sf_dir), "y", SEED)


# Metrics: events as scored rows, the error type as the label, a squashed value as the score

SCORED = "s AS (SELECT user_id % 4 AS fold, event_id, (event_type='error')::INT AS y, round_even(least(value, 100), 0)/100 AS score FROM events)"
CURVE = """c AS (SELECT fold, score, sum(y)::BIGINT AS p, sum(1-y)::BIGINT AS q FROM s GROUP BY ALL),
k AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY fold) AS pos, sum(q) OVER (PARTITION BY fold) AS neg FROM c WINDOW w AS (PARTITION BY fold ORDER BY score DESC))"""
CORNERS = "x AS (SELECT * FROM (SELECT *, coalesce(p * lead(q) OVER w <> q * lead(p) OVER w, true) AS bends FROM k WINDOW w AS (PARTITION BY fold ORDER BY score DESC)) WHERE bends)"
BEST = "t AS (SELECT fold, coalesce(tpr,0) AS tpr, coalesce(fpr,0) AS fpr, score FROM (SELECT DISTINCT fold FROM s) LEFT JOIN (SELECT fold, tp/pos AS tpr, fp/neg AS fpr, score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY tp DESC, score DESC) AS i FROM x WHERE fp/neg <= 0.01) WHERE i=1) USING (fold))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select((F.col("host") % 4).alias("fold"), "event_id", F.col("is_attack").cast("int").alias("y"), (F.rint(F.least("value", F.lit(100.0))) / 100).alias("score"))


@query(f"WITH {SCORED}, {CURVE} SELECT fold, score, tp::BIGINT AS tp, fp::BIGINT AS fp, {r('tp/(tp+fp)')} AS precision, {r('tp/pos')} AS recall FROM k")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = curves.curve(scored(spark, sf_dir), ["fold"])
    return k.select("fold", "score", "tp", "fp", rounded(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), rounded(F.col("tp") / F.col("pos")).alias("recall"))


@query(f"WITH {SCORED}, {CURVE} SELECT fold, {r('sum(p/pos*(tp/(tp+fp)))')} AS ap FROM k GROUP BY fold")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.average_precision(curves.curve(scored(spark, sf_dir), ["fold"]), ["fold"])


@query(f"WITH {SCORED}, {CURVE} SELECT fold, {r('sum(q*(2*tp-p))/(2*max(pos)*max(neg))')} AS auc FROM k GROUP BY fold")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.roc_auc(curves.curve(scored(spark, sf_dir), ["fold"]), ["fold"])


@query(f"WITH {SCORED}, {CURVE}, {CORNERS} SELECT fold, score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM x")
def roc_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.roc_corners(curves.curve(scored(spark, sf_dir), ["fold"]), ["fold"]).select("fold", "score", "tp", "fp")


@query(f"WITH {SCORED}, {CURVE}, {CORNERS}, {BEST} SELECT fold, {r('tpr')} AS tpr, {r('fpr')} AS fpr, {r('score')} AS threshold FROM t")
def tpr_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.tpr_at_fpr(curves.curve(scored(spark, sf_dir), ["fold"]), ["fold"], 0.01)


@query(f"""WITH {SCORED}, {CURVE}, {CORNERS}, {BEST}, u AS (SELECT fold, {r('tpr')} AS tpr, {r('fpr')} AS fpr FROM t), b AS (SELECT unnest([0.01::DOUBLE, 0.001::DOUBLE, 0.0001::DOUBLE]) AS base_rate)
SELECT fold, base_rate, CASE WHEN tpr*base_rate + fpr*(1-base_rate) > 0 THEN {r('tpr*base_rate/(tpr*base_rate + fpr*(1-base_rate))')} END AS ppv, {r('fpr*1440')} AS alerts_per_day FROM u CROSS JOIN b""")
def ppv_base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = curves.tpr_at_fpr(curves.curve(scored(spark, sf_dir), ["fold"]), ["fold"], 0.01)
    return curves.ppv_at_base_rates(rates, ["fold"], [0.01, 0.001, 0.0001])


@query(f"""WITH {SCORED}, c AS (SELECT fold, count(*) FILTER (score>=0.2 AND y=1) AS tp, count(*) FILTER (score>=0.2 AND y=0) AS fp, count(*) FILTER (score<0.2 AND y=1) AS fn, count(*) FILTER (score<0.2 AND y=0) AS tn FROM s GROUP BY fold)
SELECT *, CASE WHEN tp+fp>0 THEN {r('tp/(tp+fp)')} END AS precision, CASE WHEN tp+fn>0 THEN {r('tp/(tp+fn)')} END AS recall, {r('(tp::DOUBLE*tn-fp::DOUBLE*fn)/sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn))')} AS mcc FROM c""")
def confusion_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.confusion(scored(spark, sf_dir), ["fold"], 0.2)


@query(f"""WITH {SCORED}, b AS (SELECT fold, y, list_sum(list_transform(range(1,15), lambda e: (score > e/15)::INT)) AS bin, score FROM s),
g AS (SELECT fold, y, bin, count(*) AS n, avg(y) AS rate, avg(score) AS mean FROM b GROUP BY ALL) SELECT fold, y, {r('sum(n*abs(rate-mean))/sum(n)')} AS ece, sum(n)::BIGINT AS n FROM g GROUP BY ALL""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.calibration_error(scored(spark, sf_dir), ["fold"])


@query(f"WITH {SCORED} SELECT fold, y, list_sum(list_transform(range(1,20), lambda e: (score >= e/20)::INT))::INT AS bin, count(*) AS n FROM s GROUP BY ALL")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.histogram(scored(spark, sf_dir), ["fold", "y"])


@query(f"""WITH {SCORED}, o AS (SELECT fold, row_number() OVER w AS k, sum(((score>=0.5)::INT <> y)::INT) OVER w AS err, count(*) OVER (PARTITION BY fold) AS n FROM s WINDOW w AS (PARTITION BY fold ORDER BY abs(score-0.5) DESC, event_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, err/k AS risk, lag(err/k) OVER (PARTITION BY fold ORDER BY k) AS before FROM o)
SELECT fold, {r('coalesce(sum((risk+before)/2/n),0)')} AS aurc, {r('max(risk) FILTER (k=n)')} AS risk_full, {r('max(risk) FILTER (k=greatest(n//2,1))')} AS risk_half, {r('max(risk) FILTER (k=greatest(n//5,1))')} AS risk_fifth FROM p GROUP BY fold""")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = (F.col("score") >= 0.5).cast("int") != F.col("y")
    return curves.risk_coverage(scored(spark, sf_dir), ["fold"], F.abs(F.col("score") - 0.5), "event_id", wrong)


# Statistics over runs: average precision of methods by fold

METHODS = f"m AS (SELECT user_id % 10 AS fold, event_type AS method, {r('avg(value)')} AS score FROM events GROUP BY ALL)"


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy((F.col("host") % 10).alias("fold"), F.col("event_type").alias("method")).agg(rounded(F.avg("value")).alias("score"))


def whole_mean(when: str) -> str:
    """SQL of the mean of six-digit scores, summed in whole millionths."""
    return f"sum(round_even(score*1e6,0)::BIGINT) FILTER ({when}) / count(score) FILTER ({when}) / 1e6"


@query(f"WITH {METHODS} SELECT method, count(*) AS n, {r(whole_mean('true'))} AS mean, {r('coalesce(stddev_samp(score),0)')} AS std, {r('min(score)')} AS min, {r('max(score)')} AS max FROM m GROUP BY method")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.fold_summary(methods(spark, sf_dir), ["method"], "score")


@query(f"WITH {METHODS}, k AS (SELECT fold, method, rank() OVER (PARTITION BY fold ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY fold, score) AS t FROM m) SELECT method, {r('avg(r+(t-1)/2)')} AS mean_rank, count(*) AS n_folds FROM k GROUP BY method")
def friedman_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.mean_ranks(methods(spark, sf_dir), "fold", "method", "score")


@query(f"""WITH {METHODS}, p AS (SELECT fold, method, CASE WHEN method='view' AND fold=0 THEN NULL ELSE {r('score/1000')} END AS p FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p, method) AS i, count(*) OVER (PARTITION BY fold) AS n FROM p WHERE p IS NOT NULL),
a AS (SELECT fold, method, p, least(1.0, max(p*(n-i+1)) OVER (PARTITION BY fold ORDER BY i)) AS adj FROM k) SELECT fold, method, p, {r('adj')} AS adjusted, adj <= 0.05 AS rejected FROM a UNION ALL SELECT fold, method, p, NULL, false FROM p WHERE p IS NULL""")
def holm_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = (F.col("method") == "view") & (F.col("fold") == 0)
    tests = methods(spark, sf_dir).select("fold", "method", F.when(~unknown, rounded(F.col("score") / 1000)).alias("p"))
    return statistics.holm(tests, ["fold"], "method", "p")


@query(f"""WITH d AS (SELECT user_id % 4 AS fold, round_even(value,0) AS v, (event_type='error') AS a FROM events),
c AS (SELECT fold, v, count(*) FILTER (a) AS a, count(*) FILTER (NOT a) AS b FROM d GROUP BY ALL),
x AS (SELECT l.fold, {r("sum(l.a*k.b*sign(l.v-k.v))/(max(t.a)*max(t.b))")} AS delta FROM c l JOIN c k USING (fold) JOIN (SELECT fold, sum(a) AS a, sum(b) AS b FROM c GROUP BY fold) t USING (fold) GROUP BY l.fold)
SELECT fold, delta, CASE WHEN abs(delta)<0.147 THEN 'negligible' WHEN abs(delta)<0.33 THEN 'small' WHEN abs(delta)<0.474 THEN 'medium' ELSE 'large' END AS band FROM x""")
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("host") % 4).alias("fold"), F.rint("value").alias("v"), "is_attack")
    return statistics.cliffs_delta(rows, ["fold"], "v", F.col("is_attack"))


@query(f"WITH {METHODS} SELECT method, {r(whole_mean('fold % 2=0'))} AS r0, {r(whole_mean('fold % 2=1'))} AS r1, {r(f"{whole_mean('fold % 2=0')} - {whole_mean('fold % 2=1')}")} AS drop, {whole_mean('fold % 2=0')} - {whole_mean('fold % 2=1')} >= 0.02 AS passes FROM m GROUP BY method")
def inflation_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = methods(spark, sf_dir).withColumn("split", F.when(F.col("fold") % 2 == 0, "r0").otherwise("r1"))
    return statistics.inflation(runs, "method", "split", "score", ["r0", "r1"])
