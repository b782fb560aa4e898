"""Queries over profiles by host, replica and over all, and over normal scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.keys import rounded
from ..operators import class_profiles, copula
from .base import query, r, table

FEATURES = ["price", "excess", "urgent", "ship", "rare"]


def host_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as windows: the nation is the host, the region the replica, the month the stretch; some are a rare class."""
    o, c, n, g = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(g), F.col("n_regionkey") == F.col("r_regionkey"))
    price = F.col("o_totalprice").cast("double")
    return rows.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 41 == 0).cast("int").alias("class"), F.col("r_name").alias("replica"), F.col("n_name").alias("host"),
        F.date_format("o_orderdate", "yyyyMM").alias("stretch"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("day"),
        price.alias("price"), F.greatest(price - 300000, F.lit(0.0)).alias("excess"), F.when(F.col("o_orderpriority") == "1-URGENT", price / 1000).alias("urgent"),
        F.lit(0.0).alias("ship"), F.when(F.col("o_orderkey") % 97 == 0, price / 7).alias("rare"), F.col("c_acctbal").cast("double").alias("balance"),
    )


ROWS = """o AS (SELECT o_orderkey AS id, (o_orderkey % 41 = 0)::INT AS class, r_name AS replica, n_name AS host, strftime(o_orderdate, '%Y%m') AS stretch, o_orderpriority AS kind, o_orderdate AS day, o_totalprice::DOUBLE AS price,
  greatest(o_totalprice::DOUBLE - 300000, 0) AS excess, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice::DOUBLE / 1000 END AS urgent, 0::DOUBLE AS ship, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice::DOUBLE / 7 END AS rare, c_acctbal::DOUBLE AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LEVEL = "CASE grouping(replica) + grouping(host) WHEN 2 THEN 'all' WHEN 1 THEN 'replica' ELSE 'host' END AS level"
SETS = lambda own="": f"GROUPING SETS ((class{own}), (class, replica{own}), (class, replica, host{own}))"
GROUPS = f"g AS (SELECT {LEVEL}, class, replica, host, count(*) AS n FROM o GROUP BY {SETS()} HAVING count(*) >= {class_profiles.SUPPORT})"


def _inherited_sql(own: str, parent: str | None, on: list[str]) -> str:
    s, none = class_profiles.SUPPORT, class_profiles.NONE
    has, theirs = ("p.zero_rate IS NOT NULL", lambda v: f"p.{v}") if parent else ("false", lambda v: "NULL")
    no_help = f"(NOT {has} OR {theirs('zero_rate')} >= 1)" if parent else "true"
    whole = lambda v: f"WHEN n_present < {s} THEN CASE WHEN {has} THEN {theirs(v)} ELSE {none[v]} END WHEN n_positive = 0 THEN {none[v]}"
    moment = lambda v: f"CASE {whole(v)} WHEN n_positive < {s} THEN CASE WHEN {no_help} THEN {none[v]} ELSE {theirs(v)} END ELSE x.{v} END::DOUBLE AS {v}"
    rate = f"CASE {whole('zero_rate')} WHEN n_positive < {s} AND {no_help} THEN 1 ELSE x.zero_rate END::DOUBLE AS zero_rate"
    inherited = f"CASE WHEN n_present < {s} THEN {has} WHEN n_positive = 0 THEN false WHEN n_positive < {s} THEN NOT {no_help} ELSE false END AS inherited"
    join = f"LEFT JOIN {parent} p USING ({', '.join(on)})" if parent else ""
    return f"SELECT x.level, class, {'x.replica' if 'replica' not in on else 'replica'}, x.host, feature, {rate}, {moment('mu')}, {moment('sigma')}, {moment('tau')}, {inherited} FROM x {join} WHERE x.level = '{own}'"


PAIRS = lambda names: ", ".join(f"{{'f': '{f}', 'x': {f}}}" for f in names)


@query(f"""WITH {ROWS}, {GROUPS}, l AS (SELECT class, replica, host, stretch, p.f AS feature, p.x AS x, CASE WHEN p.x > 0 THEN ln(p.x) END AS lx FROM (SELECT *, unnest([{PAIRS(FEATURES)}]) AS p FROM o) WHERE p.x IS NOT NULL),
st AS (SELECT class, replica, host, stretch, feature, count(*) AS present, count(lx) AS k, sum(lx) AS s, avg(lx) AS m, var_pop(lx) * count(lx) AS ss FROM l GROUP BY ALL),
f AS (SELECT {LEVEL}, class, replica, host, feature, sum(present) AS n_present, sum(k) AS n_positive, sum(s) / nullif(sum(k), 0) AS mu, sum(CASE WHEN k > 0 THEN k - 1 END) AS free, sum(ss) AS within, sum(ss) + sum(k * m * m) AS square,
  count(*) FILTER (k >= 5) AS wide, var_samp(m) FILTER (k >= 5) - avg(ss / nullif(k - 1, 0) / k) FILTER (k >= 5) AS between_ FROM st GROUP BY {SETS(", feature")}),
x AS (SELECT g.level, g.class, g.replica, g.host, n.feature, coalesce(n_present, 0) AS n_present, coalesce(n_positive, 0) AS n_positive, 1 - n_positive / nullif(n_present, 0) AS zero_rate, mu,
  greatest(sqrt(CASE WHEN free > 0 THEN within / free ELSE greatest((square - n_positive * mu * mu) / nullif(n_positive, 0), 0) END), 1e-3) AS sigma, CASE WHEN wide >= 3 THEN sqrt(greatest(between_, 0)) ELSE 0 END AS tau
  FROM g CROSS JOIN (SELECT unnest({FEATURES}) AS feature) n LEFT JOIN f ON f.level = g.level AND f.class = g.class AND f.feature = n.feature AND f.replica IS NOT DISTINCT FROM g.replica AND f.host IS NOT DISTINCT FROM g.host),
a AS ({_inherited_sql("all", None, [])}), b AS ({_inherited_sql("replica", "a", ["class", "feature"])}), c AS ({_inherited_sql("host", "b", ["class", "replica", "feature"])})
SELECT level, class, replica, host, feature, {r('zero_rate')} AS zero_rate, {r('mu')} AS mu, {r('sigma')} AS sigma, {r('tau')} AS tau, inherited FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def class_profile_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of zeros and log moments of every host, replica and of all, with what has too little support taken from the coarser group."""
    found = class_profiles.inherited_profiles(host_orders(spark, sf_dir), FEATURES)
    return found.withColumns({c: rounded(F.col(c)) for c in class_profiles.NONE})


REPEATS = """w AS (SELECT *, row_number() OVER t = 1 AS first, kind = lag(kind) OVER t AS repeats FROM o WINDOW t AS (PARTITION BY class, replica, host, stretch ORDER BY day, id))"""


@query(f"""WITH {ROWS}, {REPEATS}, x AS (SELECT {LEVEL}, class, replica, host, count(*) AS n, count(*) FILTER (NOT first) AS later, count(*) FILTER (NOT first AND repeats) AS equal FROM w GROUP BY {SETS()} HAVING count(*) >= {class_profiles.SUPPORT}),
a AS (SELECT *, CASE WHEN later < 20 THEN 0 ELSE equal / later END AS rate, false AS inherited FROM x WHERE level = 'all'),
b AS (SELECT x.*, CASE WHEN x.later < 20 THEN coalesce(a.rate, 0) ELSE x.equal / x.later END AS rate, x.later < 20 AND a.n IS NOT NULL AS inherited FROM x LEFT JOIN a ON x.class = a.class WHERE x.level = 'replica'),
c AS (SELECT x.*, CASE WHEN x.later < 20 THEN coalesce(b.rate, 0) ELSE x.equal / x.later END AS rate, x.later < 20 AND b.n IS NOT NULL AS inherited FROM x LEFT JOIN b ON x.class = b.class AND x.replica = b.replica WHERE x.level = 'host')
SELECT level, class, replica, host, n::BIGINT AS n, {r('rate')} AS repeat_rate, inherited FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def profile_repeat_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a row is like the one before it in its stretch, by level."""
    from pyspark.sql import Window

    line = Window.partitionBy("class", "replica", "host", "stretch").orderBy("day", "id")
    rows = host_orders(spark, sf_dir).withColumns({"first": F.row_number().over(line) == 1, "repeats": F.col("kind") == F.lag("kind").over(line)})
    return class_profiles.inherited_repeats(rows).withColumn("repeat_rate", rounded(F.col("repeat_rate")))


@query(f"""WITH {ROWS}, {GROUPS}, k AS (SELECT {LEVEL}, class, replica, host, code, count(*) AS c FROM (SELECT *, (excess > 0)::INT + 2 * (urgent IS NOT NULL)::INT + 4 * (rare IS NOT NULL)::INT + 8 * substr(kind, 1, 1)::INT AS code FROM o) GROUP BY {SETS(", code")})
SELECT k.level, k.class, k.replica, k.host, code, {r('c / n')} AS p FROM k JOIN g ON k.level = g.level AND k.class = g.class AND k.replica IS NOT DISTINCT FROM g.replica AND k.host IS NOT DISTINCT FROM g.host""")
def profile_patterns_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_orders(spark, sf_dir).withColumns({"has_excess": F.col("excess") > 0, "has_urgent": F.col("urgent").isNotNull(), "has_rare": F.col("rare").isNotNull(), "n_sources": F.substring("kind", 1, 1).cast("double")})
    found = class_profiles.availability_patterns(rows, ["has_excess", "has_urgent", "has_rare"], "n_sources")
    return found.withColumn("p", rounded(F.col("p")))


@query(f"""WITH {ROWS}, {GROUPS}, h AS (SELECT DISTINCT class, replica, host FROM o)
SELECT class, replica, host, CASE WHEN EXISTS (FROM g WHERE g.level = 'host' AND g.class = h.class AND g.replica = h.replica AND g.host = h.host) THEN 'host'
  WHEN EXISTS (FROM g WHERE g.level = 'replica' AND g.class = h.class AND g.replica = h.replica) THEN 'replica' WHEN EXISTS (FROM g WHERE g.level = 'all' AND g.class = h.class) THEN 'all' END AS level FROM h""")
def profile_group_of_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest level that has a profile for each host and class."""
    rows = host_orders(spark, sf_dir).select("class", "replica", "host")
    groups = class_profiles.supported_groups(rows)
    return class_profiles.coarsest_available(rows.distinct(), groups)


def _horner(x: str, terms: list[float]) -> str:
    out = repr(terms[-1])
    for t in reversed(terms[:-1]):
        out = f"({out} * {x} + {t!r})"
    return f"({out})::DOUBLE"


def _ratio(x: str, terms: tuple[list[float], list[float]]) -> str:
    return f"({_horner(x, terms[0])} / {_horner(x, terms[1])})"


_QUANTILE = f"CASE WHEN abs(q) <= 0.425 THEN q * {_ratio('u', normal.MIDDLE)} ELSE sign(q) * CASE WHEN far <= 5 THEN {_ratio('(far - 1.6)', normal.SHOULDER)} ELSE {_ratio('(far - 5)', normal.TAIL)} END END"
_RANKED = """k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY class, replica, host, feature, x) - 1) / 2 AS rank, count(*) OVER (PARTITION BY class, replica, host, feature) AS n FROM l WINDOW w AS (PARTITION BY class, replica, host, feature ORDER BY x)),
q AS (SELECT *, (rank / (n + 1))::DOUBLE - 0.5::DOUBLE AS q, sqrt(-ln(least(rank / (n + 1), 1 - rank / (n + 1)))) AS far FROM k), z0 AS (SELECT *, """ + _QUANTILE + """ AS z FROM (SELECT *, 0.180625::DOUBLE - q * q AS u FROM q))"""
_LONG = lambda names: f"l AS (SELECT id, class, replica, host, p.f AS feature, p.x AS x FROM (SELECT *, unnest([{PAIRS(names)}]) AS p FROM o) WHERE p.x IS NOT NULL)"


@query(f"""WITH {ROWS}, {_LONG(["price", "excess"])}, {_RANKED}, e AS (SELECT class, replica, host, feature, avg(z) AS m, stddev_pop(z) AS sd FROM z0 GROUP BY ALL HAVING count(*) >= {copula.SUPPORT} AND min(x) < max(x))
SELECT class, replica, host, feature, x, {r('(any_value(z) - any_value(m)) / any_value(sd)')} AS z FROM z0 JOIN e USING (class, replica, host, feature) GROUP BY ALL""")
def normal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal scores of the distinct values of two features within host and class."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in ("price", "excess")])).alias("p")
    long = host_orders(spark, sf_dir).select("class", "replica", "host", pairs).select("class", "replica", "host", "p.*")
    found = copula.normal_scores(long, ["class", "replica", "host", "feature"], "x")
    return found.withColumn("z", rounded(F.col("z")))


_COPULA = ["price", "excess", "urgent", "balance", "rare"]


@query(f"""WITH {ROWS.replace("o AS (", "o0 AS (")}, o AS (SELECT * FROM o0 JOIN (SELECT class, replica, host FROM o0 GROUP BY ALL HAVING count(*) >= {copula.SUPPORT}) USING (class, replica, host)), {_LONG(_COPULA)}, {_RANKED},
e AS (SELECT class, replica, host, feature, avg(z) AS m, stddev_pop(z) AS sd FROM z0 GROUP BY ALL HAVING count(*) >= {copula.SUPPORT} AND min(x) < max(x)), s AS (SELECT id, class, list_position({_COPULA}, feature) - 1 AS f, (z - m) / sd AS z FROM z0 JOIN e USING (class, replica, host, feature)),
p AS (SELECT a.class, a.f AS a, b.f AS b, sum(a.z * b.z) AS s, count(*) AS n FROM s a JOIN s b ON a.id = b.id AND a.class = b.class AND b.f <= a.f GROUP BY ALL),
every AS (SELECT class, a, b FROM (SELECT DISTINCT class FROM o) CROSS JOIN (SELECT unnest(range(5)) AS a) CROSS JOIN (SELECT unnest(range(5)) AS b) WHERE b <= a)
SELECT class::VARCHAR AS class, a::INT AS a, b::INT AS b, coalesce(n, 0)::BIGINT AS n, {r('CASE WHEN a = b THEN 1 WHEN n >= 20 THEN s / n ELSE 0 END')} AS correlation FROM every LEFT JOIN p USING (class, a, b)""")
def copula_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of normal scores within hosts, pooled by class, before any repair of the matrix."""
    found = copula.correlations(host_orders(spark, sf_dir), "id", "class", ["replica", "host"], _COPULA)
    return found.select("class", "a", "b", "n", rounded(F.col("correlation")).alias("correlation"))
