"""Profiles of feature tables by host, replica and over all, with inheritance from the coarser group.

A row belongs to a host of a replica, to a stretch of its timeline, and to a
class. Every statistic is summed once per stretch; the three levels are one pass
of grouping sets over those sums. What has too little support of its own is then
taken from the next coarser level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a statistic needs; least spread; values of a stretch and stretches that the spread between stretches needs.
SUPPORT, LEAST_SPREAD, STRETCH_VALUES, STRETCHES = 20, 1e-3, 5, 3
LEVELS = ("all", "replica", "host")
#: What a feature without positive values has.
NONE = {"zero_rate": 1.0, "mu": 0.0, "sigma": LEAST_SPREAD, "tau": 0.0}


def _by_level(sums: DataFrame, own: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates over all, by replica and by host; ``level`` says which (a replica may be null itself)."""
    sets = [["class", *own], ["class", "replica", *own], ["class", "replica", "host", *own]]
    grouped = sums.groupingSets(sets, "class", "replica", "host", *own)
    gaps = F.grouping("replica") + F.grouping("host")
    level = F.when(gaps == 2, "all").when(gaps == 1, "replica").otherwise("host")
    return grouped.agg(level.alias("level"), *aggregates)


def feature_statistics(rows: DataFrame, features: list[str]) -> DataFrame:
    """``level, class, replica, host, feature`` with ``n_present, n_positive, mu, sigma, tau`` of its own rows.

    ``rows`` have ``class, replica, host, stretch`` and the features; a null value
    is absent. Moments are of logs of positive values: their mean, the pooled
    spread within stretches (of all if every stretch has one value only), and the
    spread between stretch means beyond what chance explains.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("p")
    long = rows.select("class", "replica", "host", "stretch", pairs).select("class", "replica", "host", "stretch", "p.*").where("x IS NOT NULL")
    lx = F.when(F.col("x") > 0, F.log("x"))
    stretches = long.groupBy("class", "replica", "host", "stretch", "feature").agg(
        F.count("*").alias("present"), F.count(lx).alias("k"), F.sum(lx).alias("s"), F.avg(lx).alias("m"), (F.var_pop(lx) * F.count(lx)).alias("ss")
    )
    wide = (F.col("k") >= STRETCH_VALUES) & (F.col("k") > 1)
    k, free = F.sum("k"), F.sum(F.when(F.col("k") > 0, F.col("k") - 1))
    mean = F.sum("s") / k
    total = (F.sum("ss") + F.sum(F.col("k") * F.col("m") * F.col("m")) - k * mean * mean) / k
    within = F.when(free > 0, F.sum("ss") / free).otherwise(F.greatest(total, F.lit(0.0)))
    between = F.var_samp(F.when(wide, F.col("m"))) - F.avg(F.when(wide, F.col("ss") / (F.col("k") - 1) / F.col("k")))
    return _by_level(stretches, ["feature"], [
        F.sum("present").alias("n_present"), k.alias("n_positive"), mean.alias("mu"), F.greatest(F.sqrt(within), F.lit(LEAST_SPREAD)).alias("sigma"),
        F.when(F.count_if(wide) >= STRETCHES, F.sqrt(F.greatest(between, F.lit(0.0)))).otherwise(0.0).alias("tau"),
    ])


def _groups(rows: DataFrame, support: int, **also: Column) -> DataFrame:
    """``level, class, replica, host, n`` of the groups with enough rows, and the sums of other columns."""
    sums = {"n": F.lit(1)} | also
    counts = rows.groupBy("class", "replica", "host").agg(*(F.sum(x).alias(c) for c, x in sums.items()))
    return _by_level(counts, [], [F.sum(c).alias(c) for c in sums]).where(F.col("n") >= support)


def _filled(own: DataFrame, parent: DataFrame | None, on: list[str], values: list[str], resolve) -> DataFrame:
    """Each own row with its values after ``resolve(own, parent)``; ``parent`` holds one row per ``on``."""
    if parent is None:
        joined = own.withColumn("_has", F.lit(False)).withColumns({f"_p_{v}": F.lit(None).cast("double") for v in values})
    else:
        theirs = parent.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(F.col(v).alias(f"_p_{v}") for v in values), F.lit(True).alias("_has"))
        joined = own.join(theirs, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on], "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    return joined.withColumns(resolve)


def _resolved(own: DataFrame, on: dict[str, list[str]], values: list[str], resolve) -> DataFrame:
    out, parent = None, None
    columns = [*own.columns, "inherited"]
    for level in LEVELS:
        here = _filled(own.where(F.col("level") == level), parent, on[level], values, resolve).select(*columns)
        out, parent = here if out is None else out.unionByName(here), here
    return out


def inherited_profiles(rows: DataFrame, features: list[str], support: int = SUPPORT) -> DataFrame:
    """``level, class, replica, host, feature, zero_rate, mu, sigma, tau, inherited`` of all groups with ``support`` rows.

    A feature present in fewer rows is the coarser group's as a whole; one with
    fewer positive values keeps its own share of zeros and takes the coarser
    group's moments. Where there is no coarser group, or it has no positive value
    either, the feature counts as always zero.
    """
    groups = _groups(rows, support).select("level", "class", "replica", "host")
    every = groups.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(f,) for f in features], "feature string")))
    found = feature_statistics(rows, features)
    keys = ["level", "class", "replica", "host", "feature"]
    theirs = found.select(*(F.col(c).alias(f"_of_{c}") for c in keys), "n_present", "n_positive", "mu", "sigma", "tau")
    own = every.join(theirs, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], "left").drop(*(f"_of_{c}" for c in keys))
    own = own.withColumns({"n_present": F.coalesce("n_present", F.lit(0)), "n_positive": F.coalesce("n_positive", F.lit(0)), "zero_rate": 1 - F.try_divide("n_positive", "n_present")})
    absent, none, few = F.col("n_present") < support, F.col("n_positive") == 0, F.col("n_positive") < support
    no_help = ~F.col("_has") | (F.col("_p_zero_rate") >= 1)

    def value(v: str) -> Column:
        default = F.lit(NONE[v])
        whole = F.when(absent, F.when(F.col("_has"), F.col(f"_p_{v}")).otherwise(default)).when(none, default)
        if v == "zero_rate":
            return whole.when(few & no_help, default).otherwise(F.col(v))
        return whole.when(few, F.when(no_help, default).otherwise(F.col(f"_p_{v}"))).otherwise(F.col(v))

    inherited = F.when(absent, F.col("_has")).when(none, False).when(few, ~no_help).otherwise(False)
    on = {"all": [], "replica": ["class", "feature"], "host": ["class", "replica", "feature"]}
    out = _resolved(own, on, list(NONE), {"inherited": inherited} | {v: value(v) for v in NONE})
    return out.select(*keys, *NONE, "inherited")


def inherited_repeats(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``level, class, replica, host, n, repeat_rate, inherited``: how often a row equals the one before it in its stretch.

    Rows have ``first`` (begins a stretch) and ``repeats``. A group with fewer than ``support`` later rows takes the coarser group's rate.
    """
    later = ~F.col("first")
    own = _groups(rows, support, later=later.cast("int"), equal=(later & F.col("repeats")).cast("int")).withColumn("repeat_rate", F.try_divide("equal", "later"))
    few = F.col("later") < support
    rate = F.when(few, F.coalesce("_p_repeat_rate", F.lit(0.0))).otherwise(F.col("repeat_rate"))
    on = {"all": [], "replica": ["class"], "host": ["class", "replica"]}
    out = _resolved(own, on, ["repeat_rate"], {"inherited": few & F.col("_has"), "repeat_rate": rate})
    return out.select("level", "class", "replica", "host", "n", "repeat_rate", "inherited")


def availability_patterns(rows: DataFrame, flags: list[str], sources: str, support: int = SUPPORT) -> DataFrame:
    """``level, class, replica, host, code, p``: shares of the patterns of available inputs (a bit each) with the number of sources (from bit ``len(flags)`` on)."""
    code = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(flags)), F.rint(sources).cast("int") * (1 << len(flags)))
    counts = rows.groupBy("class", "replica", "host", code.alias("code")).agg(F.count("*").alias("c"))
    by_code = _by_level(counts, ["code"], [F.sum("c").alias("c")])
    groups = _groups(rows, support)
    keys = ["level", "class", "replica", "host"]
    theirs = groups.select(*(F.col(c).alias(f"_of_{c}") for c in keys), "n")
    return by_code.join(theirs, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]).select(*keys, "code", (F.col("c") / F.col("n")).alias("p"))


def supported_groups(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``level, class, replica, host, n`` of the groups that have a profile."""
    return _groups(rows, support)


def coarsest_available(hosts: DataFrame, groups: DataFrame) -> DataFrame:
    """For each ``class, replica, host`` asked for, the ``level`` of the finest group there is: its own, its replica's or that of all."""
    found = hosts
    for level, on in (("host", ["class", "replica", "host"]), ("replica", ["class", "replica"]), ("all", ["class"])):
        theirs = groups.where(F.col("level") == level).select(*(F.col(c).alias(f"_{level}_{c}") for c in on), F.lit(level).alias(f"_has_{level}")).distinct()
        found = found.join(theirs, [F.col(c).eqNullSafe(F.col(f"_{level}_{c}")) for c in on], "left")
    return found.select(*hosts.columns, F.coalesce("_has_host", "_has_replica", "_has_all").alias("level"))
