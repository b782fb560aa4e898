"""Empirical-Bayes host reputation and URL rules.

Labelled outcomes of pages are counted by host, registered domain and suffix.
The rate of bad pages is shrunk down this tree: a suffix towards the overall
rate, a domain towards its suffix, a host towards its domain, each by a
beta-binomial prior whose strength is fitted by moments to the spread at its
level and worth no more than the observations it comes from. A host is blocked
if the lower posterior bound of its rate of bad pages is above a threshold. Explicit rules go before the reputation.

Defined results: a url that is null or has no "://" has an empty host and path
and is allowed unless a rule or the reputation of the empty host says otherwise;
repeated rows are judged each by itself; labels that are null are no outcomes.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, without

#: One-sided 95 % point of the normal distribution.
Z = 1.645


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first "://": the host (A-Z in lower case) and the path; empty if there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_that_fits(host: Column, path: Column, rules: list[tuple[str, str]], of: str) -> Column:
    """The longest fitting rule's pattern (``of="rule"``) or verdict (``of="verdict"``); null if none fits."""
    found = F.lit(None).cast("string")
    for verdict, pattern in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        on, _, below = pattern.partition("/")
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit("/" + below))
        found = F.when(fits, F.lit(pattern if of == "rule" else verdict)).otherwise(found)
    return found


#: Public suffixes of two labels. Every other suffix is one label.
DOUBLE_SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk",
    "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.br", "org.nz", "org.uk",
)


def registered_domain(host: Column, double_suffixes: tuple[str, ...] = DOUBLE_SUFFIXES) -> tuple[Column, Column]:
    """A host's registered domain and its suffix (one label, or a listed one of two).

    User info before an "@" and a port are no part of either; an address is a
    domain and a suffix of its own. The list is a parameter of bounded size.
    """
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    two, one = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)
    wide = two.isin(*double_suffixes) if double_suffixes else F.lit(False)
    domain = F.when(address, bare).when(wide, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, F.when(address, bare).when(wide, two).otherwise(one)


def _strength(level: DataFrame, name: str) -> DataFrame:
    """A level's prior strength (pseudo-observations) by moments of the beta-binomial, as one row."""
    total = level.where("n > 0").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")
    )
    p = F.col("bad") / F.col("n")
    within = p * (1 - p)
    spread = F.col("bb") - F.col("bad") * p  # sum of n * (rate - p)^2
    room = F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)
    rho = F.when((within > 0) & (room > 0), (spread - within * (F.col("k") - 1)) / F.nullif(within * room, F.lit(0.0)))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(rho, F.lit(0.001))))
    return total.select(((1 - rho) / rho).alias(name))


def reputation(hosts: DataFrame, double_suffixes: tuple[str, ...] = DOUBLE_SUFFIXES) -> DataFrame:
    """``host, n, bad, rate, bound`` from per-host counts ``host, n, bad``; bound is the lower posterior bound."""
    domain, suffix = registered_domain(F.col("host"), double_suffixes)
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_all"))
    top = top.select("n_all", ((F.col("bad_all") + 0.5) / (F.col("n_all") + 1)).alias("rate_all"))
    for level, name in ((hosts, "m_host"), (domains, "m_domain"), (suffixes, "m_suffix")):
        top = top.crossJoin(F.broadcast(_strength(level, name)))  # one row and one row

    def shrunk(strength: str, above: str, prior: str):
        """The rate of a level and what it rests on; a prior is worth at most one observation more than those behind it."""
        worth = F.least(F.coalesce(strength, F.lit(1.0)), F.col(above) + 1)
        return (F.col("bad") + worth * F.col(prior)) / (F.col("n") + worth), F.col("n") + worth

    suffix_rate = suffixes.crossJoin(F.broadcast(top)).select("suffix", "m_host", "m_domain", F.col("n").alias("n_suffix"), shrunk("m_suffix", "n_all", "rate_all")[0].alias("rate_suffix"))
    domain_rate = domains.join(suffix_rate, "suffix").select("domain", "suffix", "m_host", F.col("n").alias("n_domain"), shrunk("m_domain", "n_suffix", "rate_suffix")[0].alias("rate_domain"))
    joined = hosts.join(domain_rate, ["domain", "suffix"])
    rate, size = shrunk("m_host", "n_domain", "rate_domain")
    return joined.select("host", "n", "bad", rate.alias("rate"), (rate - Z * F.sqrt(rate * (1 - rate) / (size + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], block_above: float = 0.5, double_suffixes: tuple[str, ...] = DOUBLE_SUFFIXES) -> DataFrame:
    """Add ``host, path, rule, verdict, bound`` to pages with ``page_id`` and ``url``.

    ``outcomes`` has ``page_id`` and ``bad`` (0, 1 or null). Counts are gathered
    map-side, so a host with a third of all pages is no burden; the table of
    hosts is then joined back, by broadcast if Spark finds it small and by a
    join that Spark may split otherwise. Defined results: a null url, or one
    without ``://``, has an empty host and path; urls of any length are cut by
    expressions; pages that repeat are judged each, and of outcomes that repeat
    the worse counts; no pages give no rows; columns named like an added one are
    replaced.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select(*(F.col(f"`{c}`") for c in without(pages.columns, ("host", "path", "rule", "verdict", "bound"))))
    judged = pages.withColumns({"host": host, "path": path})
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = judged.select("page_id", "host").join(known, "page_id", "left")
    hosts = counted.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counts = staged(hosts, "host-counts")
    table = staged(reputation(counts, double_suffixes).select("host", "bound"), "host-reputation")
    discard(counts)
    joined = judged.join(table, "host")
    h, p = F.col("host"), F.col("path")
    said = F.when(F.col("bound") > block_above, "block").otherwise("allow")
    return joined.select(*pages.columns, "host", "path", rule_that_fits(h, p, rules, "rule").alias("rule"), F.coalesce(rule_that_fits(h, p, rules, "verdict"), said).alias("verdict"), "bound")
