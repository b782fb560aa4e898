"""Running sums over slices, normal scores, copulas and inherited profiles against plain Python."""

from __future__ import annotations

import math
import os
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.functions import normal
from sievelight.functions.keys import rounded
from sievelight.operators import class_profiles, copula, ranges


@pytest.mark.parametrize("up", [True, False])
def test_running_sums_over_slices_with_a_value_that_fills_many(spark, up):
    rnd = random.Random(2)
    rows = [(g, rnd.choice([0.0, 0.0, 0.0, rnd.random() * 10, -rnd.random()]), i, i % 3) for i, g in enumerate("ab" * 400 + "c")]
    rows += [("a", None, 9000, 1), (None, 5.0, 9001, 7)]
    df = spark.createDataFrame(rows, "g string, v double, id long, w long")
    got = {r.id: (r.k, r.s) for r in ranges.running(df, ["g"], [("v", up), ("id", True)], {"k": F.lit(1), "s": F.col("w")}, slices=13).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        own.sort(key=lambda r: (((r[1] is not None, r[1] or 0) if up else (r[1] is None, -(r[1] or 0))), r[2]))
        for i, r in enumerate(own):
            want[r[2]] = (i + 1, sum(x[3] for x in own[: i + 1]))
    assert got == want


def test_normal_functions(spark):
    p = [1e-300, 1e-9, 0.001, 0.074, 0.0751, 0.3, 0.5, 0.77, 0.925, 0.9999, 1 - 1e-12]
    got = [r.z for r in spark.createDataFrame([(x,) for x in p], "p double").select(normal.quantile(F.col("p")).alias("z")).collect()]
    assert all(abs(z - statistics.NormalDist().inv_cdf(x)) < 1e-9 * max(1, abs(z)) for x, z in zip(p, got, strict=True))
    edge = spark.createDataFrame([(0.0,), (1.0,), (-0.1,), (None,)], "p double").select(normal.quantile(F.col("p")).alias("z")).collect()
    assert [r.z for r in edge] == [-math.inf, math.inf, None, None]
    x = [-9.0, -2.5, -0.1, 0.0, 0.4, 3.0, 8.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in x], "x double").select(normal.distribution(F.col("x")).alias("p")).collect()]
    assert all(abs(a - statistics.NormalDist().cdf(v)) < 2e-7 for v, a in zip(x, got, strict=True))


def brute_scores(x):
    order = sorted(x)
    rank = [(order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in x]
    z = np.array([statistics.NormalDist().inv_cdf(k / (len(x) + 1)) for k in rank])
    return (z - z.mean()) / z.std()


def test_copula_against_plain_matrices(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        a = rnd.gauss(0, 1)
        b = round(a + rnd.gauss(0, 0.3), 1)
        rows.append((i, i % 2 if i % 7 else 0, f"h{i % 3}", a, b if i % 5 else None, -a if i < 200 else 1.0, 3.0, rnd.random() if i % 29 == 0 else None))
    rows += [(1000 + i, 1, "few", 1.0 * i, 2.0, 3.0, 4.0, 5.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, y int, h string, a double, b double, c double, d double, e double")
    columns = list("abcde")
    s, n = {c: np.zeros((5, 5)) for c in "01"}, {c: np.zeros((5, 5)) for c in "01"}
    for c in "01":
        for h in {r[2] for r in rows}:
            own = [r[3:] for r in rows if str(r[1]) == c and r[2] == h]
            if len(own) < 20:
                continue
            z = np.full((len(own), 5), np.nan)
            for j in range(5):
                there = [i for i, r in enumerate(own) if r[j] is not None]
                x = [own[i][j] for i in there]
                if len(x) >= 20 and min(x) < max(x):
                    z[there, j] = brute_scores(x)
            m = ~np.isnan(z)
            s[c] += np.where(m, z, 0).T @ np.where(m, z, 0)
            n[c] += m.T.astype(int) @ m.astype(int)
    found = copula.correlations(df, "id", "y", ["h"], columns).collect()
    assert {(r["class"], r.a, r.b): r.n for r in found} == {(c, a, b): int(n[c][a, b]) for c in "01" for a in range(5) for b in range(a + 1)}
    for r in found:
        want = 1.0 if r.a == r.b else s[r["class"]][r.a, r.b] / n[r["class"]][r.a, r.b] if n[r["class"]][r.a, r.b] >= 20 else 0.0
        assert abs(r.correlation - want) < 1e-9
    matrices = copula.repaired(copula.correlations(df, "id", "y", ["h"], columns), 5)
    for m in matrices.values():
        assert np.allclose(np.diag(m), 1) and np.allclose(m, m.T) and np.linalg.eigvalsh(m).min() > 0.004
    assert min(m[2, 0] for m in matrices.values()) < -0.5
    lower = {(r["class"], r.a, r.b): r.r for r in copula.copula(df, "id", "y", ["h"], columns).collect()}
    assert lower == {(c, a, b): round(float(m[a, b]), 2) + 0.0 for c, m in matrices.items() for a in range(5) for b in range(a + 1)}


def test_inheritance_goes_up_two_levels_and_ends_in_the_default(spark):
    rows = []
    for host, n in (("big", 60), ("small", 25), ("tiny", 5)):
        for i in range(n):
            often = float(i + 1) if host == "big" or i < 3 else 0.0
            seldom = float(i + 1) if host == "big" and i < 25 else None
            rows.append((0, "r", host, f"{host}{i // 10}", often, seldom, 0.0))
    rows += [(0, "lone", "h", "s", float(i + 1), None, 0.0) for i in range(22)]
    df = spark.createDataFrame(rows, "class int, replica string, host string, stretch string, often double, seldom double, never double")
    got = {(r.level, r.replica, r.host, r.feature): r for r in class_profiles.inherited_profiles(df, ["often", "seldom", "never"]).collect()}
    assert ("host", "r", "tiny", "often") not in got and len(got) == 3 * (1 + 2 + 3)
    replica, small = got["replica", "r", None, "often"], got["host", "r", "small", "often"]
    assert small.inherited and math.isclose(small.zero_rate, 22 / 25) and (small.mu, small.sigma, small.tau) == (replica.mu, replica.sigma, replica.tau)
    assert not got["host", "r", "big", "often"].inherited and math.isclose(got["host", "r", "big", "often"].mu, statistics.fmean(math.log(i + 1) for i in range(60)))
    whole = got["host", "r", "small", "seldom"]
    assert whole.inherited and whole.mu == got["replica", "r", None, "seldom"].mu == got["all", None, None, "seldom"].mu
    lone = got["replica", "lone", None, "seldom"]
    assert lone.inherited and lone.mu == whole.mu
    never = got["host", "r", "big", "never"]
    assert (never.zero_rate, never.mu, never.sigma, never.tau, never.inherited) == (1.0, 0.0, 1e-3, 0.0, False)
    groups = class_profiles.supported_groups(df)
    asked = spark.createDataFrame([(0, "r", "big"), (0, "r", "tiny"), (0, "x", "y"), (1, "r", "big")], "class int, replica string, host string")
    assert {(r["class"], r.replica, r.host): r.level for r in class_profiles.coarsest_available(asked, groups).collect()} == {(0, "r", "big"): "host", (0, "r", "tiny"): "replica", (0, "x", "y"): "all", (1, "r", "big"): None}


def test_one_value_a_stretch_takes_the_whole_spread(spark):
    df = spark.createDataFrame([(0, "r", "h", str(i), float(i + 1)) for i in range(30)], "class int, replica string, host string, stretch string, x double")
    r = class_profiles.feature_statistics(df, ["x"]).where("level = 'all'").select(rounded(F.col("sigma")).alias("s"), "tau").first()
    assert abs(r.s - statistics.pstdev(math.log(i + 1) for i in range(30))) < 1e-6 and r.tau == 0


def test_copula_reads_written_sums_only(spark):
    """The result reads its few sums: what several steps share is computed once, and its tables are gone."""
    from sievelight.tables import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = spark.createDataFrame([(i, i % 2, f"h{i % 3}", float(i % 17), float(i % 5)) for i in range(200)], "id long, y int, h string, a double, b double")
    found = copula.correlations(df, "id", "y", ["h"], ["a", "b"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and found.count() == 6
    assert len(set(os.listdir(folder)) - before) == 1  # the sums
