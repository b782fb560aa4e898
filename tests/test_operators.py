from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.operators import curves, leakage, ledger, neighbours, profiles, splits, statistics, windows
from tests.conftest import brute_entropy


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_entropy_and_dominant(spark):
    rows = frame(spark, [("h", v) for v in "aaab"] + [("g", "x")], "host string, v string")
    assert {r.host: r.entropy for r in windows.entropy(rows, ["host"], "v").collect()} == {"h": pytest.approx(brute_entropy([3, 1]), abs=1e-6), "g": 0.0}
    assert {r.host: (r.dominant, r.share) for r in windows.dominant(rows, ["host"], "v").collect()} == {"h": ("a", 0.75), "g": ("x", 1.0)}


def test_peer_history_against_sets(spark):
    rnd = random.Random(1)
    met = [(f"h{rnd.randint(0, 3)}", 60 * rnd.randint(0, 12), f"p{rnd.randint(0, 6)}") for _ in range(150)]
    got = {(r.host, r.window_start): (r.n_peers, r.n_new, r.n_ever, r.reappearance) for r in windows.peer_history(frame(spark, met, "host string, window_start long, peer string")).collect()}
    want = {}
    for host in {m[0] for m in met}:
        ever, last = set(), set()
        for w in sorted({m[1] for m in met if m[0] == host}):
            now = {m[2] for m in met if m[:2] == (host, w)}
            want[host, w] = (len(now), len(now - ever), len(now | ever), round(len(now & last) / max(len(last), 1), 6))
            ever, last = ever | now, now
    assert got == want


def test_stretches(spark):
    rows = [("h", 60 * i, y) for i, y in enumerate([0, 0, 0, 0, 0, 1, 1, 0])] + [("h", 6000, 0)]
    got = [r.stretch for r in windows.stretches(frame(spark, rows, "host string, t long, y int"), ["host"], "t", "y", 60, 4).orderBy("t").collect()]
    assert got == [1, 1, 1, 1, 2, 3, 3, 4, 5]


def test_outer_join(spark):
    a = frame(spark, [(1, 2.0)], "k long, a double")
    b = frame(spark, [(1, 3.0), (2, 4.0)], "k long, b double")
    got = {r.k: (r.a, r.b, r.has_a, r.has_b) for r in windows.outer_joined({"a": a, "b": b}, ["k"]).collect()}
    assert got == {1: (2.0, 3.0, 1, 1), 2: (0.0, 4.0, 0, 1)}


SHAPES = {
    "ties": ([0.5] * 10 + [0.7] * 5, [0, 1] * 5 + [1, 1, 0, 0, 1]),
    "equal": ([0.5] * 8, [0, 1] * 4),
    "perfect": ([0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1]),
    "inverted": ([0.9, 0.8, 0.2, 0.1], [0, 0, 1, 1]),
    "single": ([i / 100 for i in range(100)], [0] * 60 + [1] + [0] * 39),
    "pair": ([0.3, 0.6], [1, 0]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_curve_metrics(spark, name):
    score, y = map(np.array, SHAPES[name])
    points = curves.curve(frame(spark, [(0, float(s), int(v)) for s, v in zip(score, y, strict=True)], "fold int, score double, y int"), ["fold"])
    ap = auc = before = 0.0
    for t in sorted(set(score), reverse=True):
        tp, n = int(y[score >= t].sum()), int((score >= t).sum())
        ap += (tp / y.sum() - before) * tp / n
        before = tp / y.sum()
    for p in score[y == 1]:
        auc += ((p > score[y == 0]) + 0.5 * (p == score[y == 0])).sum() / (y == 1).sum() / (y == 0).sum()
    assert curves.average_precision(points, ["fold"]).first().ap == pytest.approx(ap, abs=1e-6)
    assert curves.roc_auc(points, ["fold"]).first().auc == pytest.approx(auc, abs=1e-6)
    best = max([0.0] + [y[score >= t].sum() / y.sum() for t in set(score) if (y[score >= t] == 0).sum() / (y == 0).sum() <= 0.01])
    assert curves.tpr_at_fpr(points, ["fold"], 0.01).first().tpr <= best + 1e-6


def test_confusion_and_calibration(spark):
    rows = frame(spark, [(0, 0.9, 1), (0, 0.8, 0), (0, 0.1, 0), (0, 0.2, 1)], "fold int, score double, y int")
    r = curves.confusion(rows, ["fold"], 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.mcc) == (1, 1, 1, 1, 0.5, 0.0)
    assert {r.y: r.ece for r in curves.calibration_error(rows, ["fold"]).collect()} == {0: 0.45, 1: 0.45}
    assert curves.confusion(rows.where("score < 0.5"), ["fold"], 0.5).first().precision is None


def test_splits(spark):
    rows = frame(spark, [(i, float(i * 100), i % 40, int(i % 7 == 0)) for i in range(400)], "row_id long, t double, g int, y int").cache()
    parts = splits.chronological(rows, "t", 1000.0)
    times = {r.part: (r.lo, r.hi) for r in parts.join(rows, "row_id").groupBy("part").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert times["val"][0] > times["train"][1] + 1000 and times["test"][0] > times["val"][1] + 1000
    with pytest.raises(splits.SplitError, match="collapsed"):
        splits.checked(splits.without_shared_groups(parts, rows, "g"), rows, "y")
    grouped = splits.by_groups(rows, "g", 1)
    splits.assert_disjoint(grouped, rows, "g")
    with pytest.raises(splits.SplitError):
        splits.assert_disjoint(parts, rows, "g")
    random_parts = {r.part: r.n for r in splits.random_stratified(rows, "y", 3).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert random_parts == {"train": 240, "val": 80, "test": 80}
    folds = splits.leave_one_out(rows.withColumn("g", F.col("g") % 4), "g", 1)
    assert folds.groupBy("fold").count().select("count").distinct().collect()[0][0] == 400


def test_duplicates_and_simhash(spark):
    rows = frame(spark, [(1.0, "a"), (1.0000000001, "a"), (2.0, "a"), (-0.0, "b"), (0.0, "b")], "x double, k string")
    r = leakage.exact_duplicates(rows, ["x", "k"]).first()
    assert (r.n, r.n_unique, r.excess, r.members) == (5, 3, 2, 4)
    v = np.random.default_rng(0).normal(size=(50, 8))
    got = {r.id: r.signature for r in leakage.simhash(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>"), "v", 16, 3).collect()}
    bits = ((v - v.mean(0)) / v.std(0)) @ np.random.default_rng(3).standard_normal((8, 16)) > 0
    assert got == {i: int(sum(1 << k for k in range(16) if b[k])) for i, b in enumerate(bits)}
    assert leakage.identical_columns(frame(spark, [(1, 1, 5), (2, 2, 5)], "a int, b int, c int"), ["a", "b", "c"]) == [("a", "b")]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 11, 16])
def test_ledger(spark, n):
    hashes = [hashlib.sha256(b"\x00" + f"e{i}".encode()).hexdigest() for i in range(n)]

    def tree(h):
        if len(h) == 1:
            return h[0]
        k = 1 << ((len(h) - 1).bit_length() - 1)
        return hashlib.sha256(b"\x01" + bytes.fromhex(tree(h[:k])) + bytes.fromhex(tree(h[k:]))).hexdigest()

    leaves = frame(spark, [(i, f"e{i}") for i in range(n)], "idx long, entry string").select("idx", ledger.leaf_hash(F.col("entry")).alias("hash"))
    nodes = ledger.levels(leaves, n)
    root = nodes.orderBy(F.desc("level")).first().hash
    assert root == tree(hashes) == ledger.root_of(hashes)
    paths = {i: [] for i in range(n)}
    for r in sorted(ledger.inclusion_paths(nodes, leaves).collect(), key=lambda r: r.level):
        paths[r.idx].append(r.hash)
    assert all(ledger.verify_inclusion(hashes[i], i, n, paths[i], root) for i in range(n))
    assert not ledger.verify_inclusion(hashes[0][::-1], 0, n, paths[0], root) and not ledger.verify_inclusion("zz", 0, n, [], root)


def test_verdict_json(spark):
    entry = ledger.canonical_verdict(*[F.lit(x) for x in ('w"1', "h", 60, 1, "0.500000", "abc")])
    assert spark.range(1).select(entry.alias("e")).first().e == '{"host_hash":"h","model_git_sha":"abc","score":"0.500000","ts_bucket":60,"verdict":1,"window_id":"w\\"1"}'


def test_statistics(spark):
    p = frame(spark, [(0, "a", 0.01), (0, "b", 0.04), (0, "c", 0.03), (0, "d", None)], "f int, m string, p double")
    got = {r.m: (r.adjusted, r.rejected) for r in statistics.holm(p, ["f"], "m", "p").collect()}
    assert got == {"a": (0.03, True), "c": (0.06, False), "b": (0.06, False), "d": (None, False)}
    s = frame(spark, [(f, m, x) for f in range(3) for m, x in (("a", 0.9), ("b", 0.5), ("c", 0.5))], "f int, m string, s double")
    assert {r.method: r.mean_rank for r in statistics.mean_ranks(s.withColumnRenamed("m", "method"), "f", "method", "s").collect()} == {"a": 1.0, "b": 2.5, "c": 2.5}
    assert statistics.nemenyi_distance(3, 10) == pytest.approx(2.343 * (12 / 60) ** 0.5)
    d = frame(spark, [(0, 1.0, True), (0, 2.0, True), (0, 0.0, False), (0, 2.0, False)], "f int, v double, a boolean")
    assert statistics.cliffs_delta(d, ["f"], "v", F.col("a")).first().delta == 0.25


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, size=(80, 3)).astype(float)
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in neighbours.nearest(rows.where("id < 10"), rows.where("id >= 10"), 4, blocks=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.train_id)
    for i in range(10):
        d = ((x[10:] - x[i]) ** 2).sum(1)
        assert got[i] == (np.argsort(d, kind="stable")[:4] + 10).tolist()


def test_profiles(spark):
    rows = frame(spark, [(float(i),) for i in (5, 5, 3, 1)], "x double")
    assert [profiles.kth_largest(rows, ["x"], k).first().kth for k in (1, 2, 3, 9)] == [5.0, 5.0, 3.0, 1.0]
    costs = profiles.segment_costs(spark.range(8, 65537).select(F.col("id").alias("segment")), 200_000, 2.84e-7, 6.86e-5, 1.48e-4)
    assert profiles.cheapest(costs).first().segment in range(150, 200)
    scaled = profiles.robust_scaled(frame(spark, [(1.0, True), (2.0, True), (3.0, True), (100.0, False)], "x double, t boolean"), ["x"], F.col("t"))
    assert sorted(r.x for r in scaled.collect()) == [-1.0, 0.0, 1.0, 98.0]


def test_consistency(spark):
    from sievelight.operators import proofs

    n = 23
    leaves = frame(spark, [(i, f"e{i}") for i in range(n)], "idx long, entry string").select("idx", ledger.leaf_hash(F.col("entry")).alias("hash")).cache()
    hashes = [r.hash for r in leaves.orderBy("idx").collect()]
    nodes = ledger.levels(leaves, n).cache()
    root = ledger.root_of(hashes)
    for old in (1, 4, 7, 16, 22, 23):
        proof = proofs.consistency_proof(nodes, old, n)
        assert proofs.verify_consistency(old, n, ledger.root_of(hashes[:old]), root, proof)
        assert not proofs.verify_consistency(old, n, ledger.root_of(hashes[: old - 1] + ["00" * 32]), root, proof)
    signer = proofs.Signer(spark)
    head = proofs.tree_head("log", n, root, 1)
    assert signer.verify(head, signer.sign(head)) and not signer.verify(head + b"x", signer.sign(head)) and not signer.verify(head, "zz")
    cut = ledger.segments(leaves, 8)
    assert {r.segment: r.root for r in proofs.segment_roots(cut).collect()}[0] == ledger.root_of(hashes[:8])


def test_certificate(spark):
    from sievelight.operators import certificate

    rows = frame(spark, [(i, float(i % 50), float(i % 3), f"g{i % 7}", i % 2, i % 5 == 0) for i in range(300)], "row_id long, a double, b double, g string, m int, y0 boolean").withColumn("y", F.col("y0").cast("int"))
    parts = splits.random_stratified(rows, "y", 1)
    got = certificate.certificate(rows, parts, ["a", "b"], "g", ["m"], "y", bits=8)
    by = {r.measure: (r.value, r.severity) for r in got.collect()}
    assert by["fraction"][1] in ("warn", "fail") and by["groups on several sides"] == (21.0, "fail") and len(by) == 6
    assert certificate.verdict(got).first().worst == "fail"
    assert certificate.halt_gate(0.86, 0.79) == "pass" and certificate.halt_gate(0.80, 0.799) == "report-only"
    with pytest.raises(certificate.HaltGate):
        certificate.halt_gate(0.86, 0.855)


def test_templates(spark):
    from sievelight.operators import templates

    messages = ["CRON[22]: session opened for user root", "CRON[99]: session opened for user root", "kernel: oops at 0xdeadbeef now", "CRON[1]: session opened for user bob", "dnsmasq: reply 10.0.0.1 is ok"]
    lines = frame(spark, [("h", 0 if i < 3 else 60, i, m) for i, m in enumerate(messages)], "host string, window_start long, seq long, message string")
    found = templates.mine(lines)
    by = {r.template_id: r.template for r in found.collect()}
    assert len(by) == 3 and by[1] == "CRON[<n>]: session opened for user <*>"
    got = {r.window_start: (r.n_events, r.n_templates, r.dominant_id, r.n_new) for r in templates.window_features(lines, found, ["host", "window_start"]).collect()}
    assert got == {0: (3, 2, 1, 2), 60: (2, 2, 1, 1)}


def test_event_gaps_all(spark, tmp_path):
    """Events beyond a host's first 128 have their gaps too; numbers begin anew in each window."""
    import datetime

    from sievelight.plans import telemetry

    t = datetime.datetime(2024, 1, 1)
    frame(spark, [(i, 1, "view", 1.0, "{}", t + datetime.timedelta(minutes=2 * i)) for i in range(300)], "event_id long, user_id long, event_type string, value double, props string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.k, r.dt) for r in telemetry.event_gaps_all(spark, str(tmp_path)).collect()}
    assert got == {i: (i % 180 + 1, 120.0 if i else 0.0) for i in range(300)}


def test_whole_inclusion_paths(spark, tmp_path):
    """Every entry's path leads to the root, though the tree has an odd size and more than the top levels."""
    import datetime

    from sievelight.operators import ledger
    from sievelight.plans import records

    n, t = 5003, datetime.datetime(2024, 1, 1)
    frame(spark, [(i, i % 7, "error" if i % 5 == 0 else "view", float(i), "{}", t) for i in range(n)], "event_id long, user_id long, event_type string, value double, props string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    leaf = {r.idx: r.hash for r in records.leaves(spark, str(tmp_path)).collect()}
    root, paths = ledger.root_of([leaf[i] for i in range(n)]), {i: [] for i in range(n)}
    for r in sorted(records.ledger_whole_inclusion_paths(spark, str(tmp_path)).collect(), key=lambda r: r.level):
        paths[r.idx].append(r.hash)
    assert all(ledger.verify_inclusion(leaf[i], i, n, paths[i], root) for i in range(n))


def test_log_templates_reads_all_lines(spark, tmp_path):
    from sievelight.plans import streams

    texts = [(2, "start job 7\nuser bob logged in at noon\n"), (1, "start job 8\nstart job 9\nuser ann logged in at noon"), (3, None)]
    frame(spark, texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.template_id: (r.n_messages, r.n_chars) for r in streams.log_templates(spark, str(tmp_path)).collect()}
    assert got == {1: (3, len("start job <n>")), 2: (2, len("user <*> logged in at noon")), 3: (1, 0)}


def test_runs(spark, tmp_path):
    from sievelight.operators import runs

    for seed, ap in ((0, 0.5), (1, 0.7)):
        runs.write_run(spark, f"{tmp_path}/runs", {"model": "m", "dataset": "d", "split": "r0", "seed": seed}, {"ppv": {"0.0001": ap}})
    index = runs.load_index(spark, f"{tmp_path}/runs")
    row = runs.cells(index, ("ppv", "0.0001"), ["r0"]).first()
    assert row.r0_mean == pytest.approx(0.6) and "0.6000" in runs.markdown(runs.cells(index, ("ppv", "0.0001"), ["r0"]))
    runs.write_run(spark, f"{tmp_path}/runs", {"model": "m", "dataset": "e", "split": "r0"}, {})
    with pytest.raises(runs.PooledDatasets):
        runs.cells(runs.load_index(spark, f"{tmp_path}/runs"), ("x",), ["r0"])


def test_generator(spark):
    from sievelight.operators import generators

    rows = generators.host_windows(spark, 3, 3, 400, 0.1).cache()
    assert rows.count() == 3600 and 0.03 < rows.agg(F.avg("y")).first()[0] < 0.15
    assert generators.contract_violations(rows).first().asDict() == {"label_not_binary": 0, "positive_unlabellable": 0, "no_window": 0}
    assert rows.repartition(5).agg(F.sum("x3")).first()[0] == pytest.approx(rows.agg(F.sum("x3")).first()[0])


def test_wilcoxon_by_enumeration():
    from itertools import product

    rnd = random.Random(3)
    for _ in range(20):
        a = [rnd.randint(0, 9) for _ in range(rnd.randint(6, 9))]
        b = [rnd.randint(0, 9) for _ in a]
        d = [x - y for x, y in zip(a, b, strict=True) if x != y]
        if not d:
            continue
        ranks = [sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2 for x in d]
        w = min(sum(r for r, x in zip(ranks, d, strict=True) if x > 0), sum(r for r, x in zip(ranks, d, strict=True) if x < 0))
        below = sum(sum(r for r, s in zip(ranks, signs, strict=True) if s) <= w for signs in product([0, 1], repeat=len(d)))
        assert statistics.wilcoxon(a, b) == pytest.approx(min(1.0, 2 * below / 2 ** len(d)))
    assert statistics.wilcoxon([1.0] * 5, [2.0] * 5) is None and statistics.wilcoxon([1.0] * 6, [1.0] * 6) == 1.0


def test_searches(spark):
    from sievelight.operators import searches

    costs = profiles.segment_costs(spark.range(8, 2048).select(F.col("id").alias("segment")), 200_000, 2.84e-7, 6.86e-5, 1.48e-4)
    best = profiles.cheapest(costs).first().total_s
    assert 0 <= searches.gap(searches.sampled(costs, 200, 1).first().total_s, best) < 20
    table = {r.segment: r.total_s for r in costs.collect()}
    found = searches.herded(lambda s: np.array([table[int(x)] for x in s]), 8, 2047)
    assert found["reach"][0] - 1 <= found["segment"] <= found["reach"][1] + 1 and found["total_s"] >= best
