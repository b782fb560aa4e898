"""Byte ranges, caches, sinks, progress, proofs, training sets and fused scores."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.functions import texts
from sievelight.operators import coverage, detectors, forward, ledger, proofs, protocol, signatures
from sievelight.plans import features
from sievelight.sources import cache, lines, sinks
from sievelight.streaming import progress


def test_lines_of_large_files_are_read_by_ranges(spark, tmp_path):
    rnd = random.Random(1)
    wanted = {}
    for name in ("big.log", "big.log.1", "one.log"):
        rows = [bytes(rnd.choice(b"abc \xff\xc3\r") for _ in range(rnd.randrange(60))) for _ in range(3000 if "big" in name else 1)]
        wanted[name] = rows
        (tmp_path / name).write_bytes(b"\n".join(rows) + (b"\n" if name != "big.log.1" else b""))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = lines.read_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() >= 1
        found = {}
        for r in read.collect():
            found.setdefault(os.path.basename(r.path), []).append((r.local_line, bytes(r.raw), r.text))
        ranges = spark.read.option("lineSep", "\n").text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ranges > 8
    for name, rows in wanted.items():
        got = sorted(found[name])
        if rows and not rows[-1] and name == "big.log.1":
            rows = rows[:-1]
        assert [g[0] for g in got] == list(range(1, len(rows) + 1)) and [g[1] for g in got] == rows
        assert all("�" in g[2] for g in got if b"\xff" in g[1])


def test_only_stale_replicas_are_built_again(spark, tmp_path):
    folder, source = str(tmp_path / "cache"), tmp_path / "source"
    source.mkdir()
    for r in "ab":
        (source / f"{r}.txt").write_text(r)
    built = []

    def build(replicas):
        built.append(list(replicas))
        return spark.createDataFrame([(r, i, len((source / f"{r[0]}.txt").read_text())) for r in replicas for i in range(3)], "replica string, i int, n int")

    def versions(settings):
        code = cache.fingerprint_of_code(build)
        return {r: cache.version_of(code, cache.fingerprint_of_files(spark, str(source / f"{r[0]}.txt")), settings) for r in ("a", "b=1/x")}

    first, stale = cache.build_or_load(spark, folder, versions({}), build)
    assert stale == ["a", "b=1/x"] and sorted(map(tuple, first.select("replica", "i", "n").collect())) == [(r, i, 1) for r in ("a", "b=1/x") for i in range(3)]
    again, stale = cache.build_or_load(spark, folder, versions({}), build)
    assert stale == [] and again.count() == 6 and len(built) == 1
    (source / "b.txt").write_text("longer")
    changed, stale = cache.build_or_load(spark, folder, versions({}), build)
    assert stale == ["b=1/x"] and built[-1] == ["b=1/x"]
    assert sorted(map(tuple, changed.select("replica", "n").distinct().collect())) == [("a", 1), ("b=1/x", 6)]
    assert cache.build_or_load(spark, folder, versions({"window": 30}), build)[1] == ["a", "b=1/x"]


def test_disk_guard(spark, tmp_path):
    free = cache.free_bytes(spark, str(tmp_path))
    cache.require_free(spark, str(tmp_path), 1)
    with pytest.raises(cache.NotEnoughSpace):
        cache.require_free(spark, str(tmp_path), free * 4 + (1 << 50))


def test_guarded_json_shows_all_or_nothing(spark, tmp_path):
    spark.dataSource.register(sinks.GuardedJson)
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(i, i / 3, [1.0, 2.5], {"k": 1e-9}, None if i else "é") for i in range(20)], "i int, x double, a array<double>, m map<string,double>, s string").repartition(3)
    df.write.format("guarded_json").option("path", out).mode("append").save()
    files = [f for f in os.listdir(out) if f.startswith("part-")]
    rows = sorted((json.loads(x) for f in files for x in open(f"{out}/{f}", encoding="utf-8")), key=lambda r: r["i"])
    assert len(rows) == 20 and rows[1]["x"] == 0.333333 and rows[3]["x"] == 1 and rows[0]["s"] == "é" and rows[1]["s"] is None and os.path.exists(f"{out}/_SUCCESS")
    assert not [f for f in os.listdir(out) if f.startswith("_part")]
    bad = str(tmp_path / "bad")
    long = spark.range(40).repartition(4).select("id", F.when(F.col("id") == 17, F.sequence(F.lit(0), F.lit(300))).otherwise(F.array(F.lit(1))).alias("a"))
    with pytest.raises(Exception, match="more than 200"):
        long.write.format("guarded_json").option("path", bad).mode("append").save()
    assert [f for f in os.listdir(bad) if "part-" in f] == []
    with pytest.raises(sinks.ExportError):
        sinks.exported({"a": [float("nan")]})


def test_a_task_that_outlives_its_job_leaves_no_file(tmp_path):
    """An abort that knows of no finished task deletes what tasks wrote, and what they would write later."""
    import pyarrow as pa

    rows = [pa.RecordBatch.from_pylist([{"i": 1}])]
    kept, dropped = sinks._Writer({"path": str(tmp_path)}), sinks._Writer({"path": str(tmp_path)})
    part = kept.write(iter(rows))
    dropped.write(iter(rows))
    dropped.abort([None, None])
    with pytest.raises(FileNotFoundError):
        dropped.write(iter(rows))
    kept.commit([part, None])
    assert sorted(os.listdir(tmp_path)) == sorted(["_SUCCESS", os.path.basename(part.name)])


def test_scored_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 1234567.0, 0.123456789, "benign"), (2, None, 1e-7, None, "not scored"), (3, -2.0, 0.0, 1.0, 'say "x", y')], "row_id int, a double, b double, score double, verdict string")
    sinks.write_csv(sinks.scored_csv(rows, ["a", "b"]).coalesce(1), str(tmp_path / "csv"))
    (file,) = [f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")]
    assert (tmp_path / "csv" / file).read_text().splitlines() == ["row_id,a,b,score,verdict", "1,0.5,1234570,0.123457,benign", "2,,0.0000001,,not scored", '3,-2,0,1,"say ""x"", y"']
    assert sinks.template_of(["a", "b"], rows).columns == ["a", "b", "label"]


def test_progress_never_falls_and_a_run_is_cancelled_by_its_tag(spark):
    seen = progress.Progress({"read": 1, "score": 3})
    run = progress.Run(spark, "run-1", seen)
    with run.stage("read"):
        assert spark.range(10).count() == 10
    seen.report("read", 0.2)
    shares = [e["overall"] for e in seen.events]
    assert shares == sorted(shares) and shares[-1] == 0.25 and [e["number"] for e in seen.events] == list(range(len(shares)))

    def late():
        time.sleep(4)
        run.cancel()

    other, last = threading.Thread(target=late), threading.Timer(25, spark.sparkContext.cancelAllJobs)
    other.start()
    last.start()
    began = time.time()
    with pytest.raises(progress.Cancelled), run.stage("score"):
        spark.range(0, 10**13, 1, 4).agg(F.sum(F.sqrt("id"))).collect()  # takes hours
    other.join()
    last.cancel()
    assert time.time() - began < 20 and "run-1" not in spark.sparkContext.getJobTags()
    with pytest.raises(progress.Cancelled), run.stage("score"):
        pass
    assert spark.range(5).count() == 5  # other work goes on


def test_stream_progress(spark, tmp_path):
    for i in range(3):
        spark.range(10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = progress.Progress({"stream": 1})
    listener = progress.StreamProgress(seen, "stream", 30, "counted")
    spark.streams.addListener(listener)
    try:
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.format("memory").queryName("counted").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if seen.events and seen.events[-1]["note"] == "ended":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    shares = [e["overall"] for e in seen.events]
    assert shares == sorted(shares) and shares[-1] == 1.0 and seen.events[0]["note"] == "started" and len(shares) >= 5


def tree(hashes):
    if len(hashes) == 1:
        return hashes[0]
    k = 1 << (len(hashes) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + bytes.fromhex(tree(hashes[:k])) + bytes.fromhex(tree(hashes[k:]))).hexdigest()


def brute_proof(m, d, whole=True):
    if m == len(d):
        return [] if whole else [tree(d)]
    k = 1 << (len(d) - 1).bit_length() - 1
    return brute_proof(m, d[:k], whole) + [tree(d[k:])] if m <= k else brute_proof(m - k, d[k:], False) + [tree(d[:k])]


def test_consistency_paths_of_all_sizes_to_64(spark):
    hashes = [hashlib.sha256(bytes([i])).hexdigest() for i in range(64)]
    for n in range(1, 65):
        for m in range(1, n + 1):
            want = brute_proof(m, hashes[:n])
            assert [tree(hashes[a:b]) for a, b in proofs.path_ranges(m, n)] == want
            old, new = tree(hashes[:m]), tree(hashes[:n])
            assert proofs.verify_consistency_path(m, old, n, new, want)
            if want:
                wrong = want[:-1] + ["00" * 32]
                assert not proofs.verify_consistency_path(m, old, n, new, wrong) and not proofs.verify_consistency_path(m, old, n, new, want[:-1])
                assert not proofs.verify_consistency_path(m, "11" * 32, n, new, want)
    for n in (23, 64):
        nodes = ledger.levels(spark.createDataFrame(list(enumerate(hashes[:n])), "idx long, hash string"), n)
        for m in (1, 7, 16, 22, n):
            assert proofs.consistency_path(nodes, m, n) == brute_proof(m, hashes[:n])
    assert proofs.verify_consistency_path(0, "", 5, "x", []) and not proofs.verify_consistency_path(3, None, 2, None, []) and not proofs.verify_consistency_path(3, "zz", 5, "", ["q"])


def test_a_changed_training_set_is_refused(spark):
    rows = [(i, float(i % 7), 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double")
    scaler = signatures.fit_scaler(df, ["x", "y"])
    got = scaler.for_training(df.repartition(3))(df).where("row_id = 5").first()
    q = np.percentile([r[1] for r in rows], [25, 50, 75])
    assert math.isclose(got.x, round((5 - q[1]) / (q[2] - q[0]), 6)) and got.y == 0
    for other in (df.where("row_id < 39"), df.unionByName(df.limit(1)), spark.createDataFrame([(i + (i == 3) * 100, x, y) for i, x, y in rows], df.schema)):
        with pytest.raises(signatures.TrainingSetChanged):
            scaler.for_training(other)
    with pytest.raises(ValueError, match="no training rows"):
        signatures.fit_scaler(df.where("false"), ["x"])


def plain_forward(x, there, w):
    """One row at a time, in plain loops."""

    def linear(v, layer):
        return [sum(a * b for a, b in zip(row, v, strict=True)) + c for row, c in zip(layer["weight"], layer["bias"], strict=True)]

    def gelu(v):
        return [0.5 * a * (1 + math.tanh(math.sqrt(2 / math.pi) * (a + 0.044715 * a**3))) for a in v]

    embedded = []
    for (a, b), e in zip(forward.SLICES, w["encoders"], strict=True):
        h, g = linear(x[a:b], e["linear0"]), e["groupnorm"]
        size, out = len(h) // g["num_groups"], []
        for k in range(0, len(h), size):
            part = h[k : k + size]
            m = sum(part) / size
            var = sum((p - m) ** 2 for p in part) / size
            out += [(p - m) / math.sqrt(var + g["eps"]) * g["weight"][k + i] + g["bias"][k + i] for i, p in enumerate(part)]
        embedded.append(linear(gelu(out), e["linear1"]))
    logits = linear(gelu(linear([v for e in embedded for v in e] + [float(t) for t in there], w["fusion"]["gate_linear0"])), w["fusion"]["gate_linear1"])
    held = [v if t else None for v, t in zip(logits, there, strict=True)] if any(there) else [0.0] * 4
    top = max(v for v in held if v is not None)
    e = [math.exp(v - top) if v is not None else 0.0 for v in held]
    gates = [v / sum(e) for v in e]
    fused = [sum(g * math.tanh(m[d]) for g, m in zip(gates, embedded, strict=True)) for d in range(len(embedded[0]))]
    return 1 / (1 + math.exp(-linear(gelu(linear(fused, w["head"]["linear0"])), w["head"]["linear1"])[0])), gates


def test_fused_scores_equal_plain_loops_for_all_masks(spark):
    rnd, w = random.Random(6), features.stand_in_weights()
    columns, flags = [f"x{i}" for i in range(42)], ["a", "b", "c", "d"]
    rows = [(i, *[rnd.gauss(0, 2) for _ in range(42)], *[bool(i >> k & 1) for k in range(4)], -1.0) for i in range(16)]
    df = spark.createDataFrame(rows, ["id", *columns, *flags, "Score"])
    got = {r.id: r for r in forward.with_scores(df, columns, flags, w).collect()}
    for r in rows:
        score, gates = plain_forward(r[1:43], r[43:47], w)
        assert abs(got[r[0]].score - score) < 1e-9 and np.allclose(got[r[0]].attribution, gates, atol=1e-9)
    assert forward.with_scores(df.where("false"), columns, flags, w).count() == 0
    odd = spark.createDataFrame([(1, *[None] * 42, None, True, None, False)], f"id int, {', '.join(f'{c} double' for c in columns)}, a boolean, b boolean, c boolean, d boolean")
    assert forward.with_scores(odd, columns, flags, w).first().attribution == [0.0, 1.0, 0.0, 0.0]


def test_fused_scores_query_reads_every_window(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data here")
    found = features.fused_scores(spark, data).collect()
    assert len(found) == features.flow_table(spark, data).count()
    assert all(abs(r.share_m1 + r.share_m2 + r.share_m3 + r.share_m4 - 1) < 5e-6 and r.share_m1 == 0 and 0 <= r.score <= 1 for r in found)


def test_metric_bundle_of_one_class_and_bad_input(spark):
    rows = [("one", i, 1, 0.2 + i / 100) for i in range(30)] + [("two", i, i % 2, i / 30) for i in range(30)]
    df = spark.createDataFrame(rows, "fold string, id long, y int, score double")
    got = {r.fold: r for r in protocol.metric_bundle(df, ["fold"], "id").collect()}
    assert got["one"].ap is None and got["one"].mcc is None and got["one"].aurc is not None and got["one"].positives == 30
    assert got["two"].n == 30 and got["two"].auc is not None and got["two"].tp + got["two"].fp + got["two"].fn + got["two"].tn == 30
    bad = df.unionByName(spark.createDataFrame([("two", 99, 2, float("nan")), ("one", 98, None, None)], df.schema))
    assert {(r.fold, r.n, r.bad_scores, r.bad_labels) for r in protocol.input_errors(bad, ["fold"]).collect()} == {("one", 31, 1, 1), ("two", 31, 1, 1)}
    with pytest.raises(ValueError, match="of 31 rows"):
        protocol.require_clean(bad, ["fold"])


def test_coverage_text_stacking_and_unrecorded_numerals(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", None), ("a", "y", None), (None, "z", 1)], "b string, p string, l int")
    found = coverage.coverage(rows, "b", "p", F.col("l").isNotNull())
    assert {(r.level, r.bundle, r.part): (r.n, r.n_labelled, r.share, r.n_parts, r.n_parts_labelled) for r in found.collect()} == {
        ("part", "a", "x"): (2, 1, 0.5, 1, 1), ("part", "a", "y"): (1, 0, 0.0, 1, 0), ("part", None, "z"): (1, 1, 1.0, 1, 1), ("bundle", "a", None): (3, 1, 0.333333, 2, 1), ("bundle", None, None): (1, 1, 1.0, 1, 1), ("all", None, None): (4, 2, 0.5, 3, 2),
    }
    assert coverage.coverage_markdown(found).splitlines()[2:] == ["| - | 1 | 1 | 1.0000 | 1 | 1 |", "| a | 3 | 1 | 0.3333 | 2 | 1 |", "| all | 4 | 2 | 0.5000 | 3 | 2 |"]
    both = coverage.stacked({"r1": rows, "r2": rows.select("l", "p", "b").limit(1)})
    assert {r.replica: r.n for r in both.groupBy("replica").agg(F.count("*").alias("n")).collect()} == {"r1": 4, "r2": 1}
    with pytest.raises(ValueError, match="'l'"):
        coverage.stacked({"r1": rows, "r2": rows.drop("l")})
    said = spark.createDataFrame([(1, "0.93 of 12 and 12"), (2, "7.5 x9 3.")], "id int, t string")
    known = spark.createDataFrame([("12",), ("7.5",), ("12",)], "text string")
    got = sorted((r.id, r.numeral) for r in coverage.unrecorded(said, texts.numerals(F.col("t")), known, "text").collect())
    assert got == [(1, "0.93"), (2, "3")]


def test_detectors_by_name(spark):
    train = spark.createDataFrame([(i, float(i), i % 2) for i in range(10)], "row_id long, x double, y int")
    assert {r.score for r in detectors.detector("majority")(train, train, ["x"], "y").collect()} == {0.5}
    assert len({r.score for r in detectors.detector("random")(train, train, ["x"], "y", seed=3).collect()}) == 10
    with pytest.raises(KeyError, match="boosted_trees, logistic, majority, random"):
        detectors.detector("forest")


def test_floors_of_one_class_folds_and_new_patterns(spark):
    from sievelight.operators import leakage

    rows = [("a", 1, 1), ("a", 1, 1), ("b", 1, 0), ("b", 2, 1), ("b", 3, 0), ("c", 1, 0), ("c", 3, 1)]
    df = spark.createDataFrame(rows, "replica string, m int, y int")
    got = {r.replica: (r.n, r.positives, r.ap) for r in leakage.leave_one_out_floors(df, "replica", "y", {"m": ["m"]}).collect()}
    # b: pattern 1 scores 2/3, 3 scores 1, and 2, new to it, all of theirs 3/4.
    assert got == {"a": (2, 2, None), "b": (3, 1, 0.5), "c": (2, 1, 0.5)}


def test_boosted_trees_fit_patterns_and_not_rows(spark, monkeypatch):
    """Equal training rows are one weighted row, and the scores are those of the rows themselves."""
    sizes, fit = [], detectors.GBTClassifier.fit

    def recorded(self, known):
        sizes.append(known.count())
        return fit(self, known)

    rows = spark.range(600).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 7 * (F.col("id") % 3) > 5).cast("int").alias("y"))
    assembled = detectors.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows.fillna(0).withColumn("label", F.col("y").cast("double")))
    plain = detectors._scored(detectors.GBTClassifier(maxIter=3, maxDepth=4, seed=0).fit(assembled), assembled)
    monkeypatch.setattr(detectors.GBTClassifier, "fit", recorded)
    got = {r.row_id: r.score for r in detectors.boosted_trees(rows, rows, ["a", "b"], "y", 3).collect()}
    assert sizes == [25] and got == {r.row_id: pytest.approx(r.score) for r in plain.collect()}
