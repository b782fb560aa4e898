"""Settings of splits, controls that fit models, attributions, keyed labels."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sievelight.functions import keys, texts
from sievelight.operators import feature_sets, leakage, protocol
from sievelight.sources import lines

REPLICAS = ["a", "b", "c"]


@pytest.mark.parametrize(
    ("config", "n"),
    [
        ({"mode": "replica", "train": ["a"], "test": ["b"]}, 0),
        ({"mode": "replica", "train": ["a", "a", "x"], "test": ["a"], "val_fraction": 0.5, "seed": 0.5}, 5),
        ({"mode": "replica", "train": [], "test": None}, 2),
        ({"mode": "random", "replicas": ["a"], "train_pct": 60, "val_pct": 20, "test_pct": 20}, 0),
        ({"mode": "random", "replicas": ["a"], "train_pct": 10, "val_pct": 90, "test_pct": -1}, 3),
        ({"mode": "chronological", "replicas": ["a"], "train_pct": float("nan"), "val_pct": 20, "test_pct": "20"}, 2),
        ({"mode": "loro", "replicas": ["a"]}, 1),
        ({"mode": "other"}, 1),
        (None, 1),
    ],
)
def test_config_errors(config, n):
    assert len(protocol.config_errors(config, REPLICAS)) == n


def test_loro_folds():
    folds = protocol.loro_folds({"mode": "loro", "replicas": ["c", "a"], "seed": 3}, REPLICAS)
    assert [(f["train"], f["test"], f["seed"]) for f in folds] == [(["c"], ["a"], 3), (["a"], ["c"], 3)]
    assert all(protocol.config_errors(f, REPLICAS) == [] for f in folds)
    with pytest.raises(ValueError):
        protocol.loro_folds({"mode": "loro", "replicas": ["a"]}, REPLICAS)


@pytest.fixture(scope="module")
def sourced(spark):
    rnd = random.Random(3)
    rows = [(i, "xyz"[i % 3], float(i % 3) + rnd.random() / 4, rnd.random(), int(rnd.random() < 0.3)) for i in range(600)]
    return spark.createDataFrame(rows, "row_id long, source string, told double, noise double, y int").repartition(4).cache()


def test_provenance(sourced):
    told = {r.source: r.auc for r in protocol.provenance_auc(sourced, ["told", "noise"], "source", ["x", "y", "z"], trees=5).collect()}
    assert set(told) == {"x", "y", "z", None} and min(told.values()) > 0.95  # five trees, some of which look at noise
    blind = {r.source: r.auc for r in protocol.provenance_auc(sourced, ["noise"], "source", ["x", "y", "z"], trees=5).collect()}
    assert abs(blind[None] - 0.5) < 0.08
    assert protocol.provenance_auc(sourced, ["noise"], "source", ["x"]).count() == 0


def test_permuted_labels_are_fitted_again(sourced):
    """A model that may see the label itself still scores at chance on permuted ones."""
    rows = protocol.permuted_precision(sourced.withColumn("leak", F.col("y").cast("double")), ["leak", "noise"], "y", trees=5).collect()
    assert len(rows) == 3 and all(r.within_tolerance and abs(r.prevalence - rows[0].prevalence) < 1e-9 for r in rows)


def test_forests_see_patterns_and_not_rows(spark, monkeypatch):
    """Rows of equal features and label are fitted as a few weighted ones, and none is lost."""
    seen, fit = [], protocol.RandomForestClassifier.fit

    def recorded(self, known):
        seen.append(known.agg(F.count("*"), F.sum("_w")).first())
        return fit(self, known)

    monkeypatch.setattr(protocol.RandomForestClassifier, "fit", recorded)
    monkeypatch.setattr(protocol, "BLOCKS", 60)
    rows = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 4).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rate = protocol.permuted_precision(rows, ["x"], "y", repeats=1, trees=2).first().prevalence
    assert rate == pytest.approx(1 / 3) and len(seen) == 3
    assert all(n <= 100 for n, _ in seen) and sum(w for _, w in seen) == pytest.approx(2 * 3000)


def test_dealt_labels(spark):
    """As many of each label as before, nulls too, and another order for another seed."""
    rows = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") >= 100, (F.col("id") % 10 == 0).cast("int")).alias("y")).repartition(3)
    dealt = rows.select("row_id", "y", *[leakage.dealt_labels(rows, "y", k).alias(f"d{k}") for k in (1, 2)]).collect()
    count = lambda c: {v: sum(r[c] == v for r in dealt) for v in (None, 0, 1)}
    assert count("y") == count("d1") == count("d2")
    assert sum(r.d1 != r.d2 for r in dealt) > 200 and sum(r.y == 1 and r.d1 == 1 for r in dealt) < 60


def test_attributions(spark):
    df = spark.createDataFrame([(1, [0.1, 0.4, 0.4, 0.1]), (1, [0.7, 0.1, 0.1, 0.1])], "k int, a array<double>")
    assert [r[0] for r in df.select(feature_sets.dominant_modality(F.col("a"))).collect()] == ["m2", "m1"]
    row = feature_sets.mean_attribution(df, ["k"], "a").first()
    assert (row.m1, row.m4) == (pytest.approx(0.4), pytest.approx(0.1))
    assert df.select(feature_sets.uniform_attribution()).first()[0] == [0.25] * 4
    assert df.select(feature_sets.four_flags(F.lit(True), F.lit(False), F.lit(False))).first()[0] == [True, False, True, False]


def test_feature_sets():
    assert len(feature_sets.feature_columns()) == 42 and feature_sets.feature_columns("m2")[0] == "m2_0" and len(feature_sets.feature_columns("m2")) == 24
    with pytest.raises(ValueError):
        feature_sets.feature_columns("m9")


def test_addresses(spark):
    fine = ["::1", "::", "1:2:3:4:5:6:7:8", "fe80::a:b", "::ffff:10.0.0.1", "1::"]
    bad = [":::", "1:2:3", "a:b:c", "1:2:3:4:5:6:7:8:9", "12345::", "1::2::3", "g::1", "::ffff:10.0.0.300", ":1", "10.0.0.1"]
    df = spark.createDataFrame([(a,) for a in fine + bad], "a string")
    assert [r[0] for r in df.select(keys.is_ipv6(F.col("a"))).collect()] == [True] * len(fine) + [False] * len(bad)


def test_texts(spark):
    row = spark.range(1).select(texts.numerals(F.lit("AP 0.93 of 12 runs, v2 and 7")).alias("n"), F.struct(*texts.lognormal_parameters(F.lit(3.0), F.lit(2.0))).alias("p"), texts.without_stamp(F.lit('h - - [21/Jan/2022:03:04:05 +0000] "GET /"'), F.lit("apache")).alias("a")).first()
    assert row.n == ["0.93", "12", "7"] and row.a == '"GET /"'
    mu, sigma = row.p
    assert math.exp(mu + sigma * sigma / 2) == pytest.approx(3.0) and math.sqrt(math.expm1(sigma**2)) * 3 == pytest.approx(2.0)


def test_labels_by_host_and_source(spark, tmp_path):
    """Labels of one file do not stick to another; the last record of a line wins; a label beyond a file's end is an error."""
    records = [{"line": 2, "labels": ["old"]}, {"line": 1, "labels": []}, {"line": 2, "labels": ["new"]}]
    (tmp_path / "labels.json").write_text("".join(json.dumps(r) + "\n" for r in records))
    labels = lines.read_labels(spark, str(tmp_path)).withColumns({"host": F.lit("h1"), "base": F.lit("auth.log")})
    logs = spark.createDataFrame([("h1", "auth.log", 1), ("h1", "auth.log", 2), ("h1", "syslog", 2), ("h2", "auth.log", 2)], "host string, base string, global_line long")
    got = {(r.host, r.base, r.global_line): (r.labels, r.is_attack) for r in lines.with_labels(logs, labels, ("host", "base")).collect()}
    assert got == {("h1", "auth.log", 1): ([], False), ("h1", "auth.log", 2): (["new"], True), ("h1", "syslog", 2): ([], False), ("h2", "auth.log", 2): ([], False)}
    with pytest.raises(lines.LabelJoinError):
        lines.with_labels(logs.where("global_line = 1 OR base = 'syslog'"), labels, ("host", "base"))


def test_certificate_counts_as_joins_do(spark):
    """Twins, shared groups and the floor from counts are those that joins of the rows give."""
    from sievelight.operators import certificate, curves, splits

    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 7).alias("g"), (F.col("id") % 2).cast("int").alias("m"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    parts = splits.random_stratified(rows, "y", 1).where("row_id % 13 != 0")
    got = {r.measure: r.value for r in certificate.certificate(rows, parts, ["a", "b"], "g", ["m"], "y", bits=8).collect()}
    joined = rows.join(parts, "row_id")
    assert got["test rows with a training twin"] == leakage.twins(joined.where("part = 'test'"), joined.where("part = 'train'"), ["a", "b"]).count()
    signed = leakage.simhash(rows.select("row_id", F.array("a", "b").alias("v")), "v", 8, 0).join(parts, "row_id")
    assert got["test rows with a near twin in training"] == leakage.twins(signed.where("part = 'test'"), signed.where("part = 'train'"), ["signature"]).count()
    assert got["groups on several sides"] == leakage.group_overlap(joined, "g").agg(F.sum("shared")).first()[0]
    floor = leakage.pattern_floor(rows, ["m"], "y", 5, 0).withColumn("all", F.lit(0))
    assert got["average precision"] == curves.average_precision(curves.curve(floor, ["all"]), ["all"]).first().ap
