"""Comparison of splits against brute force, and a planted leak."""

from __future__ import annotations

import math
import random

import pytest

from sievelight.operators import comparison, detectors

ROWS = "row_id string, a int, b double, y int"


def brute(rows, part, columns):
    """``n_train, n_test, positives, ap, mcc`` of remembering rates."""
    key = lambda r: tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns)
    train, test = ([r for r in rows if part.get(r[0]) == p and r[3] is not None] for p in ("train", "test"))
    by = {}
    for r in train:
        by.setdefault(key(r), []).append(r[3])
    overall = sum(r[3] for r in train) / len(train)
    scored = [(sum(v) / len(v) if (v := by.get(key(r))) else overall, r[3]) for r in test]
    pos, ap = sum(y for _, y in scored), 0.0
    for s in {s for s, _ in scored}:
        at, upto = [y for t, y in scored if t == s], [y for t, y in scored if t >= s]
        ap += sum(at) / pos * sum(upto) / len(upto)
    n = {(h, y): sum((s >= 0.5) == h and z == y for s, z in scored) for h in (True, False) for y in (0, 1)}
    tp, fp, fn, tn = n[True, 1], n[True, 0], n[False, 1], n[False, 0]
    below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return len(train), len(test), pos, ap, (tp * tn - fp * fn) / math.sqrt(below) if below else 0.0


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    made = [(f"r{i}", rnd.choice([None, 0, 1, 2, 3]), rnd.choice([None, 0.5, 0.25, 1e-9]), rnd.choice([0, 0, 1, 1, None])) for i in range(300)]
    return made + [(f"hot{i}", 7, 0.125, int(i % 3 == 0)) for i in range(200)]


def parts(spark, placed):
    return spark.createDataFrame(list(placed.items()), "row_id string, part string")


def test_compared_and_gaps(spark, rows):
    rnd = random.Random(5)
    placed = {"easy": {r[0]: rnd.choice(["train", "val", "test"]) for r in rows}, "strict": {r[0]: "train" if i < 250 else "test" for i, r in enumerate(rows)}}
    sets = {"a": ["a"], "ab": ["a", "b"]}
    got = comparison.compared(spark.createDataFrame(rows, ROWS), {k: parts(spark, v) for k, v in placed.items()}, sets, "y", "memory")
    found = {(r.split, r.features): r[2:] for r in got.collect()}
    assert len(found) == 4
    for (split, name), values in found.items():
        want = brute(rows, placed[split], [{"a": 1, "b": 2}[c] for c in sets[name]])
        assert values == tuple(pytest.approx(w, abs=1e-6) for w in want)
    for g in comparison.gaps(got, "easy", "strict").collect():
        easy, strict = found["easy", g.features], found["strict", g.features]
        assert (g.easy_ap, g.strict_ap) == (easy[3], strict[3]) and g.ap_gap == pytest.approx(easy[3] - strict[3], abs=2e-6) and g.mcc_gap == pytest.approx(easy[4] - strict[4], abs=2e-6)


def test_repeated(spark, rows):
    rnd = random.Random(6)
    placed = {r[0]: rnd.choice(["train", "test", "val"]) for r in rows}
    got = comparison.repeated(spark.createDataFrame(rows, ROWS), {"s": parts(spark, placed)}, ["a", "b"]).first()
    key = lambda r: (r[1], None if r[2] is None else round(r[2], 6))
    seen = {}
    for r in rows:
        if placed[r[0]] == "train":
            seen.setdefault(key(r), set()).add(r[3])
    test = [r for r in rows if placed[r[0]] == "test"]
    twins = [r for r in test if key(r) in seen]
    opposed = [r for r in twins if r[3] is not None and r[3] not in seen[key(r)]]
    assert (got.n_test, got.twins, got.opposed, got.share) == (len(test), len(twins), len(opposed), round(len(twins) / len(test), 6))


def test_a_leak_shows_as_a_gap(spark):
    """A column that only names the hour tells the label where an hour's rows are on both sides."""
    made = [(f"r{i}", i // 10, 1.0, int((i // 10) % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(made, ROWS)
    chance = parts(spark, {r[0]: "train" if i % 5 else "test" for i, r in enumerate(made)})
    later = parts(spark, {r[0]: "train" if i < 300 else "test" for i, r in enumerate(made)})
    gap = comparison.gaps(comparison.compared(df, {"random": chance, "later": later}, {"hour": ["a"], "flat": ["b"]}, "y", "memory"), "random", "later")
    found = {g.features: g for g in gap.collect()}
    assert found["hour"].easy_ap == 1.0 and found["hour"].ap_gap > 0.5 and abs(found["flat"].ap_gap) < 0.1


def test_nothing_to_train_on_and_empty_tables(spark):
    df = spark.createDataFrame([("x", 1, None, 1), ("y", None, 0.5, 0)], ROWS)
    only = parts(spark, {"x": "test", "y": "test"})
    assert [r.score for r in detectors.memory_scores(df.where("false"), df, ["a", "b"], "y").collect()] == [0.0, 0.0]
    assert comparison.compared(df, {"s": only}, {"a": ["a"]}, "y", "memory").first()[2:6] == (0, 2, 1, 0.5)
    none = df.where("false")
    assert comparison.compared(none, {"s": only}, {"a": ["a"]}, "y", "memory").count() == 0
    assert comparison.repeated(none, {"s": only}, ["a"]).count() == 0
