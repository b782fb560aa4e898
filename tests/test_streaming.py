from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from sievelight.operators import ledger
from sievelight.operators import templates as batch_templates
from sievelight.operators.windows import peer_history
from sievelight.streaming import log, peers, state, windows
from sievelight.streaming import templates as stream_templates

EVENTS = "host string, at timestamp, event_type string, value double"


def written(spark, tmp_path, rows, schema, files=3):
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def finished(spark, df, tmp_path, name):
    with state.rocksdb(spark):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.table(name)
    out._progress = q.lastProgress
    return out


def test_windows_equal_batch(spark, tmp_path):
    start, rnd = datetime.datetime(2024, 1, 1), random.Random(1)
    rows = sorted(((f"h{rnd.randint(0, 2)}", start + datetime.timedelta(seconds=rnd.randint(0, 3000)), rnd.choice(["error", "view"]), 1.0) for _ in range(300)), key=lambda r: r[1])
    rows.append(("h0", start + datetime.timedelta(days=1), "view", 0.0))  # moves the watermark on
    got = {(r.host, r.window_start): (r.n_events, r.y) for r in finished(spark, windows.tumbling(written(spark, tmp_path, rows, EVENTS)), tmp_path, "tumbling").collect()}
    want = {}
    for host, at, kind, _ in rows[:-1]:
        key = (host, int(at.replace(tzinfo=datetime.timezone.utc).timestamp()) // 60 * 60)
        n, y = want.get(key, (0, 0))
        want[key] = (n + 1, max(y, int(kind == "error")))
    local = {k: v for k, v in got.items()}
    assert sorted(local.values()) == sorted(want.values()) and len(local) == len(want)


def test_peers_equal_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"h{h}", 60 * w, f"p{rnd.randint(0, 5)}") for w in range(9) for h in range(3) for _ in range(rnd.randint(1, 3))]
    schema = "host string, window_start long, peer string"
    third = [r for r in rows if r[1] < 180], [r for r in rows if 180 <= r[1] < 360], [r for r in rows if r[1] >= 360]
    for part in third:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    got = {(r.host, r.window_start): (r.n_peers, r.n_new, r.n_ever) for r in finished(spark, peers.peer_history(stream), tmp_path, "peers").collect()}
    batch = {(r.host, r.window_start): (r.n_peers, r.n_new, r.n_ever) for r in peer_history(spark.createDataFrame(rows, schema)).collect()}
    assert got == batch


def test_log(spark, tmp_path):
    write = log.append_to(f"{tmp_path}/log")
    for number, entries in enumerate([["a", "b", "c"], ["d"], ["e", "f"]]):
        batch = spark.createDataFrame([(e,) for e in entries], "entry string")
        write(batch, number)
        if number == 1:
            write(batch, number)  # a repeated batch
    rows = spark.read.parquet(f"{tmp_path}/log/leaves").orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(6)) and {r.entry for r in rows[:3]} == {"a", "b", "c"} and rows[3].entry == "d"
    assert rows[3].hash == spark.range(1).select(ledger.leaf_hash(F.lit("d")).alias("h")).first().h


def utc(at):
    return int(at.replace(tzinfo=datetime.timezone.utc).timestamp())


def test_sliding_and_session_windows_equal_plain_python(spark, tmp_path):
    start, rnd = datetime.datetime(2024, 1, 1), random.Random(3)
    rows = sorted(((f"h{rnd.randint(0, 2)}", start + datetime.timedelta(seconds=rnd.randint(0, 2000)), rnd.choice(["error", "view"]), 1.0) for _ in range(120)), key=lambda r: r[1])
    last = ("h0", start + datetime.timedelta(days=1), "view", 0.0)
    stream = written(spark, tmp_path, [*rows, last], EVENTS)
    got = sorted((r.host, r.window_start, r.n_events) for r in finished(spark, windows.sliding(stream, "60 seconds", "20 seconds"), tmp_path, "sliding").collect())
    want: dict = {}
    for host, at, _, _ in rows:
        for k in range(3):
            key = (host, utc(at) // 20 * 20 - 20 * k)
            want[key] = want.get(key, 0) + 1
    assert got == sorted((h, s, n) for (h, s), n in want.items())
    got = sorted((r.host, r.window_start, r.n_events) for r in finished(spark, windows.sessions(stream, "30 seconds"), tmp_path, "sessions").collect())
    open_, want = {}, []
    for host, at, _, _ in rows:
        if host in open_ and utc(at) - open_[host][1] <= 30:
            open_[host][1:3] = [utc(at), open_[host][2] + 1]
        else:
            want += [open_[host]] if host in open_ else []
            open_[host] = [utc(at), utc(at), 1, host]
    want += open_.values()
    assert got == sorted((w[3], w[0], w[2]) for w in want)


def test_peer_state_is_a_row_a_peer_and_idle_hosts_are_forgotten(spark, tmp_path):
    schema = "host string, at timestamp, peer string"
    day = datetime.datetime(2024, 1, 1)
    steps = [[("a", 0, "x"), ("a", 0, "y"), ("b", 0, "x")], [("a", 60, "x"), ("a", 60, "z")], [("b", 4000, "q")], [("b", 4060, "q")], [("a", 4120, "x"), ("b", 4120, "x")]]
    for i, rows in enumerate(steps):
        spark.createDataFrame([(h, day + datetime.timedelta(seconds=t), p) for h, t, p in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        __import__("time").sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def rows(idle):
        s = stream.withWatermark("at", "0 seconds") if idle else stream
        named = s.select("host", F.unix_timestamp("at").alias("window_start"), "peer", "at")
        out = finished(spark, peers.peer_history(named, idle_seconds=idle), tmp_path, f"peers{idle or 0}")
        return sorted((r.host, r.window_start - utc(day), r.n_peers, r.n_new, r.n_ever, r.again, r.n_previous) for r in out.collect()), out._progress

    kept, progress = rows(None)
    assert kept == [("a", 0, 2, 2, 2, 0, 0), ("a", 60, 2, 1, 3, 1, 2), ("a", 4120, 1, 0, 3, 1, 2), ("b", 0, 1, 1, 1, 0, 0), ("b", 4000, 1, 1, 2, 0, 1), ("b", 4060, 1, 0, 2, 1, 1), ("b", 4120, 1, 0, 2, 0, 1)]
    assert progress["stateOperators"][0]["numRowsTotal"] >= 5  # a row for each host and peer, and a few for the last windows
    forgot, _ = rows(600)
    assert ("a", 4120, 1, 1, 1, 0, 0) in forgot and ("b", 4120, 1, 0, 2, 0, 1) in forgot  # b came back before the watermark had passed


def test_template_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(5)
    parts = ["user {} in", "user {} out", "read {} bytes from {}", "open port {} on host {}", "a {}", "{} b {}", "fail fail {} x y"]
    rows = [(rnd.choice(["r1", "r2"]), i, rnd.choice(parts).format(rnd.choice(["bob", "eve", 12, "0xff"]), rnd.choice(["amy", "joe", "10.0.0.1"]))) for i in range(240)]
    schema = "replica string, seq long, message string"
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        __import__("time").sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    lines = spark.createDataFrame(rows, schema)
    for most in (4096, 2):
        got = finished(spark, stream_templates.mine(stream, most=most), tmp_path, f"templates{most}").collect()
        assert [r.seq for r in sorted(got, key=lambda r: r.seq)] == list(range(240))
        found = {(r.replica, r.masked): r.number for r in batch_templates.assigned(lines, ["replica"], most=most).collect()}
        assert {(r.replica, r.masked): r.number for r in got} == found
        made = {(r.replica, r.size, r.head, r.number): r.seq for r in got if r.created}
        assert len(made) == len({(r.replica, r.size, r.head, r.number) for r in got}) == sum(r.created for r in got)
        assert all(made[r.replica, r.size, r.head, r.number] <= r.seq for r in got)


def test_a_closed_template_is_joined_no_more():
    leaf = batch_templates.Leaf(3, most=2)
    assert [leaf.place(m) for m in ("a b c", "d e f", "a b x", "g h i", "d e f", "a b y")] == [0, 1, 0, 2, 3, 4]
    assert leaf.texts() == {0: "a b <*>", 1: "d e f", 2: "g h i", 3: "d e f", 4: "a b y"}
