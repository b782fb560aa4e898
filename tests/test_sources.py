from __future__ import annotations

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievelight.functions import keys, timeparse
from sievelight.sources import archives, eve, lines, manifest, uploads


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("parse", "text", "want"),
    [
        (lambda c: timeparse.syslog(c, 2022), "Jan 23 06:25:05 host CRON[1]: x", 1642919105.0),
        (lambda c: timeparse.syslog(c, 2022), "Jan  3 06:25:05 h", 1641191105.0),
        (lambda c: timeparse.syslog(c, 2022), "Feb 30 06:25:05 h", None),
        (timeparse.apache, "1.2.3.4 - - [23/Jan/2022:06:36:13 +0000] GET", 1642919773.0),
        (timeparse.apache, "1.2.3.4 - - [23/Jan/2022:08:36:13 +0200] GET", 1642919773.0),
        (timeparse.auditd, "type=X msg=audit(1642724221.475:149): y", 1642724221.475),
        (timeparse.iso, "2022-01-21 00:09:11 up", 1642723751.0),
        (timeparse.rfc3339, "2022-01-21T00:00:09.123456+0000", 1642723209.123456),
        (timeparse.rfc3339, "not a time", None),
    ],
)
def test_timestamps(spark, parse, text, want):
    assert one(spark, parse(F.col("t")), t=text) == want


def test_dispatch(spark):
    got = {p: one(spark, timeparse.by_source(F.col("p"), F.col("t"), 2022), p=p, t=t) for p, t in {"a/syslog.1": "Jan 21 00:00:09 d", "a/audit/audit.log": "audit(1642724221.475:1)", "x-system.cpu.log": "Jan 21 00:00:09"}.items()}
    assert got == {"a/syslog.1": 1642723209.0, "a/audit/audit.log": 1642724221.475, "x-system.cpu.log": None}


def test_keys(spark):
    assert one(spark, keys.host_bucket(F.col("h")), h="vpn") == int(hashlib.sha256(b"vpn").hexdigest()[:8], 16) % 64
    assert [one(spark, keys.subnet(F.col("a")), a=a) for a in ("10.1.2.3", "fe80::1", "300.1.1.1", "")] == ["10.1.2.0/24", "ipv6", "invalid", "invalid"]
    assert one(spark, keys.rounded(F.lit(-0.0000001)), h=1) == 0.0


def test_lines(spark, tmp_path):
    for name, data in {"syslog": b"a\nb\n", "syslog.1": b"c", "syslog.2": b"d\ne\r\n\xff\xfe garbage\n", "empty": b""}.items():
        (tmp_path / name).write_bytes(data)
    rows = lines.numbered(lines.read_lines(spark, str(tmp_path)), ["base"]).where("base = 'syslog'").orderBy("global_line").collect()
    assert [(r.suffix, r.local_line, r.global_line) for r in rows] == [(2, 1, 1), (2, 2, 2), (2, 3, 3), (1, 1, 4), (0, 1, 5), (0, 2, 6)]
    assert rows[1].text == "e\r" and "garbage" in rows[2].text and bytes(rows[2].raw).startswith(b"\xff\xfe")


def test_labels(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(json.dumps(x) for x in [{"line": 1, "labels": ["x"]}, {"line": 5, "labels": ["a", "b"], "rules": {"a": ["r"]}}, {"line": 1, "labels": ["y"]}]))
    labels = lines.read_labels(spark, str(tmp_path / "l.json"))
    numbered = spark.range(1, 7).select(F.col("id").alias("global_line"))
    got = {r.global_line: (list(r.labels), r.is_attack) for r in lines.with_labels(numbered, labels).collect()}
    assert got[1] == (["y"], True) and got[5] == (["a", "b"], True) and got[2] == ([], False)
    with pytest.raises(lines.LabelJoinError, match="5"):
        lines.with_labels(numbered.where("global_line < 4"), labels)


def test_eve(spark, tmp_path):
    flow = {"timestamp": "2022-01-21T00:00:09.000000+0000", "event_type": "flow", "dest_ip": "10.0.0.1", "proto": "TCP", "dest_port": 80, "flow": {"pkts_toserver": 3, "bytes_toserver": 10, "start": "2022-01-21T00:00:01.000000+0000", "end": "2022-01-21T00:00:04.000000+0000"}}
    alert = flow | {"event_type": "alert", "alert": {"severity": 2}, "dest_port": 443, "flow": None}
    (tmp_path / "web").mkdir()
    (tmp_path / "web/eve.json").write_text("\n".join([json.dumps(flow), "not valid json", json.dumps(alert)]))
    records, bad = eve.read_eve(spark, str(tmp_path / "web/eve.json"))
    r = eve.flow_features(records).first()
    assert bad.first().malformed == 1 and (r.host, r.n_flow, r.n_alert, r.max_severity, r.n_ports, r.port_entropy) == ("web", 1, 1, 2, 2, 1.0)
    assert (r.pkts_to_server, r.bytes_to_client, r.mean_duration, r.frac_tcp) == (3, 0, 3.0, 1.0)
    assert eve.peers(records).collect()[0].peer == "10.0.0.0/24"


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("gather/x/log", "one\ntwo\n")
        z.writestr("labels/x/log", "{}")
    (tmp_path / "b.zip").write_bytes(b"truncated")
    got = {(r.archive, r.root): (r.n_files, r.n_bytes, r.status) for r in archives.catalogue(archives.read_zip(spark, f"{tmp_path}/*.zip")).collect()}
    assert got == {("a.zip", "gather"): (1, 8, "ok"), ("a.zip", "labels"): (1, 2, "ok"), ("b.zip", None): (0, 0, "incomplete")}
    assert [r.text for r in archives.read_zip(spark, f"{tmp_path}/a.zip", "gather/", True).orderBy("line").collect()] == ["one", "two"]


def test_manifest(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1")
    (tmp_path / "b").write_bytes(b"2")
    rows = [("a", hashlib.sha256(b"1").hexdigest(), True), ("b", "0" * 64, False), ("c", "0" * 64, True)]
    checked = manifest.verified(spark.createDataFrame(rows, "name string, sha256 string, required boolean"), manifest.file_sums(spark, str(tmp_path)))
    assert {r.name: r.status for r in checked.collect()} == {"a": "ok", "b": "altered", "c": "missing"}
    with pytest.raises(manifest.ManifestError, match="c: missing"):
        manifest.require(checked)


def test_uploads(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text('﻿B Col;a_col;Label;extra\n1,5;"2";x;q\n3;4; Attack ;"two\nlines"\nnan;1e3;0;r\n')
    rows, label = uploads.read_csv(spark, str(path), ["a_col", "b_col"])
    out = uploads.parsed(rows, ["a_col", "b_col"], label).orderBy("row_id").collect()
    assert label == "label" and [list(r.errors) for r in out] == [["b_col", "label"], [], ["b_col"]] and [r.y for r in out] == [None, True, False]  # "x" is no label
    scored = uploads.with_scores(rows, spark.createDataFrame([(out[1].row_id, 0.9)], "row_id long, score double"))
    assert sorted(r.verdict for r in scored.collect()) == ["attack", "not scored", "not scored"]
    with pytest.raises(uploads.UploadError, match="missing"):
        uploads.read_csv(spark, str(path), ["zzz"])


def test_flow_features_multiply_no_record(spark):
    """Distinct ports and addresses are counted without a copy of every record for each; windows of a null host count as well."""
    flow = "flow struct<pkts_toserver: bigint, pkts_toclient: bigint, bytes_toserver: bigint, bytes_toclient: bigint, start: string, end: string>"
    rows = [(None, 5.0, "flow", "10.0.0.1", d, "tcp", p, (q, None, 7, 1, None, None), None) for d, p, q in (("fe80::1", 80, 1), ("10.1.2.3", 80, 2), ("", 443, 3), (None, None, None))]
    records = spark.createDataFrame(rows, f"host string, ts double, event_type string, src_ip string, dest_ip string, proto string, dest_port int, {flow}, alert struct<severity: string>")
    found = eve.flow_features(records)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    r = found.collect()
    assert len(r) == 1 and (r[0].n_flow, r[0].n_ports, r[0].n_addresses, r[0].frac_ipv6, r[0].pkts_to_server, r[0].p90_bytes) == (4, 2, 2, 0.25, 6, 7.0)
    assert r[0].port_entropy == 0.918296


def test_addresses_are_judged_once_a_group(spark):
    """Forms of addresses against the standard library, by one pattern each; addresses and kinds of records are looked at after they are grouped."""
    import ipaddress
    import random
    import re

    rnd = random.Random(6)
    found = ["1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "::", ":::", "1::2::3", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "12345::", "1.2.3", "01.2.3.4", "249.250.255.26", "256.1.1.1", "::g", "", "1:", ":1"]
    for _ in range(600):
        groups = ["%x" % rnd.randrange(65536) for _ in range(rnd.randrange(1, 9))] + rnd.choice([[], ["10.0.0.%d" % rnd.randrange(300)]])
        found += [":".join(groups), "::".join([":".join(groups[: len(groups) // 2]), ":".join(groups[len(groups) // 2 :])]), ".".join(str(rnd.randrange(280)) for _ in range(4))]

    def wanted(a):
        try:
            return "ipv6" if ipaddress.ip_address(a).version == 6 else str(ipaddress.ip_network(a + "/24", False))
        except ValueError:
            return "invalid"

    judged = spark.createDataFrame([(a,) for a in found], "a string").select("a", keys.subnet(F.col("a")).alias("s"))
    assert {r.a: r.s for r in judged.collect()} == {a: wanted(a) for a in found}
    assert "lambda" not in judged._jdf.queryExecution().optimizedPlan().toString()
    flow = "flow struct<pkts_toserver: bigint, pkts_toclient: bigint, bytes_toserver: bigint, bytes_toclient: bigint, start: string, end: string>"
    rows = [("h", 5.0, t, s, d, p, 80, None, (v,)) for t, s, d, p, v in (("alert", "fe80::1", "10.1.2.3", "tcp", "2"), ("alert", "10.0.0.1", "10.1.2.3", "TCP", "x"), ("dns", None, "fe80::1", None, None), ("odd", None, "", "ipv6-icmp", "-3"))]
    records = spark.createDataFrame(rows, f"host string, ts double, event_type string, src_ip string, dest_ip string, proto string, dest_port int, {flow}, alert struct<severity: string>")
    table = eve.flow_features(records)
    assert not re.search(r"(?i)(contains|rlike)\((dest_ip|upper\(proto)", table._jdf.queryExecution().optimizedPlan().toString())
    r = table.collect()
    assert len(r) == 1 and (r[0].n_alert, r[0].n_dns, r[0].n_flow, r[0].max_severity, r[0].n_addresses, r[0].frac_ipv6) == (2, 1, 0, 2, 2, 0.5)
    assert (r[0].frac_tcp, r[0].frac_icmp) == (0.666667, 0.333333)


def test_flows_with_timestamps(spark):
    """A flow's start and end may be timestamps, which need no text."""
    flow = "named_struct('pkts_toserver', 1L, 'pkts_toclient', 1L, 'bytes_toserver', 1L, 'bytes_toclient', 1L, 'start', timestamp'2022-01-21 00:00:01.25', 'end', timestamp'2022-01-21 00:00:04')"
    records = spark.sql(f"SELECT 'h' AS host, 5D AS ts, 'flow' AS event_type, '' AS src_ip, '' AS dest_ip, 'tcp' AS proto, 80 AS dest_port, {flow} AS flow, named_struct('severity', '1') AS alert")
    r = eve.flow_features(records).first()
    assert (r.mean_duration, r.p90_duration) == (2.75, 2.75)
