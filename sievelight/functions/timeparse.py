"""Timestamps in log lines, as columns of epoch seconds (UTC); what cannot be parsed is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch(stamp: Column) -> Column:
    return F.unix_micros(stamp) / 1e6


def syslog(line: Column, year: int) -> Column:
    """``Jan 23 06:25:05`` at the start of a line; the year is supplied."""
    head = F.regexp_replace(F.regexp_extract(line, r"^([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2})", 1), r"\s+", " ")
    return _epoch(F.try_to_timestamp(F.concat(F.lit(f"{year} "), head), F.lit("yyyy MMM d HH:mm:ss")))


def apache(line: Column) -> Column:
    """``[23/Jan/2022:06:36:13 +0000]`` anywhere in a line."""
    return _epoch(F.try_to_timestamp(F.regexp_extract(line, r"\[(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]", 1), F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def auditd(line: Column) -> Column:
    """The epoch inside ``audit(1642724221.475:149)``."""
    return F.regexp_extract(line, r"audit\((\d+\.\d+):\d+\)", 1).try_cast("double")


def iso(line: Column) -> Column:
    """``2022-01-21 00:09:11`` at the start of a line, taken as UTC."""
    return _epoch(F.try_to_timestamp(F.regexp_extract(line, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit("yyyy-MM-dd HH:mm:ss")))


def rfc3339(text: Column) -> Column:
    """``2022-01-21T00:00:09.123456+0000``, with or without a fraction, with an offset or Z."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSZ", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return _epoch(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]))


def by_source(path: Column, line: Column, year: int) -> Column:
    """The parser that fits the file's name; null for unknown files."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.\d+$", "")
    return (
        F.when(F.startswith(name, F.lit("audit.log")), auditd(line))
        .when(name.rlike(r"access\.log$|access_log$"), apache(line))
        .when(name.rlike(r"^(syslog|auth\.log|dnsmasq\.log|mail\.log|messages)$"), syslog(line, year))
        .when(name.rlike(r"^openvpn\.log$"), iso(line))
        .when(name == "eve.json", rfc3339(F.get_json_object(line, "$.timestamp")))
    )


def window_start(ts: Column, seconds: int = 60) -> Column:
    """Start of the tumbling window of epoch seconds."""
    return (F.floor(ts / seconds) * seconds).cast("long")
