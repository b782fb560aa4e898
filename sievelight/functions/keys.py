"""Derived keys: buckets of hosts and addresses, ids of windows, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_bucket(host: Column, buckets: int = 64) -> Column:
    """The first eight hex digits of the host's SHA-256, modulo the buckets."""
    return (F.conv(F.substring(F.sha2(host.cast("binary"), 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def window_id(host: Column, start: Column) -> Column:
    start = start.cast("string")
    return F.concat(host, F.lit("-"), start, F.lit("-"), F.substring(F.sha2(F.concat(host, F.lit(":"), start).cast("binary"), 256), 1, 16))


#: Patterns of IPv4 and IPv6; an octet is told by its first digit, and no more than seven groups stand around a "::".
_OCTET = r"(?:1\d{0,2}|2(?:[0-4]\d?|5[0-5]?|[6-9])?|[3-9]\d?|0)"
_FOUR = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_HEX = "[0-9A-Fa-f]{1,4}+"
_SIX = rf"^(?:(?:{_HEX}:){{7}}{_HEX}|(?=(?::*+{_HEX}){{0,7}}+:*+$)(?:{_HEX}(?::{_HEX})*+)?::(?:{_HEX}(?::{_HEX})*+)?)$"


def is_address6(address: Column) -> Column:
    """Eight groups of one to four hex digits, or fewer around one "::"; the last two may be an IPv4 address."""
    plain = F.when(F.contains(address, F.lit(".")), F.regexp_replace(address, rf"(?<=:){_FOUR}$", "0:0")).otherwise(address)
    return plain.rlike(_SIX)


def subnet(address: Column) -> Column:
    """``a.b.c.0/24`` for IPv4, ``ipv6`` for IPv6, else ``invalid``."""
    return F.when(address.rlike(rf"^{_FOUR}$"), F.concat(F.substring_index(address, ".", 3), F.lit(".0/24"))).when(is_address6(address), F.lit("ipv6")).otherwise(F.lit("invalid"))


def is_ipv6(address: Column) -> Column:
    return F.coalesce(F.contains(address, F.lit(":")) & is_address6(address), F.lit(False))  # most addresses are plain IPv4


def masked_template(message: Column) -> Column:
    """A log message with its variable parts masked."""
    out = F.regexp_replace(message, r"\b(\d{1,3}\.){3}\d{1,3}\b", "<ip>")
    out = F.regexp_replace(out, r"\b0x[0-9a-fA-F]+\b|\b[0-9a-f]{8,}\b", "<hex>")
    return F.regexp_replace(out, r"\d+", "<n>")


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-even rounding by scaled ``rint``; minus zero becomes zero."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale + F.lit(0.0)
