"""Texts of logs and reports: message without its timestamp, kinds of files, percentages, numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How lines of each kind begin. An audit line keeps its stamp, which is inside the message.
STAMPS = {
    "syslog": r"^[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}",
    "apache": r"^.*?\[\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\]",
    "iso": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
}
#: Folders that hold no telemetry, and the host that attacks come from.
NO_TELEMETRY = ("/configs/", "/rules/", "/downloads/")
ATTACKER = "attacker_0"


def without_stamp(line: Column, kind: Column) -> Column:
    """The line from behind its timestamp on, without the blanks and colons that follow; lines of other kinds as they are."""
    out = line
    for name, pattern in STAMPS.items():
        out = F.when((kind == name) & line.rlike(pattern), F.regexp_replace(F.regexp_replace(line, pattern, ""), "^[ :]+", "")).otherwise(out)
    return out


def file_type(path: Column) -> Column:
    """A file's name without the date before it and the number of its rotation."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"^\d{4}-\d{2}-\d{2}-", "")
    return F.regexp_replace(name, r"^(.*)\.\d+$", "$1")


def is_telemetry(path: Column) -> Column:
    """Whether a member of a bundle is telemetry of a host under attack, or a label of it."""
    parts = F.split(path, "/")
    inside = (F.size(parts) >= 3) & F.get(parts, 0).isin("gather", "labels") & (F.get(parts, 1) != ATTACKER)
    for folder in NO_TELEMETRY:
        inside = inside & ~F.contains(path, F.lit(folder))
    return F.coalesce(inside, F.lit(False))


def percent_text(k: Column, n: Column) -> Column:
    """A share as a text in tenths of a percent, rounded half up; shares that are not whole are shown as such however small the rest."""
    p = 100 * k / n
    tenths = F.floor(p * 10 + 0.5).cast("long")
    plain = F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    return F.when(n <= 0, "0%").when((k > 0) & (p < 0.05), "<0.1%").when((k < n) & (p >= 99.95), ">99.9%").otherwise(plain)


def numerals(text: Column) -> Column:
    """The decimal numerals of a text in order."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\w.])\d+(?:\.\d+)?(?![\w])"), F.lit(0))


def lognormal_parameters(mean: Column, std: Column) -> tuple[Column, Column]:
    """(mu, sigma) of the log-normal distribution with a mean and a standard deviation."""
    spread = F.log1p((std / mean) * (std / mean))
    return F.log(mean) - spread / 2, F.sqrt(spread)
