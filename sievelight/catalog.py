"""All registered queries and their SQL, by name."""

from __future__ import annotations

from .plans import base, comparison, evaluation, features, profiles, protocol, records, streams, telemetry  # noqa: F401

FLAGSHIP = "host_windows"


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLE_SQL)
