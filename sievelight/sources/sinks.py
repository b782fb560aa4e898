"""Sinks of results: JSON lines behind a guard, and tables of scored uploads."""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Significant digits of exported numbers; items of a list in an exported row.
DIGITS, MOST_ITEMS = 6, 200


class ExportError(ValueError):
    """A row is not fit for export."""


def significant(x: float, digits: int = DIGITS) -> float | int:
    """A finite number in so many significant digits; a whole one as an int."""
    if not math.isfinite(x):
        raise ExportError(f"{x!r} is not finite")
    y = float(f"{x:.{digits}g}")
    return int(y) if y.is_integer() and abs(y) < 1e15 else y


def exported(value, digits: int = DIGITS, most: int = MOST_ITEMS, at: str = "row"):
    """A value as JSON may hold it: numbers in significant digits, no list over ``most`` items."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, (float, Decimal)):
        return significant(float(value), digits)
    if isinstance(value, dict):
        return {str(k): exported(v, digits, most, f"{at}.{k}") for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        if len(value) > most:
            raise ExportError(f"{at} has {len(value)} items, more than {most}: rows of the data must not be exported")
        return [exported(v, digits, most, f"{at}[]") for v in value]
    return str(value)


@dataclass
class _Part(WriterCommitMessage):
    hidden: str
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Tasks write into a hidden folder of the job; the commit shows its files, an abort deletes it.

    A task that still runs when its job is aborted finds no folder to write to.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.digits, self.most = int(options.get("digits", DIGITS)), int(options.get("mostitems", MOST_ITEMS))
        self.job = f"_job-{uuid.uuid4().hex}"
        files, top = self._files()
        files.create_dir(f"{top}/{self.job}", recursive=True)

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), os.path.abspath(self.path))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, top = self._files()
        name = f"part-{uuid.uuid4().hex}.json"
        hidden, rows = f"{top}/{self.job}/{name}", 0
        with files.open_output_stream(hidden) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(json.dumps(exported(row, self.digits, self.most), ensure_ascii=False, allow_nan=False).encode() + b"\n")
                    rows += 1
        return _Part(hidden, f"{top}/{name}", rows)

    def commit(self, messages: list) -> None:
        files, top = self._files()
        for m in messages:
            if m is not None:
                files.move(m.hidden, m.name)
        files.delete_dir(f"{top}/{self.job}")
        with files.open_output_stream(f"{top}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list) -> None:
        files, top = self._files()
        for last in (False, False, True):
            try:
                return files.delete_dir(f"{top}/{self.job}")
            except OSError:  # a task's last file came in between
                if last:
                    raise


class GuardedJson(DataSource):
    """``df.write.format("guarded_json").option("path", folder)``; options ``digits`` and ``mostItems``.

    Numbers have six significant digits, and a row with a list of more than
    ``mostItems`` items (rows of the data, likely) fails the job. Readers see
    either all files of a job or none. The folder must be of a kind that
    ``pyarrow.fs`` knows.
    """

    @classmethod
    def name(cls) -> str:
        return "guarded_json"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def scored_csv(rows: DataFrame, features: list[str]) -> DataFrame:
    """Uploaded rows with their score in six significant digits and verdict as texts, ready for ``write_csv``; features keep their order."""
    number = lambda c: F.when(F.col(c).isNotNull(), significant_text(F.col(c)))
    return rows.select("row_id", *(number(c).alias(c) for c in features), F.coalesce(number("score"), F.lit("")).alias("score"), "verdict")


def significant_text(x, digits: int = DIGITS):
    """A number as a text in significant digits, without an exponent or trailing zeros for sizes that data have."""
    size = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
    scale = F.pow(F.lit(10.0), (digits - 1 - size).cast("double"))
    near = F.rint(x * scale) / scale
    plain = F.format_string("%.12f", near + F.lit(0.0))
    return F.when(near == F.rint(near), F.format_string("%.0f", near + F.lit(0.0))).otherwise(F.regexp_replace(plain, r"\.?0+$", ""))


def write_csv(rows: DataFrame, path: str) -> None:
    """Comma-separated files with a header each; only cells that need quotes have them, doubled inside."""
    rows.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", False).option("emptyValue", "").csv(path)


def template_of(features: list[str], rows: DataFrame) -> DataFrame:
    """An upload without rows: the header of what is asked for."""
    return rows.select(*(F.lit("").alias(c) for c in [*features, "label"])).limit(0)
