"""What the corpus operators share: shared-folder tables and package shipping."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, new_folder, scratch, shared_dir, staged  # noqa: F401

#: Places of the bitmap that spares rows without a partner a shuffle: 8 MB, whatever the input.
SIEVE_BITS = 1 << 26

def without(columns: list[str], taken: Iterable[str]) -> list[str]:
    """The columns whose names do not clash with the taken ones; Spark's names do not tell cases apart."""
    names = {t.lower() for t in taken}
    return [c for c in columns if c.lower() not in names]


def sieved(rows: DataFrame, wanted: DataFrame, on: list[str], to: str = "_may") -> DataFrame:
    """Add whether a row may have a partner in ``wanted``: true for all that have one and a few others.

    A bitmap over hashes of the keys decides. It is broadcast in pieces of 4 KB
    with ``SIEVE_BITS`` places in all, so its size has a fixed bound.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(SIEVE_BITS)) + 1
    at = F.bitmap_bit_position(place)
    pieces = wanted.groupBy(F.bitmap_bucket_number(place).alias("_piece")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    octet = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("_piece", F.bitmap_bucket_number(place)).join(F.broadcast(pieces), "_piece", "left")
    joined = joined.withColumns({"_octet": octet, "_bit": (at % 8).cast("int")})
    return joined.select(*rows.columns, F.coalesce(F.expr("shiftright(_octet, _bit) & 1") == 1, F.lit(False)).alias(to))


def with_partner(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys are in ``wanted``; only rows that may be are shuffled."""
    return sieved(rows, wanted, on).where("_may").drop("_may").join(wanted.select(*on), on, "left_semi").select(*rows.columns)


def without_partner(rows: DataFrame, unwanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys are not in ``unwanted``; only rows that may be are shuffled."""
    marked = sieved(rows, unwanted, on)
    likely = marked.where("_may").drop("_may").join(unwanted.select(*on), on, "left_anti").select(*rows.columns)
    return marked.where("NOT _may").drop("_may").unionByName(likely)


#: Rows and bytes of one Arrow batch between Spark and Python: texts may be long, and each task holds a few batches.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per session, and bound the session's Arrow batches."""
    sc = spark.sparkContext
    for key, most in ARROW_BATCH.items():
        if int(spark.conf.get(key, most)) > int(most):
            spark.conf.set(key, most)
    if getattr(sc, "_sievelight_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="sievelight-code-"), "sievelight_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._sievelight_shipped = True
