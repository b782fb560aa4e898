"""Checking files against a manifest of sizes and SHA-256 sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ManifestError(ValueError):
    """A required file is missing or altered."""


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verified(manifest: DataFrame, sums: DataFrame) -> DataFrame:
    """Manifest rows ``name, sha256, required`` with ``status``: ok, missing or altered."""
    found = sums.select("name", F.col("sha256").alias("found"))
    joined = manifest.join(found, "name", "left")
    return joined.withColumn("status", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("altered")).drop("found")


def require(checked: DataFrame) -> DataFrame:
    """The rows again; ``ManifestError`` if a required one is not ok."""
    bad = checked.where("required AND status <> 'ok'").select("name", "status").limit(10).collect()
    if bad:
        raise ManifestError(", ".join(f"{r.name}: {r.status}" for r in bad))
    return checked
