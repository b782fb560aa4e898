"""Records of runs: an append-only index of JSON lines, and tables made from it."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, created_utc string, fingerprint string, model string, dataset string, split string, fold string, seed int, metrics string"


class PooledDatasets(ValueError):
    """A table would mix runs on several datasets."""


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def write_run(spark: SparkSession, folder: str, config: dict, metrics: dict, fold: str = "") -> str:
    """Append a run under a folder of its own; an existing one is never written over."""
    print_ = fingerprint(config)
    run_id = f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{print_}-{fold or 'all'}-{uuid.uuid4().hex[:8]}"
    row = (run_id, datetime.now(UTC).isoformat(), print_, config.get("model"), config.get("dataset"), config.get("split"), fold, int(config.get("seed", 0)), json.dumps(metrics, sort_keys=True))
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("errorifexists").json(f"{folder}/run={run_id}")
    return run_id


def load_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(folder)


def metric(index: DataFrame, path: tuple[str, ...]) -> DataFrame:
    """Add ``value`` at a path of keys; keys may hold dots."""
    quoted = "$" + "".join(f"['{p}']" for p in path)
    return index.withColumn("value", F.get_json_object("metrics", quoted).try_cast("double"))


def cells(index: DataFrame, path: tuple[str, ...], splits: list[str]) -> DataFrame:
    """Model by split: mean and spread over seeds and folds; raises if datasets would be pooled."""
    if index.select("dataset").distinct().limit(2).count() > 1:
        raise PooledDatasets("runs on several datasets; filter to one")
    return metric(index, path).groupBy("model").pivot("split", splits).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def markdown(table: DataFrame) -> str:
    """A small table as text."""
    rows = table.collect()
    line = lambda values: "| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in values) + " |"
    return "\n".join([line(table.columns), line(["---"] * len(table.columns)), *[line(r) for r in rows]])
