"""Feature tables kept by replica and by what they were made from."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NotEnoughSpace(OSError):
    """A file system has less room than a job needs."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def free_bytes(spark: SparkSession, path: str) -> int:
    """Room that the file system of a folder says it has."""
    at, fs = _path(spark, path)
    return int(fs.getStatus(at).getRemaining())


def require_free(spark: SparkSession, path: str, needed: int) -> None:
    """``NotEnoughSpace`` if the folder's file system has less room than that; writing at all is not begun."""
    there = free_bytes(spark, path)
    if there < needed:
        raise NotEnoughSpace(f"{path}: {needed} bytes are needed, {there} are free")


def fingerprint_of_files(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of all files under a path, as a digest; no file is read."""
    at, fs = _path(spark, path)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toUri().getPath(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def fingerprint_of_code(*functions: Callable) -> str:
    return hashlib.sha256("".join(inspect.getsource(f) for f in functions).encode()).hexdigest()


def version_of(code: str, source: str, settings: dict) -> str:
    """What a replica's features were made from: code, input and settings."""
    return hashlib.sha256(json.dumps([code, source, settings], sort_keys=True).encode()).hexdigest()[:16]


def _stored(spark: SparkSession, folder: str) -> dict[str, set[str]]:
    """Versions of each replica whose writing ended."""
    at, fs = _path(spark, f"{folder}/done/replica=*/version=*")
    found: dict[str, set[str]] = {}
    for status in fs.globStatus(at) or []:
        own = status.getPath()
        replica = spark._jvm.java.net.URLDecoder.decode(own.getParent().getName().partition("=")[2], "UTF-8")
        found.setdefault(replica, set()).add(own.getName().partition("=")[2])
    return found


def _forget(spark: SparkSession, folder: str) -> None:
    at, fs = _path(spark, folder)
    fs.delete(at, True)


def build_or_load(spark: SparkSession, folder: str, versions: dict[str, str], build: Callable[[list[str]], DataFrame]) -> tuple[DataFrame, list[str]]:
    """The features of the replicas in their versions, and the replicas that had to be built.

    ``build`` gets all replicas that are missing or stale and returns their rows
    with ``replica``; they are written in one job, a partition each, and other
    partitions are left as they are. A replica counts as stored once its marker
    is written after its rows, so a job that breaks off leaves nothing half
    stored. Versions no longer asked for go.
    """
    quoted = {r: spark._jvm.java.net.URLEncoder.encode(r, "UTF-8") for r in versions}
    there = _stored(spark, folder)
    stale = sorted(r for r, v in versions.items() if v not in there.get(r, ()))
    if stale:
        names = spark.createDataFrame([(r, versions[r]) for r in stale], "replica string, version string")
        rows = build(stale).join(F.broadcast(names), "replica")  # a row a replica
        rows.write.partitionBy("replica", "version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/rows")
        for r in stale:
            for old in there.get(r, ()):
                _forget(spark, f"{folder}/done/replica={quoted[r]}/version={old}")
            at, fs = _path(spark, f"{folder}/done/replica={quoted[r]}/version={versions[r]}")
            fs.mkdirs(at)
    found = spark.read.parquet(f"{folder}/rows").withColumns({"replica": F.col("replica").cast("string"), "version": F.col("version").cast("string")})
    wanted = [(F.col("replica") == r) & (F.col("version") == v) for r, v in versions.items()]
    chosen = wanted[0]
    for w in wanted[1:]:
        chosen = chosen | w
    return found.where(chosen).drop("version"), stale
