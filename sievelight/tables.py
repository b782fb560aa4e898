"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A session without the setting (a test on one machine) gets a folder of its
    own; on a cluster the setting must be there.
    """
    sc = spark.sparkContext
    found = spark.conf.get(SHARED, None) or getattr(sc, "_sievelight_shared", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"{SHARED} must name a folder that all executors share")
        found = sc._sievelight_shared = "file://" + tempfile.mkdtemp(prefix="sievelight-")
    return found.rstrip("/")


_SCRATCH: list[str] = []


def new_folder(spark: SparkSession, name: str, lasting: bool = False) -> str:
    return "/".join([shared_dir(spark), *([] if lasting else _SCRATCH), f"{name}-{uuid.uuid4().hex[:12]}"])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are deleted at the end, but for lasting ones."""
    _SCRATCH.append(f"scratch-{uuid.uuid4().hex[:12]}")
    try:
        yield
    finally:
        _delete(spark, "/".join([shared_dir(spark), *_SCRATCH]))
        _SCRATCH.pop()


def staged(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, fixes values that depend on task order, and survives
    the loss of executors. Who stages a table deletes it with ``discard`` once
    nothing later reads it; a table that a result still reads stays.
    """
    path = new_folder(df.sparkSession, name, lasting)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame | None) -> None:
    """Delete the folders of staged tables that no later step reads."""
    for frame in frames:
        path = frame.__dict__.pop("_staged_at", None) if frame is not None else None
        if path:
            _delete(frame.sparkSession, path)
