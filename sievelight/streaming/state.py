"""What stateful streams share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which map and list states need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
