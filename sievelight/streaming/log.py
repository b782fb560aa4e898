"""Appending a stream of verdicts to the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ledger import leaf_hash


def append_to(path: str):
    """A ``foreachBatch`` writer of rows ``entry``: dense places, one folder per batch, safe to repeat.

    The order within a batch is that of the entries' hashes. A batch that was
    already written is written again with the same places. Each batch records how
    many entries there are up to its end, so the next one reads one row.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = 0
        if number:
            before = spark.read.schema("until long").json(f"{path}/sizes/batch={number - 1}").first().until
        rows = batch.select("entry", leaf_hash(F.col("entry")).alias("hash")).withColumn("part", F.conv(F.substring("hash", 1, 2), 16, 10).cast("int"))
        # The first byte of the hash cuts a batch into 256 parts that are numbered side by side.
        counts = rows.groupBy("part").agg(F.count("*").alias("c"))
        line = Window.partitionBy(F.lit(0)).orderBy("part")
        offsets = counts.select("part", (F.sum("c").over(line) - F.col("c")).alias("offset"))
        place = F.row_number().over(Window.partitionBy("part").orderBy("hash")) - 1
        numbered = rows.withColumn("k", place).join(F.broadcast(offsets), "part")  # at most 256 rows
        out = numbered.select((F.lit(before) + F.col("offset") + F.col("k")).cast("long").alias("idx"), "entry", "hash")
        out.write.mode("overwrite").parquet(f"{path}/leaves/batch={number}")
        size = spark.read.parquet(f"{path}/leaves/batch={number}").agg(F.count("*").alias("size"), (F.lit(before) + F.count("*")).alias("until"))
        size.write.mode("overwrite").json(f"{path}/sizes/batch={number}")

    return write
