"""Log lines from files: binary-safe splitting, rotation order, global line numbers, line labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class LabelJoinError(ValueError):
    """A label names a line that its file does not have."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, base, suffix, local_line, raw, text`` of all files; lines end at line feeds alone.

    One final line feed ends the last line and begins none. Bytes that are not
    UTF-8 stay in ``raw`` and are replaced in ``text``; a byte-order mark at the
    start of a file goes. Large files are read in byte ranges by many tasks: a
    line belongs to the range it begins in, ranges count their lines, and a line's
    number is its place in its range after the lines of the ranges before.
    """
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    place = F.monotonically_increasing_id()  # grows within a range
    lines = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), place.alias("place"), "value")
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = lines.groupBy("path", "range").agg(F.count("*").alias("n"))
    ranges = ranges.select("path", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("path", "range").orderBy("place"))
    numbered = lines.withColumn("inside", inside).join(ranges, ["path", "range"])
    name = F.substring_index("path", "/", -1)
    suffix = F.regexp_extract(name, r"\.(\d+)$", 1).try_cast("int")
    return numbered.select(
        "path", (F.col("before") + F.col("inside")).cast("long").alias("local_line"), F.col("value").cast("binary").alias("raw"), F.make_valid_utf8("value").alias("text"),
        F.regexp_replace(name, r"\.\d+$", "").alias("base"), F.coalesce(suffix, F.lit(0)).alias("suffix"),
    )


def line_offsets(files: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Add ``line_offset``: lines of the key's files before this one, in the given order (oldest first)."""
    return files.withColumn("line_offset", F.sum("n_lines").over(Window.partitionBy(*key).orderBy(order)) - F.col("n_lines"))


def resolve(asked: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Global lines to the file that holds them and the line in it.

    Files and asked lines of a key are put in one order, so that each line finds
    the last file that begins before it; lines are not multiplied by files.
    """
    mine, theirs = [c for c in asked.columns if c not in key], [c for c in files.columns if c not in key]
    at = files.select(*key, F.col("line_offset").alias("_at"), F.lit(0).alias("_asked"), F.struct(*theirs).alias("_file"), F.lit(None).cast(asked.select(F.struct(*mine)).schema[0].dataType).alias("_row"))
    of = asked.select(*key, F.col("global_line").alias("_at"), F.lit(1).alias("_asked"), F.lit(None).cast(at.schema["_file"].dataType).alias("_file"), F.struct(*mine).alias("_row"))
    # A file of no lines begins where the next one does; the latter holds the line.
    line = Window.partitionBy(*key).orderBy("_at", F.desc("_asked"), F.col("_file.n_lines"))
    found = at.unionByName(of).withColumn("_file", F.last("_file", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))).where("_asked = 1")
    inside = (F.col("line_offset") < F.col("global_line")) & (F.col("global_line") <= F.col("line_offset") + F.col("n_lines"))
    return found.select(*key, "_row.*", "_file.*").where(inside).withColumn("local_line", F.col("global_line") - F.col("line_offset"))


def numbered(lines: DataFrame, key: list[str]) -> DataFrame:
    """Add ``global_line`` over each key's rotated files: highest suffix first, the unsuffixed file last."""
    files = lines.groupBy(*key, "suffix").agg(F.max("local_line").alias("n_lines"))
    offsets = line_offsets(files, key, F.desc("suffix")).select(*key, "suffix", "line_offset")
    return lines.join(offsets, [*key, "suffix"]).withColumn("global_line", F.col("line_offset") + F.col("local_line")).drop("line_offset")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, labels, rules`` from JSON lines; of a file's records of one line the last wins, by its place in the file."""
    rows = spark.read.schema("line long, labels array<string>, rules map<string,array<string>>").json(path)
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))  # numbers grow within a block of a file
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "line", "labels", "rules", at.alias("at")).where("line IS NOT NULL")
    return rows.groupBy("path", "line").agg(F.max_by(F.struct("labels", "rules"), "at").alias("r")).select("path", "line", "r.labels", "r.rules")


def with_labels(lines: DataFrame, labels: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Left join of labels on the key (host and source, say) and the global line; what has no label is benign.

    ``LabelJoinError`` if a label is beyond the last line of its key's lines. Without a key all lines are of one source.
    """
    key = list(key)
    last = lines.groupBy(*key).agg(F.max("global_line").alias("n"))
    wanted = labels.groupBy(*key).agg(F.max("line").alias("line")).where("line IS NOT NULL")
    both = wanted.join(last, key, "left") if key else wanted.crossJoin(F.broadcast(last))  # one row each
    beyond = both.where("line > coalesce(n, 0)").select("line", "n").first()
    if beyond is not None:
        raise LabelJoinError(f"label line {beyond.line} is beyond the last line {beyond.n or 0}")
    own = labels.withColumnRenamed("line", "global_line").select(*key, "global_line", *(c for c in ("labels", "rules") if c in labels.columns))
    joined = lines.join(own, [*key, "global_line"], "left")
    return joined.withColumns({"labels": F.coalesce("labels", F.array().cast("array<string>")), "is_attack": F.coalesce(F.size("labels") > 0, F.lit(False))})
