"""Zip archives as a Spark data source, one partition per member, without extraction."""

from __future__ import annotations

import glob
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Member(InputPartition):
    def __init__(self, archive: str, name: str | None):
        self.archive, self.name = archive, name


class ZipReader(DataSourceReader):
    """Options: ``path`` (a file or pattern on a file system that all executors mount), ``prefix``, ``content`` (true: also lines)."""

    def __init__(self, options):
        self.options = options

    def partitions(self):
        found = []
        for archive in sorted(glob.glob(self.options["path"])):
            try:
                with zipfile.ZipFile(archive) as z:
                    found += [Member(archive, i.filename) for i in z.infolist() if not i.is_dir() and i.filename.startswith(self.options.get("prefix", ""))]
            except (zipfile.BadZipFile, OSError):
                found.append(Member(archive, None))
        return found or [Member("", None)]

    def read(self, partition):
        if not partition.archive:
            return
        archive = os.path.basename(partition.archive)
        if partition.name is None:
            yield (archive, None, None, None, None, "incomplete")
            return
        with zipfile.ZipFile(partition.archive) as z:
            size = z.getinfo(partition.name).file_size
            if self.options.get("content", "false") != "true":
                yield (archive, partition.name, size, None, None, "ok")
                return
            with z.open(partition.name) as f:
                for number, line in enumerate(f, 1):
                    yield (archive, partition.name, size, number, line.removesuffix(b"\n").decode("utf-8", "replace"), "ok")


class ZipSource(DataSource):
    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return "archive string, path string, file_size long, line long, text string, status string"

    def reader(self, schema):
        return ZipReader(self.options)


def read_zip(spark: SparkSession, path: str, prefix: str = "", content: bool = False) -> DataFrame:
    """Members of archives, or with ``content`` their lines; an archive that cannot be read is one row of status ``incomplete``."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").option("prefix", prefix).option("content", str(content).lower()).load(path)


def catalogue(members: DataFrame) -> DataFrame:
    """Files and bytes per archive and top folder."""
    return members.groupBy("archive", F.substring_index("path", "/", 1).alias("root"), "status").agg(F.count("path").alias("n_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"))
