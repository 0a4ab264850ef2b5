"""A folder of files read again only where it changed.

A scan's signature is each file's path, time of change and length, from the file system alone. Rows of a file
are written under the number of the scan that read it, so a scan writes no more than what it
read; the signature says which number holds for each file. It is written last: a scan that
was cut off is done again under the same number.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILES = "path string, modified timestamp, size long, read_in long, scan long"


def signature(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size) of the files below a folder whose names fit; their contents aren't read.
    Files without content aren't seen."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, modified, size, status): new, changed, same or gone; modified and size as they are now."""
    old = before.select("path", F.col("modified").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_old"))
    both = now.withColumn("_now", F.lit(True)).join(old, "path", "full")
    same = (F.col("modified") == F.col("_m")) & (F.col("size") == F.col("_s"))
    status = F.when(F.col("_now").isNull(), "gone").when(F.col("_old").isNull(), "new").when(same, "same").otherwise("changed")
    return both.select("path", "modified", "size", status.alias("status"))


def _known(spark: SparkSession, store: str) -> tuple[DataFrame, int]:
    """Files of the last scan, and its number; none and -1 before the first."""
    try:
        files = spark.read.schema(_FILES).parquet(f"{store}/files")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _FILES), -1
    last = files.agg(F.max("scan")).first()[0]
    return (files.where(F.col("scan") == last), last) if last is not None else (files, -1)


def refresh(spark: SparkSession, folder: str, store: str, parse: Callable[[DataFrame], DataFrame], pattern: str = "*") -> dict[str, int]:
    """Scan a folder into a store; numbers of files by status.

    parse: (path, content as bytes) of files to the rows kept of them, with ``path`` among the columns; a
    file may give none. Only new and changed files are opened. Their paths go by the driver, which
    lists the folder anyway. Where nothing changed nothing is written.
    """
    before, last = _known(spark, store)
    found = compare(signature(spark, folder, pattern), before).persist()
    try:
        counts = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
        if set(counts) <= {"same"}:
            return counts
        number = last + 1
        paths = [r["path"] for r in found.where("status in ('new', 'changed')").select("path").collect()]
        if paths:
            opened = spark.read.format("binaryFile").load(paths).select("path", "content")
            parse(opened).write.mode("overwrite").parquet(f"{store}/rows/scan={number}")
        here = found.where("status <> 'gone'").join(before.select("path", F.col("read_in").alias("_r")), "path", "left")
        read_in = F.when(F.col("status") == "same", F.col("_r")).otherwise(F.lit(number)).cast("long")
        here.select("path", "modified", "size", read_in.alias("read_in")).write.mode("overwrite").parquet(f"{store}/files/scan={number}")
        return counts
    finally:
        found.unpersist()


def current(spark: SparkSession, store: str) -> DataFrame:
    """Rows of the files as they were at the last scan."""
    files, _ = _known(spark, store)
    rows = spark.read.parquet(f"{store}/rows")
    return rows.join(files.select("path", F.col("read_in").alias("scan")), ["path", "scan"], "left_semi").drop("scan")
