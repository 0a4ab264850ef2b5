"""Tables written into the folder that driver and executors share.

A written table cuts a plan's lineage and survives lost executors. Its place is
``spark.checkpoint.dir``; only where no such setting exists and the session runs on one
machine (tests) a folder is made and set as the session's checkpoint folder. A cluster
without the setting is an error, as its machines wouldn't see each other's files.
"""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folio-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


class Workspace:
    """Named scratch tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return the written rows."""
        self._n += 1
        to = self.path(f"{self._n:03d}-{name}")
        df.write.parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        self._paths[id(out)] = to
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by table() that nothing reads any more."""
        at = self._paths.pop(id(df), None)
        if at:
            self._delete(at)

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def write_bytes(self, name: str, data: bytes) -> str:
        """A small file in the shared folder; returns its path."""
        sc = self.spark.sparkContext
        at = self.path(name)
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(data)
        finally:
            out.close()
        return at
