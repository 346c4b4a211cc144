"""Tables between the steps of a job, in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for removing a query's shuffle files when the query has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a temporary folder serves if driver and executors are one process; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="cellmend-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/cellmend-{uuid.uuid4().hex}"


_LOCAL = threading.local()


@contextmanager
def temporary() -> Iterator[None]:
    """What this thread stores inside goes at the end: results that are still to be read then must have been."""
    made, before = [], getattr(_LOCAL, "made", None)
    _LOCAL.made = made
    try:
        yield
    finally:
        _LOCAL.made = before
        for scratch in made:
            scratch.clear()


class Scratch:
    """A job's stored tables by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.paths = spark, shared_folder(spark), {}
        if (made := getattr(_LOCAL, "made", None)) is not None:
            made.append(self)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write a Parquet table and read it back: cuts lineage, survives lost executors, has a known size. The shuffle files of the
        steps that the table replaces go with them; a table of the same name stays until it is dropped."""
        path = f"{self.top}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_TIDY, before)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the tables of these names; nothing may read them any more."""
        for name in names:
            for path in self.paths.pop(name, []):
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def clear(self) -> None:
        """Remove all of the job's tables; nothing may read them any more."""
        self.drop(*list(self.paths))


def stored(df: DataFrame) -> DataFrame:
    """One table on its own, kept until the shared folder is cleared."""
    return Scratch(df.sparkSession).put("table", df)
