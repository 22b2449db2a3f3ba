"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application, for sessions that name none, as in tests.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='depthlake-')}")
    return found.rstrip("/")


#: Paths that the innermost cleared() of each thread will delete.
_made = threading.local()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_made, "paths", None) is not None:
        _made.paths.append(path)
    return path


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes what this thread stores in the shared folder meanwhile, for work that leaves nothing that is yet to be read, such as a micro-batch that has written its results."""
    outer = getattr(_made, "paths", None)
    _made.paths = []
    try:
        yield
    finally:
        paths, _made.paths = _made.paths, outer
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once in the shared folder and read back: what reads it more than once doesn't evaluate it again, and its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
