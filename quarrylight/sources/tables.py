"""Tables that end lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that made_in() listens for.
_listeners: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a folder of its own; others have no folder
    that all executors share and must name one."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = f"file://{tempfile.mkdtemp(prefix='quarrylight-')}"
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """Where a table of this application may be written."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for heard in _listeners:
        heard.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


@contextmanager
def made_in() -> Iterator[list[str]]:
    """The list that the paths of tables made inside are added to."""
    heard: list[str] = []
    _listeners.append(heard)
    try:
        yield heard
    finally:
        _listeners[:] = [x for x in _listeners if x is not heard]


def delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialize returned and that nothing will read again."""
    for t in tables:
        delete(t.sparkSession, t.table_path)
    settle(tables[0].sparkSession)


def settle(spark: SparkSession) -> None:
    """Files of shuffles go when the driver's JVM finds that nothing refers to them any more: ask it to look, after tables
    that end lineage were written."""
    spark._jvm.System.gc()


def drop_tables(spark: SparkSession) -> bool:
    """Delete what this application has materialised; results that were not written elsewhere can't be read any more."""
    return delete(spark, f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}")
