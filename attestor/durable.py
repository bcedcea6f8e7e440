"""Tables that outlive their lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset (as in tests) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="attestor-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/attestor/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends, nothing is computed twice, and a lost
    executor costs nothing that was written."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    if _scopes:
        _scopes[-1].append(kept)
    return kept


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """keep(), and the shuffle files that df was made through are deleted when it is written: what follows reads none of them."""
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return keep(df, name)
    finally:
        conf.unset(_CLEANUP) if was is None else conf.set(_CLEANUP, was)


#: Tables kept within each open scratch().
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """At its end the tables that keep() made within it are deleted."""
    _scopes.append([])
    try:
        yield
    finally:
        drop(*_scopes.pop())


def keep_beyond(df: DataFrame, name: str) -> DataFrame:
    """keep() of a table that outlives the scratch() it is made in."""
    kept = keep(df, name)
    if _scopes:
        _scopes[-1].pop()
    return kept


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables made by keep() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_kept_at", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
