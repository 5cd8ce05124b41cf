"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on, and the adaptive ones the plans rely on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="shelfline-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below `spark.checkpoint.dir` that every executor can reach.

    Only a local session, where driver and executors share one machine, may go
    without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = _local_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_scope: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what `stage` writes inside.

    For jobs that have stored their results by then. A lazy result reads staged tables when it
    is used; whoever asks for it inside an own scope ends the scope after that.
    """
    token = _scope.set([])
    try:
        yield
    finally:
        paths = _scope.get() or []
        _scope.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The copy is columnar, survives lost executors and cuts the lineage, so two
    passes over it see the same rows in the same places.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
