"""Places that every executor can reach, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders that are deleted with their application.
_OWNED: set[str] = set()
#: The tables written inside each open temporary_tables(), the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset (a local session, as in tests) is one made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = checkpoint.get() if checkpoint.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-evispark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def work_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one, for tables that nothing needs after it: it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/evispark-{spark.sparkContext.applicationId}"
    if path not in _OWNED:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(place)
        fs.deleteOnExit(place)
        _OWNED.add(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where its files give fewer: work on long rows then keeps all of them busy. Rows of inputs with more are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so later jobs survive lost executors without recomputing it.

    Inside temporary_tables() the table is deleted at its end, unless it outlives that; any other one with the application.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    for scope in scopes[:-1][-1:] if outlives else scopes[-1:]:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that materialize() wrote inside; those that outlive it pass to the scope around it, if any."""
    written: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), written))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in written:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
