"""Cutting lineage at a table that several branches of a plan read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where it names none,
    one in the warehouse, which the executors share as well."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_settled").rstrip("/")


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def settled_path(df: DataFrame, by: tuple[str, ...] = ()) -> str:
    """Write ``df`` as Parquet in the shared folder, partitioned by the columns ``by``;
    held and deleted like other settled tables."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    target, files = _at(spark, path)
    files.deleteOnExit(target)
    _held.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.partitionBy(*by).parquet(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; a Spark
    job at call time.

    Used where the small result of a long plan feeds several branches: bars built
    from ticks, trades that five joins look up. Without it each branch would run
    the long plan again. The table survives lost executors, is read with column
    pruning, and its size is known to the planner. It is there until ``release``, the
    end of the ``settling`` block, or of the application.
    """
    return df.sparkSession.read.schema(df.schema).parquet(settled_path(df))


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables that ``settle`` wrote in this application, but for the first
    ``keep``. What reads them must be done."""
    held = _held.get(spark.sparkContext.applicationId, [])
    for path in held[keep:]:
        target, files = _at(spark, path)
        files.delete(target, True)
    del held[keep:]


@contextmanager
def settling(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was settled inside; use results before that."""
    before = len(_held.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, keep=before)
