"""Shared-folder materialisation.

Intermediate tables that several jobs read are written as Parquet below
``spark.checkpoint.dir``: every executor sees that folder, so a lost executor
costs a task and never the table, and the lineage is cut.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named, a temporary one on a single machine (tests), and an error elsewhere."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strokeflow-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def release(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage.

    Spark deletes broadcasts and shuffle files that nothing refers to only
    then, and the heap, which many small plans fill up to its limit, shrinks.
    """
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the DataFrame that rereads it; what plans before it held is released first, so that shuffle files don't add up."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    release(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read any more."""
    for df in written:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int = 1 << 20) -> Iterator[None]:
    """What runs inside hands at most so many rows, and about ``size`` bytes, at a time to Python: wide rows make large batches, in the JVM as in the worker."""
    key = "spark.sql.execution.arrow."
    wanted = {f"{key}maxRecordsPerBatch": str(rows), f"{key}maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
