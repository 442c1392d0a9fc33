"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import atexit
import contextvars
import functools
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, *, app: str = "rollbook", memory: str = "16g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str, *, root: str | None = None) -> str:
    """A fresh path for a table that later stages read back.

    The parent is ``root``, or else the folder that ``spark.checkpoint.dir`` names, which
    every executor can reach.  Where neither is given the path is a temporary folder, but
    only if driver and executors are one process; a cluster without a shared folder is refused.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def _one_process(spark: SparkSession) -> bool:
    master = spark.conf.get("spark.master", "local")
    return master == "local" or master.startswith("local[")


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="rollbook-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


#: Paths that are removed at the end of the innermost :func:`scratch` of this thread; None outside of one.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Intermediates that are written inside are removed at the end, also on a cluster, where nothing else removes them.

    For jobs that have written their results by then; a DataFrame that outlives the block must not read an intermediate.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, purpose: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Used where two branches of a plan need one expensive intermediate.  The table
    survives the loss of executors, which a cached or locally checkpointed plan
    does not.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    if _written.get() is not None:
        _written.get().append(path)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
