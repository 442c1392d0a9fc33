"""Two ways to follow an archive.

A removal is only known once a snapshot is complete, so :func:`follow_catalog`
waits for catalogue rows and compares whole snapshots.  :func:`follow_rows`
keeps the last state of every key as a table and reports additions and changes as rows arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from rollbook import model
from rollbook.operators import snapshots as sn
from rollbook.operators.history import nth_newest
from rollbook.plans.archive import Archive
from rollbook.session import scratch
from rollbook.streaming.state import KEY, KeyedState

_EVENTS = (
    f"source string, row_key string, stamp string, kind string, columns array<string>, row {model.FIELDS}, previous {model.FIELDS}"
)


def record_events(archive: Archive, source: str, stamp: str) -> dict[str, int] | None:
    """Events of one committed snapshot against the one before it; None if already done."""
    done = archive.change_runs().filter((F.col("source") == source) & (F.col("stamp") == stamp))
    if not done.isEmpty():
        return None
    earlier = archive.catalog().filter((F.col("source") == source) & (F.col("stamp") < stamp))
    before = nth_newest(earlier).first()
    return archive.record_changes(source, before["stamp"] if before else "", stamp)


def follow_catalog(archive: Archive, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Record the events of every snapshot whose catalogue row arrives.

    A batch that is repeated after a failure records nothing twice.  The rows of
    a batch are catalogue rows, one per snapshot, so listing them is cheap.
    """
    arrivals = archive.records("snapshot_catalog").stream()

    def on_batch(batch: DataFrame, _: int) -> None:
        for header in batch.select("source", "stamp").distinct().orderBy("stamp", "source").collect():
            with scratch(archive.spark):
                record_events(archive, header["source"], header["stamp"])

    writer = arrivals.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def _fresh(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The first row of every key and stamp that is newer than the state, with the row ``previous`` to it."""
    firsts = rows.groupBy(*KEY, "stamp").agg(F.min_by("fields", "ordinal").alias("row"))
    known = state.select(*KEY, F.col("stamp").alias("seen"), F.col("fields").alias("last"))
    fresh = firsts.join(known, list(KEY), "left").filter(F.col("seen").isNull() | (F.col("stamp") > F.col("seen")))
    order = Window.partitionBy(*KEY).orderBy("stamp")
    return fresh.withColumn("previous", F.coalesce(F.lag("row").over(order), "last"))


def _events(fresh: DataFrame) -> DataFrame:
    return sn.classify(fresh, [*KEY, "stamp"]).filter((F.col("kind") != "changed") | (F.size("columns") > 0))


def _after(fresh: DataFrame) -> DataFrame:
    """The state of the keys that moved."""
    return fresh.groupBy(*KEY).agg(F.max("stamp").alias("stamp"), F.max_by("row", "stamp").alias("fields"))


def follow_rows(rows: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Write additions and changes of a stream ``source, stamp, row_key, ordinal, fields`` below ``path``.

    Of several rows with one key and stamp the first counts; rows no newer than the
    state are ignored.  Removals are not known here, whatever the register.  Every batch reads the state of
    its own keys as the batches before left it and writes its events and the keys it moved under its own
    number, so a batch that is repeated after a failure gives the same again.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        state = KeyedState(batch.sparkSession, f"{path}/state")
        state.merge(number)
        # Read by events and state; lost blocks are computed again.
        fresh = _fresh(batch, state.read_for(batch, number)).persist()
        try:
            _events(fresh).write.mode("overwrite").parquet(f"{path}/events/batch={number}")
            state.write(_after(fresh), number)
        finally:
            fresh.unpersist()

    writer = rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def read_row_state(spark: SparkSession, path: str) -> DataFrame:
    """The last row of every key that :func:`follow_rows` has seen: ``source, row_key, stamp, fields``."""
    return KeyedState(spark, f"{path}/state").read()


def read_row_changes(spark: SparkSession, path: str) -> DataFrame:
    """The events that :func:`follow_rows` has written: ``source, row_key, stamp, kind, columns, row, previous``."""
    return spark.read.schema(_EVENTS).parquet(f"{path}/events")
