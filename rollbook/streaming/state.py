"""The last row of every key of a stream, as a log of sorted-out runs.

A batch writes one run: the rows of the keys that it moved, in folders by hash bucket.  Runs are never changed.
Once ``FAN`` runs of a level have gathered, a later batch merges them into one of the next level, in
which a key has one row, and removes them.  So what is written follows the batches (every row is
rewritten once per level), what is kept stays near the size of the state, and a batch reads the buckets of its own keys only.

A run counts once its write was committed.  Rows that stand in two runs, as after a failure between merging and
removing, do no harm: the one with the newest stamp is the state, and equal stamps are equal rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook import model

#: Folders of a run; runs of a level that are merged into one.
BUCKETS, FAN = 64, 4
KEY = ("source", "row_key")
STATE = f"source string, row_key string, stamp string, fields {model.FIELDS}"


class Run(NamedTuple):
    """Batches ``first`` to ``last``, merged ``level`` times."""

    level: int
    first: int
    last: int

    @property
    def folder(self) -> str:
        return f"run-{self.level}-{self.first}-{self.last}"

    def holds(self, other: Run) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


def bucket_of() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")


class KeyedState:
    """Runs below ``path``, for one writer that numbers its batches upwards."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self, before: int | None = None) -> list[Run]:
        """Committed runs of batches below ``before``, oldest first, without those that a merged run holds."""
        path, files = self._hadoop()
        if not files.exists(path):
            return []
        named = [s.getPath().getName().split("-") for s in files.listStatus(path)]
        found = [Run(*map(int, n[1:])) for n in named if len(n) == 4 and n[0] == "run"]
        done = [r for r in found if (before is None or r.last < before) and files.exists(self._hadoop(r.folder, "_SUCCESS")[0])]
        return sorted((r for r in done if not any(o.holds(r) for o in done)), key=lambda r: r.first)

    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], f"{STATE}, bucket int")
        # Folders as paths, so that the buckets stay partitions that a filter prunes.
        tables = [self.spark.read.schema(f"{STATE}, bucket int").parquet(f"{self.path}/{r.folder}") for r in runs]
        whole = tables[0]
        for table in tables[1:]:
            whole = whole.unionByName(table)
        return whole

    def _newest(self, rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by, *KEY).agg(F.max("stamp").alias("stamp"), F.max_by("fields", "stamp").alias("fields"))

    def read(self, before: int | None = None) -> DataFrame:
        """``source, row_key, stamp, fields``: the newest row of every key."""
        return self._newest(self._read(self.runs(before))).select(*KEY, "stamp", "fields")

    def read_for(self, keys: DataFrame, batch: int) -> DataFrame:
        """The state that batches before ``batch`` left of ``keys``; reads the buckets that these fall into."""
        runs = self.runs(batch)
        if not runs:
            return self.read(batch)
        touched = [r.bucket for r in keys.select(bucket_of().alias("bucket")).distinct().collect()]  # BUCKETS numbers at most
        rows = self._read(runs).where(F.col("bucket").isin(touched)).join(keys.select(*KEY).distinct(), list(KEY), "left_semi")
        return self._newest(rows).select(*KEY, "stamp", "fields")

    def _write(self, rows: DataFrame, run: Run) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{run.folder}")

    def write(self, rows: DataFrame, batch: int) -> None:
        """The rows of the keys that ``batch`` moved; the same again if it is repeated."""
        placed = rows.select(*KEY, "stamp", "fields", bucket_of().alias("bucket"))
        self._write(placed.repartition("bucket"), Run(0, batch, batch))

    def merge(self, batch: int) -> None:
        """Merge what is due among the runs before ``batch`` and remove what merged runs hold.

        Batches below the one that runs now are done with and are not repeated, so none of them is needed alone.
        """
        while True:
            kept = self.runs(batch)
            self._remove_all_but(kept, batch)
            due = next((same for level in sorted({r.level for r in kept}) if len(same := [r for r in kept if r.level == level]) >= FAN), None)
            if due is None:
                return
            rows = self._read(due).repartition("bucket")
            self._write(self._newest(rows, "bucket").select(*KEY, "stamp", "fields", "bucket"), Run(due[0].level + 1, due[0].first, due[-1].last))

    def _remove_all_but(self, kept: list[Run], batch: int) -> None:
        path, files = self._hadoop()
        if not files.exists(path):
            return
        for status in files.listStatus(path):
            parts = status.getPath().getName().split("-")
            if len(parts) == 4 and parts[0] == "run" and int(parts[3]) < batch and Run(*map(int, parts[1:])) not in kept:
                files.delete(status.getPath(), True)
