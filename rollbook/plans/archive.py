"""A dated archive of register snapshots and the events between them.

Two Parquet tables below one root, ``snapshots`` and ``changes``, partitioned by
register and stamp, and records of what was done: ``snapshot_catalog``, ``change_runs``, ``retired`` and ``run_log``.  Data
are written first, the catalogue row last, and readers start from the catalogue;
a half-written snapshot is therefore never seen.  Of several writers of one stamp the first claims it; the others are refused.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook import model
from rollbook.functions import keys
from rollbook.operators import history
from rollbook.operators import snapshots as sn
from rollbook.operators.flatten import column_names
from rollbook.plans.records import Records, Taken
from rollbook.session import materialise


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(microsecond=0)


def utc_stamp(now: dt.datetime | None = None) -> str:
    return (now or utc_now()).strftime("%Y%m%dT%H%M%SZ")


def iso_time(now: dt.datetime | None = None) -> str:
    return (now or utc_now()).strftime("%Y-%m-%dT%H:%M:%SZ")


class SnapshotExists(RuntimeError):
    """An archived answer is never overwritten."""


class DigestMismatch(RuntimeError):
    """The rows of a snapshot are not those that were archived."""


_RECORDS = {
    "snapshot_catalog": model.SNAPSHOT_CATALOG, "change_runs": model.CHANGE_RUNS, "retired": model.RETIRED, "run_log": model.RUN_LOG,
}


class Archive:
    """Tables below ``root``, a folder every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- tables --------------------------------------------------------------

    def _path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self._path(name)
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def records(self, name: str) -> Records:
        return Records(self.spark, self._path(name), _RECORDS[name])

    def _partition(self, name: str, source: str, stamp: str) -> str:
        return self._path(name, f"source={source.replace(':', '%3A')}", f"stamp={stamp}")

    def catalog(self) -> DataFrame:
        """Headers of all snapshots that were committed and not retired."""
        listed, retired = self.records("snapshot_catalog").read(), self.records("retired").read()
        return listed.join(F.broadcast(retired), ["source", "stamp"], "left_anti")

    def snapshots(self) -> DataFrame:
        return self._table("snapshots", model.SNAPSHOTS)

    def changes(self) -> DataFrame:
        return self._table("changes", model.CHANGES)

    def change_runs(self) -> DataFrame:
        return self.records("change_runs").read()

    def run_log(self) -> DataFrame:
        return self.records("run_log").read()

    def header(self, source: str, stamp: str):
        """One catalogue row, or None."""
        return self.catalog().filter((F.col("source") == source) & (F.col("stamp") == stamp)).first()

    def latest(self, source: str, n: int = 1):
        """The ``n``-th newest catalogue row of a register, or None."""
        return history.nth_newest(self.catalog().filter(F.col("source") == source), n).first()

    # -- snapshots -----------------------------------------------------------

    def write_snapshot(
        self,
        source: str,
        rows: DataFrame,
        *,
        stamp: str | None = None,
        key_columns: Sequence[str] | None = None,
        meta: Mapping[str, object] | None = None,
        captured_at: str | None = None,
    ):
        """Archive ``rows`` (``ordinal, fields``) and return the catalogue row.

        The rows are evaluated once, by the write.  Digest, counts and column
        names are taken from the narrow columns of the written partition.
        """
        stamp = stamp or utc_stamp()
        register = model.register(source)
        key_columns = list(register.key_columns if key_columns is None else key_columns)
        if self.header(source, stamp):
            raise SnapshotExists(f"{source} already has a snapshot {stamp}")
        try:
            self.records("snapshot_catalog").claim(self._claim(source, stamp))
        except Taken:
            raise SnapshotExists(f"{source} {stamp} is being written, or was by a run that broke off and has not released it") from None
        try:
            row = self._written(source, stamp, register, rows, key_columns, meta, captured_at)
            self.records("snapshot_catalog").append([row])
        except BaseException:
            self.release(source, stamp)
            raise
        return self.header(source, stamp)

    def _claim(self, source: str, stamp: str) -> str:
        return f"{source.replace(':', '%3A')}-{stamp}"

    def release(self, source: str, stamp: str) -> None:
        """Let a stamp be written again that a run claimed and, killed, did not commit."""
        if self.header(source, stamp) is None:
            self.records("snapshot_catalog").release(self._claim(source, stamp))

    def _written(self, source: str, stamp: str, register, rows: DataFrame, key_columns: list[str], meta: Mapping[str, object] | None, captured_at: str | None) -> tuple:
        """Write the rows of a snapshot; its catalogue row."""
        path = self._partition("snapshots", source, stamp)
        keyed = sn.with_keys(rows.select("ordinal", "fields"), key_columns)
        # Rows of one shape share the text of their column names, which Parquet
        # stores once; listing the columns then reads no maps.
        named = keyed.withColumn("names", F.array_join(F.map_keys("fields"), keys.KEY_SEPARATOR))
        named.select("row_key", "ordinal", "diff_hash", "row_hash", "names", "fields").write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(model.SNAPSHOT_ROWS).parquet(path)
        digest = sn.body_digest(written).first()
        duplicates = sn.duplicate_keys(written).first()["duplicate_keys"]
        meta = dict(meta or {})
        return (
            source,
            stamp,
            captured_at or iso_time(),
            digest["row_count"] or 0,
            duplicates or 0,
            digest["body_digest"],
            key_columns,
            str(meta.get("select") or ""),
            str(meta.get("query") or ""),
            _listed_columns(written),
            list(meta.get("warnings") or []),
            str(meta.get("run_id") or ""),
            register.title,
            register.jurisdiction,
            register.docs_url,
            register.cadence_hours,
            register.data_licence,
        )

    def read_snapshot(self, source: str, stamp: str, *, verify: bool = True) -> DataFrame:
        """Rows of one committed snapshot, after checking their digest."""
        header = self.header(source, stamp)
        if header is None:
            raise FileNotFoundError(f"no snapshot {stamp} of {source}")
        rows = self._rows(source, stamp)
        if verify:
            found = _recomputed(rows).first()
            if found["body_digest"] != header["body_digest"]:
                raise DigestMismatch(f"{source} {stamp}: recorded {header['body_digest'][:16]}, found {found['body_digest'][:16]}")
        return rows

    def _rows(self, source: str, stamp: str) -> DataFrame:
        return self.snapshots().filter((F.col("source") == source) & (F.col("stamp") == stamp))

    def verify(self) -> DataFrame:
        """``source, stamp, ok, reason`` for all snapshots, in one job.

        Digests are recomputed from the fields.  Rows without a header and headers
        without rows both show.
        """
        retired = self.records("retired").read()
        # Records are few; exchanged by stamp, all rows of a snapshot would meet in one task.
        kept = self.snapshots().join(F.broadcast(retired), ["source", "stamp"], "left_anti")
        data = _recomputed(kept, "source", "stamp")
        recorded = self.catalog().select("source", "stamp", F.col("body_digest").alias("recorded"), F.col("row_count").alias("expected"))
        joined = data.join(recorded, ["source", "stamp"], "full_outer")
        empty = (F.col("expected") == 0) & F.col("body_digest").isNull()
        reason = (
            F.when(F.col("recorded").isNull(), "no catalogue entry")
            .when(empty, "ok")
            .when(F.col("body_digest").isNull(), "no rows")
            .when(F.col("body_digest") != F.col("recorded"), "digest differs")
            .otherwise("ok")
        )
        return joined.select("source", "stamp", (reason == "ok").alias("ok"), reason.alias("reason"))

    # -- events --------------------------------------------------------------

    def diff(self, source: str, old_stamp: str, new_stamp: str) -> DataFrame:
        """Events between two archived snapshots.

        Only keys and hashes of the two partitions are joined; full rows are
        fetched for the keys that moved.  The moved keys are written once, so
        their number is known before they are joined.
        """
        narrow = ["row_key", "ordinal", "row_hash", "diff_hash"]
        headers = {stamp: self.header(source, stamp) for stamp in (old_stamp, new_stamp)}
        for stamp, header in headers.items():
            if header is None:
                raise FileNotFoundError(f"no snapshot {stamp} of {source}")

        def firsts(stamp: str, prefix: str) -> DataFrame:
            rows = self._rows(source, stamp).select(*narrow)
            if headers[stamp]["duplicate_keys"]:
                rows = sn.first_copies(rows)
            at = F.struct("ordinal", "row_hash").alias(f"{prefix}_at")
            return rows.select("row_key", at, F.col("diff_hash").alias(f"{prefix}_hash"))

        pairs = firsts(old_stamp, "old").join(firsts(new_stamp, "new"), "row_key", "full_outer")
        moved = materialise(
            pairs.filter(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select("row_key", "old_at", "new_at"), "moved"
        )

        def full(stamp: str, prefix: str, name: str) -> DataFrame:
            if not headers[stamp]["duplicate_keys"]:
                # The key alone tells the row, and there are no copies.
                mine = moved.filter(F.col(f"{prefix}_at").isNotNull()).select("row_key")
                return self._rows(source, stamp).select("row_key", F.col("fields").alias(name)).join(mine, "row_key", "left_semi")
            at = F.struct("ordinal", "row_hash").alias(f"{prefix}_at")
            rows = self._rows(source, stamp).select("row_key", at, F.col("fields").alias(name))
            rows = rows.join(moved.select("row_key", f"{prefix}_at"), ["row_key", f"{prefix}_at"], "left_semi")
            # Rows that agree in key, place and hash are copies of each other.
            return rows.groupBy("row_key").agg(F.first(name).alias(name))

        both = full(old_stamp, "old", "previous").join(full(new_stamp, "new", "row"), "row_key", "full_outer")
        return sn.classify(both, ["row_key"])

    def record_changes(self, source: str, old_stamp: str, new_stamp: str):
        """Compare two snapshots and record the events; a first snapshot (blank ``old_stamp``) has none."""
        events = self.diff(source, old_stamp, new_stamp) if old_stamp else None
        if events is not None and not model.register(source).population:
            # Rows age out of such a window; their absence is no removal.
            events = events.filter(F.col("kind") != "removed")
        return self.append_changes(source, new_stamp, events, against=old_stamp)

    def record_missing_changes(self, source: str) -> list[str]:
        """Record the events of snapshots that were committed by runs which broke off before their events.

        The stamps that were caught up on; usually none.
        """
        stamps = sorted(r["stamp"] for r in self.catalog().filter(F.col("source") == source).select("stamp").collect())
        told = {r["stamp"] for r in self.change_runs().filter(F.col("source") == source).select("stamp").collect()}
        missing = [(old, new) for old, new in zip(["", *stamps], stamps, strict=False) if new not in told]
        for old, new in missing:
            self.record_changes(source, old, new)
        return [new for _, new in missing]

    def append_changes(self, source: str, stamp: str, changes: DataFrame | None, *, against: str = ""):
        """Record the events of one run, and the run itself even when there are none."""
        counts = {k: 0 for k in sn.KINDS}
        if changes is not None:
            path = self._partition("changes", source, stamp)
            changes.select(F.lit(against).alias("against"), "kind", "row_key", "columns", "row", "previous").write.mode(
                "overwrite"
            ).parquet(path)
            written = self.spark.read.parquet(path)
            counts = written.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in sn.KINDS]).first().asDict()
        row = (source, stamp, against, *[counts[k] for k in sn.KINDS], iso_time())
        self.records("change_runs").append([row])
        return counts

    def read_changes(self, source: str | None = None, *, since: str = "", last: int | None = None) -> DataFrame:
        """Events oldest first with ``_snapshot`` and ``_source``.

        ``since`` is any prefix of a stamp; both filters prune partitions.
        ``last`` keeps the newest events.
        """
        events = self.changes()
        if source:
            events = events.filter(F.col("source") == source)
        if since:
            events = events.filter(F.col("stamp") >= since)
        rank = sn.kind_rank(F.col("kind"))
        if last:
            events = events.orderBy(F.desc("stamp"), F.desc(rank), F.desc("row_key"), F.desc("source")).limit(last)
        tagged = events.withColumn("_snapshot", F.col("stamp")).withColumn("_source", F.col("source"))
        return tagged.orderBy("stamp", rank, "row_key", "source")

    def summarise(self, source: str, old_stamp: str, new_stamp: str) -> DataFrame:
        catalog = self.catalog().filter(F.col("source") == source)
        events = self.changes().filter((F.col("source") == source) & (F.col("stamp") == new_stamp))
        return sn.summarise(events, catalog.filter(F.col("stamp") == old_stamp), catalog.filter(F.col("stamp") == new_stamp))

    # -- retention -----------------------------------------------------------

    def retire(self, doomed: DataFrame, *, dry_run: bool = False) -> list[tuple[str, str]]:
        """Drop snapshots listed by ``plan_retention``; readers stop seeing them first."""
        listed = [(r["source"], r["stamp"]) for r in doomed.select("source", "stamp").orderBy("source", "stamp").collect()]
        if dry_run or not listed:
            return listed
        self.records("retired").append([(s, t, iso_time()) for s, t in listed])
        for source, stamp in listed:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._partition("snapshots", source, stamp))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return listed

    def log_runs(self, records: list[tuple]) -> None:
        self.records("run_log").append(records)


def _listed_columns(written: DataFrame) -> list[str]:
    """Columns in first-seen order, from the shapes of the rows."""
    shapes = written.groupBy("names").agg(F.min("ordinal").alias("ordinal")).filter("names <> ''")
    parts = F.split("names", keys.KEY_SEPARATOR)
    return column_names(shapes.select("ordinal", F.map_from_arrays(parts, parts).alias("fields")))


def _recomputed(rows: DataFrame, *by: str) -> DataFrame:
    """Digest from the stored fields, not from the stored hashes."""
    return sn.body_digest(rows.select(*by, keys.row_hash(F.col("fields")).alias("row_hash")), *by)
