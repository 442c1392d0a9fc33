"""Questions about the snapshot catalogue: newest, due, stale, past retention.

The catalogue has one row per snapshot, so these jobs stay small whatever the
size of the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A register is fetched again once its newest snapshot is this part of its cadence old.
REFETCH_FRACTION = 0.5
#: A register is stale once its newest snapshot is this many cadences old.
STALE_CADENCES = 2.0


def stamp_time(stamp: Column) -> Column:
    """``yyyyMMddTHHmmssZ`` as a UTC timestamp, NULL for anything else."""
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmssX"))


def stamp_of(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd'T'HHmmss'Z'")


def age_hours(stamp: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(stamp_time(stamp))
    return F.when(seconds > 0, seconds / 3600.0).when(seconds.isNotNull(), 0.0)


def nth_newest(catalog: DataFrame, n: int = 1) -> DataFrame:
    """The newest (``n=1``), second newest, ... snapshot of every register."""
    order = Window.partitionBy("source").orderBy(F.desc("stamp"))
    return catalog.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == n).drop("_n")


def freshness(catalog: DataFrame, registers: DataFrame, now: Column) -> DataFrame:
    """Per register: snapshots, newest stamp and rows, age and whether it is stale.

    ``registers`` has ``key`` and ``cadence_hours``; without a cadence nothing is stale.
    """
    newest = F.max(F.struct("stamp", "captured_at", "row_count"))
    per_source = catalog.groupBy("source").agg(F.count(F.lit(1)).alias("snapshots"), newest.alias("newest"))
    cadence = registers.select(F.col("key").alias("source"), "cadence_hours")
    age = age_hours(F.col("newest.stamp"), now)
    return per_source.join(cadence, "source", "left").select(
        "source",
        "snapshots",
        F.col("newest.stamp").alias("latest"),
        F.col("newest.captured_at").alias("captured_at"),
        F.col("newest.row_count").alias("rows"),
        F.round(age, 1).alias("age_hours"),
        "cadence_hours",
        F.coalesce(age > F.col("cadence_hours") * STALE_CADENCES, F.lit(False)).alias("stale"),
    )


def due_registers(catalog: DataFrame, registers: DataFrame, now: Column, *, force: bool = False) -> DataFrame:
    """``source, status, age_hours`` with status ``due``, ``fresh`` or ``not listable``."""
    newest = catalog.groupBy("source").agg(F.max("stamp").alias("latest"))
    known = registers.select(F.col("key").alias("source"), "cadence_hours", "bulk_readable")
    age = age_hours(F.col("latest"), now)
    recent = F.coalesce(age < F.col("cadence_hours") * REFETCH_FRACTION, F.lit(False)) & F.lit(not force)
    status = F.when(~F.col("bulk_readable"), "not listable").when(recent, "fresh").otherwise("due")
    return known.join(newest, "source", "left").select("source", status.alias("status"), F.round(age, 1).alias("age_hours"))


def plan_retention(
    catalog: DataFrame, now: Column, *, keep_days: int | None, keep_last: int = 2
) -> DataFrame:
    """Snapshots to drop: older than the window and not among the newest ``keep_last``."""
    if keep_days is not None and keep_days < 0:
        raise ValueError(f"keep_days must not be negative, got {keep_days}: the cutoff would lie in the future")
    order = Window.partitionBy("source").orderBy(F.desc("stamp"))
    ranked = catalog.select("source", "stamp", F.row_number().over(order).alias("rank"))
    if keep_days is None:
        return ranked.filter(F.lit(False)).select("source", "stamp")
    old = F.unix_timestamp(stamp_time(F.col("stamp"))) < F.unix_timestamp(now) - keep_days * 86400
    return ranked.filter((F.col("rank") > max(1, keep_last)) & old).select("source", "stamp")


def archive_answer(catalog: DataFrame, source: str, *, select: str = "", query: str = "") -> DataFrame:
    """The newest snapshot if it was taken under this selection, else no row.

    A snapshot of a part cannot answer for the whole, nor an older one for today.
    """
    newest = nth_newest(catalog.filter(F.col("source") == source))
    same = (F.coalesce("select", F.lit("")) == (select or "")) & (F.coalesce("query", F.lit("")) == (query or ""))
    return newest.filter(same)
