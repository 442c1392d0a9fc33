"""Completeness, schema drift, file integrity, personal data and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.functions import keys
from rollbook.functions.text import strip
from rollbook.model import register
from rollbook.operators.filters import contains_condition
from rollbook.sources import selection

# Most records an interface hands out however one pages.
RESULT_WINDOWS = {"ctis": 10_000, "gleif": 10_000, "ch-uid": 30}


class PersonalDataRefused(PermissionError):
    """The selection is about people and was not explicitly allowed."""


def personal_data_note(source: str, select: str | None = None) -> str:
    """The note that applies to this selection; blank where it is about companies."""
    note = register(source).personal_data
    if source == "eba-psd":
        types = selection.institution_types(select)
        if types is not None and not set(types) & set(selection.DEPENDENT_TYPES):
            return ""
    return note


def personal_data_gate(rows: DataFrame, source: str, select: str | None = None, *, allow: bool = False) -> DataFrame:
    """``rows`` unchanged, or a refusal before any job runs."""
    note = personal_data_note(source, select)
    if note and not allow:
        raise PersonalDataRefused(f"{source}: {note}")
    return rows


def without_dependents(rows: DataFrame) -> DataFrame:
    """Institution rows only; agents and branches removed."""
    kind = F.coalesce(F.col("fields")["EntityType"], F.lit(""))
    return rows.filter(~kind.isin(*selection.DEPENDENT_TYPES))


def completeness(pages: DataFrame, *by: str) -> DataFrame:
    """Reported total against what was collected: ``collected, reported, missing, warning``.

    ``pages`` has one row per landed page with ``total`` (NULL where the interface
    reports none), ``records`` and optionally ``window``, the most it hands out.
    """
    window = F.max("window") if "window" in pages.columns else F.lit(None).cast("bigint")
    counts = pages.groupBy(*by).agg(
        F.sum("records").alias("collected"), F.max("total").alias("reported"), window.alias("window")
    )
    short = F.col("collected") < F.col("reported")
    full = F.col("reported").isNull() & (F.col("collected") >= F.col("window"))
    return counts.select(
        *by,
        "collected",
        "reported",
        F.greatest(F.col("reported") - F.col("collected"), F.lit(0)).alias("missing"),
        F.when(short, "fewer records than reported").when(full, "as many records as the interface hands out").alias("warning"),
    )


def page_totals(bodies: DataFrame, total_path: str, array: str, *, source: str | None = None) -> DataFrame:
    """``file, total, records`` of landed JSON pages; the path is a JSON path.

    With ``source`` also ``window``, the most records its interface hands out (NULL where none is known).
    """
    total = F.get_json_object("body", total_path).cast("bigint")
    records = F.size(F.from_json("body", f"struct<`{array}`:array<variant>>")[array])
    totals = bodies.select("file", total.alias("total"), F.greatest(records, F.lit(0)).cast("bigint").alias("records"))
    return totals if source is None else totals.withColumn("window", F.lit(RESULT_WINDOWS.get(source)).cast("bigint"))


def schema_drift(rows: DataFrame, expected: Sequence[str], header: Sequence[str] = ()) -> DataFrame:
    """``rows, missing, state``: is every expected column still there?

    A register without rows is ``empty`` where its header still shows the columns,
    and ``no evidence`` where nothing came back at all.
    """
    wanted = F.array(*map(F.lit, expected)).cast("array<string>")
    named = F.array(*map(F.lit, header)).cast("array<string>")
    seen = [
        F.coalesce(F.max(F.map_contains_key("fields", F.lit(n))), F.lit(False)).alias(f"seen_{i}")
        for i, n in enumerate(expected)
    ]
    totals = rows.agg(F.count(F.lit(1)).alias("rows"), *seen)
    present = F.array_compact(
        F.array(*[F.when(F.col(f"seen_{i}"), F.lit(n)) for i, n in enumerate(expected)]).cast("array<string>")
    )
    columns = F.when(F.col("rows") > 0, present).otherwise(named)
    no_evidence = (F.col("rows") == 0) & F.lit(not header)
    result = totals.select("rows", F.when(no_evidence, F.array().cast("array<string>")).otherwise(F.array_except(wanted, columns)).alias("missing"), no_evidence.alias("_none"))
    state = (
        F.when(F.col("_none"), "no evidence")
        .when(F.size("missing") > 0, "missing fields")
        .when(F.col("rows") == 0, "empty")
        .otherwise("ok")
    )
    return result.withColumn("state", state).drop("_none")


def schema_drift_by(rows: DataFrame, expected: DataFrame, *by: str) -> DataFrame:
    """Missing columns per register in one job, in long form: ``by..., field``.

    ``expected`` has ``by...`` and ``field``.
    """
    seen = rows.select(*by, F.explode(F.map_keys("fields")).alias("field")).distinct()
    return expected.join(seen, [*by, "field"], "left_anti")


def published_digest(text: Column) -> Column:
    """The digest in a bare digest or a ``digest  filename`` line, lower-cased."""
    return F.lower(F.get(F.split(strip(F.coalesce(text, F.lit(""))), r"\s+"), F.lit(0)))


def file_integrity(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """``file, actual, expected, ok`` for every landed file.

    ``digests`` has ``file`` and ``digest``.  A file without a published digest passes.
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("actual")
    )
    return compare_digests(files, digests)


def compare_digests(files: DataFrame, digests: DataFrame) -> DataFrame:
    published = digests.select("file", published_digest(F.col("digest")).alias("expected"))
    joined = files.join(published, "file", "left")
    expected = F.nullif("expected", F.lit(""))
    return joined.select("file", "actual", expected.alias("expected"), F.coalesce(expected == F.col("actual"), F.lit(True)).alias("ok"))


def evidence_table(rows: DataFrame, catalog: DataFrame, registers: DataFrame, *, subject: str = "", matched_on: str = "") -> DataFrame:
    """Rows with everything a receipt states about where they come from.

    ``rows`` has ``source, stamp, row_key, fields``; every row carries its own hash
    and the digest of the snapshot it was taken from.
    """
    snapshot = catalog.select(
        "source", "stamp", "captured_at", F.col("row_count").alias("snapshot_rows"), "body_digest", "key_columns", "select", "query"
    )
    publisher = registers.select(
        F.col("key").alias("source"),
        "title",
        "jurisdiction",
        "docs_url",
        F.coalesce(F.nullif("data_licence", F.lit("")), F.lit("not stated by the publisher")).alias("data_licence"),
        F.coalesce(F.nullif("disclaimer", F.lit("")), F.lit("none stated; the publisher's own terms apply")).alias("disclaimer"),
        F.col("personal_data").alias("personal_data_note"),
        "cadence_hours",
    )
    base = rows.select("source", "stamp", "row_key", "fields", keys.row_hash(F.col("fields")).alias("row_hash"))
    return (
        base.join(snapshot, ["source", "stamp"])
        .join(publisher, "source")
        .withColumn("subject", F.lit(subject))
        .withColumn("matched_on", F.lit(matched_on))
    )


def lookup(rows: DataFrame, term: str, *, per_source: int = 4, sources: Sequence[str] | None = None) -> DataFrame:
    """The first rows of every register in which the term occurs.

    ``rows`` are the newest snapshots of all registers.
    """
    if sources is not None:
        rows = rows.filter(F.col("source").isin(list(sources)))
    order = Window.partitionBy("source").orderBy("ordinal")
    hits = rows.filter(contains_condition([term]))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_source)


def lookup_changes(changes: DataFrame, term: str, *, last: int = 20) -> DataFrame:
    """The newest change events that mention the term."""
    from rollbook.operators.snapshots import change_rows

    events = change_rows(changes, keep=("source", "stamp"))
    hits = events.filter(contains_condition([term]))
    return hits.orderBy(F.desc("stamp"), F.desc("source"), F.desc("row_key")).limit(last)
