"""Match keys, watchlists, coverage and identity across registers.

Row tables here carry ``source``, ``ordinal`` and ``fields``; ``by`` names the
columns that identify one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import keys
from rollbook.functions.text import SEPARATOR, let, merge_maps, split_literal, strip
from rollbook.model import REGISTERS, Register, register_catalog

ROW_ID = ("source", "ordinal")
# Ranks order the claims of one row: identifiers before names, then the declared
# column order, then the position within the cell.
_COLUMN_STEP = 1 << 32
_NAMES_FROM = 1 << 48


def register_columns(spark, registers: Iterable[Register] = REGISTERS) -> DataFrame:
    """``source, identifier_columns, name_columns`` of the entity-shaped registers."""
    shaped = tuple(r for r in registers if r.entity_shaped)
    return register_catalog(spark, shaped).select(F.col("key").alias("source"), "identifier_columns", "name_columns")


def _cell(fields: Column, column: Column) -> Column:
    return strip(F.coalesce(fields[column], F.lit("")))


def _start(i: Column, first: int = 0) -> Column:
    return i.cast("bigint") * F.lit(_COLUMN_STEP) + F.lit(first)


def _identifier_claims(fields: Column) -> Column:
    def of_column(column: Column, i: Column) -> Column:
        def of_cell(cell: Column) -> Column:
            def claim(form: Column, j: Column) -> Column:
                rank = (_start(i) + j).cast("bigint")
                return F.struct(rank.alias("rank"), F.lit("identifier").alias("kind"), column.alias("column"), cell.alias("value"), form.alias("key"))

            forms = F.when(cell == "", F.array().cast("array<string>")).otherwise(keys.identifier_forms(cell))
            return F.transform(forms, claim)

        return let(_cell(fields, column), of_cell)

    return F.flatten(F.transform("identifier_columns", of_column))


def _name_claims(fields: Column) -> Column:
    """Without their keys, which take Python."""

    def of_column(column: Column, i: Column) -> Column:
        def claim(part: Column, j: Column) -> Column:
            rank = (_start(i, _NAMES_FROM) + j).cast("bigint")
            return F.struct(rank.alias("rank"), F.lit("name").alias("kind"), column.alias("column"), part.alias("value"))

        return F.transform(F.filter(split_literal(_cell(fields, column), SEPARATOR), lambda p: p != ""), claim)

    return F.flatten(F.transform("name_columns", of_column))


def match_keys(rows: DataFrame, columns: DataFrame, *, keep: Sequence[str] = ROW_ID) -> DataFrame:
    """Every key under which a row can be found: ``keep..., rank, kind, column, value, key``.

    ``columns`` is :func:`register_columns`, one row per register.  Registers that are not listed have nothing to match and drop out.
    Names go through Python; identifiers are unfolded on their own, so that they do not.
    """
    # A row per register: exchanged by source, all rows of a register would meet in one task.
    told = rows.join(F.broadcast(columns), "source")
    identifiers = told.select(*keep, F.inline(_identifier_claims(F.col("fields"))))
    names = told.select(*keep, F.inline(_name_claims(F.col("fields")))).withColumn("key", keys.name_key("value"))
    return identifiers.unionByName(names).filter(F.col("key") != "")


def watch_claims(watchlist: DataFrame) -> DataFrame:
    """``kind, key, id, label, sources``: all keys that each watched entity claims."""
    entity = [F.col("id"), F.coalesce(F.when(F.col("label") != "", F.col("label")), "id").alias("label"), F.col("sources")]
    identifiers = F.flatten(F.transform("identifiers", lambda v: keys.identifier_forms(strip(v))))
    names = F.array_distinct(F.concat("names", F.array("label")))
    by_identifier = watchlist.select(*entity, F.explode(identifiers).alias("key")).withColumn("kind", F.lit("identifier"))
    by_name = (
        watchlist.select(*entity, F.explode(names).alias("name"))
        .withColumn("key", F.coalesce(keys.name_key("name"), F.lit("")))
        .withColumn("kind", F.lit("name"))
        .drop("name")
    )
    return by_identifier.unionByName(by_name).filter(F.col("key") != "")


def _claimants(watchlist: DataFrame) -> DataFrame:
    return (
        watch_claims(watchlist)
        .groupBy("kind", "key")
        .agg(F.min(F.struct("id", "label", "sources")).alias("first"), F.max("id").alias("last_id"))
    )


def watch_index(watchlist: DataFrame) -> DataFrame:
    """Keys claimed by exactly one entity: ``kind, key, entity_id, entity_label, sources``."""
    return (
        _claimants(watchlist)
        .filter(F.col("first.id") == F.col("last_id"))
        .select(
            "kind", "key", F.col("first.id").alias("entity_id"), F.col("first.label").alias("entity_label"), "first.sources"
        )
    )


def collisions(watchlist: DataFrame) -> DataFrame:
    """Keys claimed by more than one entity; they match nobody."""
    return _claimants(watchlist).filter(F.col("first.id") != F.col("last_id")).select("kind", "key")


def covers(source: Column) -> Column:
    return (F.size("sources") == 0) | F.array_contains("sources", source)


def match_rows(
    rows: DataFrame,
    watchlist: DataFrame,
    columns: DataFrame,
    *,
    by: Sequence[str] = ROW_ID,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The strongest single match of each row that has one.

    Adds ``entity_id, entity_label, match, match_column, match_value`` to ``by`` and
    ``carry``.  Spark sends the index to all tasks where its size allows it; otherwise both sides are exchanged by key.
    Keys stored beside a snapshot (``plans/match_store.py``) need no exchange.
    """
    keep = list(dict.fromkeys([*by, "source", *carry]))
    index = watch_index(watchlist)
    hits = match_keys(rows, columns, keep=keep).join(index, ["kind", "key"]).filter(covers(F.col("source")))
    rest = [c for c in keep if c not in by]
    best = F.struct("entity_id", "entity_label", "kind", "column", "value", *rest)
    return (
        hits.groupBy(*by)
        .agg(F.min_by(best, "rank").alias("m"))
        .select(
            *by,
            *[F.col(f"m.{c}").alias(c) for c in rest],
            "m.entity_id",
            "m.entity_label",
            F.col("m.kind").alias("match"),
            F.col("m.column").alias("match_column"),
            F.col("m.value").alias("match_value"),
        )
    )


def scope(rows: DataFrame, watchlist: DataFrame, columns: DataFrame, *, by: Sequence[str] = ROW_ID) -> DataFrame:
    """Only rows about watched entities, each annotated with who and why."""
    matched = match_rows(rows, watchlist, columns, by=by, carry=("fields",))
    return matched.withColumn("fields", merge_maps(reason(), F.col("fields")))


def reason() -> Column:
    """Who is meant and why, as cells of the row."""
    return F.create_map(
        F.lit("_entity_id"), F.col("entity_id"),
        F.lit("_entity_label"), F.col("entity_label"),
        F.lit("_match"), F.col("match"),
        F.lit("_match_column"), F.col("match_column"),
        F.lit("_match_value"), F.col("match_value"),
    )


def coverage_detail(rows: DataFrame, watchlist: DataFrame, columns: DataFrame, sources: Sequence[str]) -> DataFrame:
    """``source, entity_id, match`` for every entity a register should show.

    ``match`` is the kind of the first matching row and NULL where there is none.
    """
    return coverage_of(match_rows(rows, watchlist, columns, by=ROW_ID), watchlist, sources)


def coverage_of(matched: DataFrame, watchlist: DataFrame, sources: Sequence[str]) -> DataFrame:
    """:func:`coverage_detail` of rows that were matched before: ``source, ordinal, entity_id, match``."""
    found = matched.groupBy("source", "entity_id").agg(F.min_by("match", "ordinal").alias("match"))
    every = F.array(*map(F.lit, sources)).cast("array<string>")
    listed = F.when(F.size("sources") == 0, every).otherwise(F.array_intersect("sources", every))
    watched = watchlist.select(F.col("id").alias("entity_id"), F.explode(listed).alias("source"))
    return watched.join(found, ["source", "entity_id"], "left")


def coverage(detail: DataFrame) -> DataFrame:
    """Watched, matched, by identifier and by name per register."""
    kind = F.col("match")
    return detail.groupBy("source").agg(
        F.count(F.lit(1)).alias("watched"),
        F.count(kind).alias("matched"),
        F.count_if(kind == "identifier").alias("by_identifier"),
        F.count_if(kind == "name").alias("by_name"),
    )


def unmatched(detail: DataFrame) -> DataFrame:
    return detail.filter(F.col("match").isNull()).select("source", "entity_id")


def watch_changes(changes: DataFrame, watchlist: DataFrame, columns: DataFrame) -> DataFrame:
    """Change events about watched entities, over all registers in one job."""
    from rollbook.operators.snapshots import change_rows

    tagged = tag_changes(change_rows(changes, keep=("source", "stamp")))
    return scope(tagged, watchlist, columns, by=("source", "stamp", "change", "row_key"))


def tag_changes(events: DataFrame) -> DataFrame:
    """Event rows with the snapshot and register they come from; ``kind`` becomes ``change``."""
    tags = F.create_map(F.lit("_snapshot"), F.col("stamp"), F.lit("_source"), F.col("source"))
    return events.withColumnRenamed("kind", "change").withColumn("fields", merge_maps(F.col("fields"), tags))


def _any(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def find_subject(rows: DataFrame, needle: str, register: Register) -> tuple[DataFrame, str]:
    """Rows with the identifier; only if there are none, rows with the name."""
    fields = F.col("fields")
    wanted = keys.identifier_forms(F.lit(needle.strip()))
    by_identifier = rows.filter(
        _any(
            [
                F.arrays_overlap(keys.identifier_forms(F.coalesce(fields[c], F.lit(""))), wanted)
                for c in register.identifier_columns
            ]
        )
    )
    if not by_identifier.isEmpty():
        return by_identifier, "identifier"
    wanted_name, row_id = keys.plain_name_key(needle), [c for c in ROW_ID if c in rows.columns]
    columns = F.array(*map(F.lit, register.name_columns)).cast("array<string>")
    parts = F.flatten(F.transform(columns, lambda c: split_literal(F.coalesce(fields[c], F.lit("")), SEPARATOR)))
    named = (
        rows.select(*row_id, F.explode(parts).alias("part"))
        .withColumn("key", keys.name_key("part"))
        .filter((F.col("key") == wanted_name) & (F.col("key") != ""))
        .select(*row_id)
        .distinct()
    )
    by_name = rows.join(named, row_id, "left_semi")
    return (by_name, "") if by_name.isEmpty() else (by_name, "name")


def entity_xref(keyed: DataFrame, sources: Sequence[str], *, row_id: str = "row_key") -> DataFrame:
    """Which registers share a key: one row per ``kind, key``, one column per register.

    A register's column is the first row that has the key, ``<source>_rows`` how
    many do.  Keys of one register only are left out.  Linear in the number of
    keys: no pairs of rows are formed.
    """
    counts = keyed.select("kind", "key", "source", row_id).groupBy("kind", "key")
    per_source = [
        c
        for s in sources
        for c in (
            F.min(F.when(F.col("source") == s, F.col(row_id))).alias(s),
            F.count_if(F.col("source") == s).alias(f"{s}_rows"),
        )
    ]
    table = counts.agg(*per_source)
    present = sum((F.col(f"`{s}`").isNotNull().cast("int") for s in sources), F.lit(0))
    return table.withColumn("registers", present).filter("registers > 1")


def shared_rows(keyed: DataFrame, *, row_id: str = "row_key") -> DataFrame:
    """Every row whose key also occurs in another register, in long form."""
    shared = (
        keyed.groupBy("kind", "key")
        .agg(F.min("source").alias("a"), F.max("source").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select("kind", "key")
    )
    return keyed.join(shared, ["kind", "key"], "left_semi").select("kind", "key", "source", row_id).distinct()
