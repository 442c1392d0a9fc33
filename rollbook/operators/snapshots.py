"""Keys, content digests and column-level change events between snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import keys
from rollbook.functions.text import SEPARATOR, merge_maps
from rollbook.session import materialise

# Kinds of change in the order they are listed.
KINDS = ("added", "changed", "removed")


def with_keys(
    rows: DataFrame, key_columns: Sequence[str], *, ignore: Sequence[str] = keys.VOLATILE_COLUMNS
) -> DataFrame:
    """Add ``row_key``, ``diff_hash`` and ``row_hash``; no shuffle."""
    fields = F.col("fields")
    return (
        rows.withColumn("row_key", keys.row_key(fields, key_columns))
        .withColumn("diff_hash", keys.diff_hash(fields, ignore))
        .withColumn("row_hash", keys.row_hash(fields))
    )


def first_copies(keyed: DataFrame, *, scope: Sequence[str] = ()) -> DataFrame:
    """The first row of every key and ``copies``, how often the key occurs.

    The aggregate runs before the exchange as well, so a key that holds a third
    of all rows arrives as one row per task.  The result is partitioned and
    sorted by key, which the diff join reuses.
    """
    group = [*scope, "row_key"]
    rest = [c for c in keyed.columns if c not in group]
    return (
        keyed.groupBy(*group)
        .agg(F.min_by(F.struct(*rest), F.struct("ordinal", *[c for c in ("diff_hash", "row_hash") if c in rest])).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select(*group, "first.*", "copies")
    )


def export_order(keyed: DataFrame) -> DataFrame:
    """Rows in canonical order for an export: ranges of keys over tasks, sorted within.

    Equal snapshots give the same sequence of rows.
    """
    return keyed.repartitionByRange("row_key", "row_hash").sortWithinPartitions("row_key", "row_hash")


def export_positions(keyed: DataFrame) -> DataFrame:
    """``row_key, row_hash, position``: every row's place in the canonical order, from 0.

    Ranges of keys are numbered on their own and moved on by the rows before them; no task sees all rows.
    """
    ranges = keyed.select("row_key", "row_hash").repartitionByRange("row_key", "row_hash").withColumn("range", F.spark_partition_id())
    ranges = materialise(ranges, "export-order")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row per task
    counts = counts.select(F.col("range").alias("r"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("row_key", "row_hash")) - 1
    placed = ranges.withColumn("place", place).join(F.broadcast(counts), F.col("range") == F.col("r"))
    return placed.select("row_key", "row_hash", (F.col("before") + F.col("place")).alias("position"))


def export_digest(keyed: DataFrame, *, page: int = 10_000) -> DataFrame:
    """``rows, digest``: one digest of the rows in canonical order, so that two exports are compared without gathering them.

    ``page`` rows at a time are hashed in their order, then as many pages, and so on up to one: the same
    rows give the same digest however they are dealt, and no group has more than ``page`` members.
    """
    level = export_positions(keyed).select("position", F.col("row_hash").alias("digest"))
    rows = level.agg(F.count(F.lit(1)).alias("rows"))
    left = total = rows.first().rows
    while left > 1 or left == total > 0:
        members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "digest"))), lambda m: m["digest"]), "\n")
        level = level.groupBy(F.floor(F.col("position") / page).alias("position")).agg(F.sha2(members, 256).alias("digest"))
        left, total = -(-left // page), -1
    first = level.agg(F.max("digest").alias("digest"))
    return rows.join(F.broadcast(first)).select("rows", F.coalesce("digest", F.lit(EMPTY_DIGEST)).alias("digest"))


def duplicate_keys(keyed: DataFrame, *by: str) -> DataFrame:
    """How many rows repeat the key of an earlier row."""
    counts = keyed.groupBy(*by, "row_key").agg(F.count(F.lit(1)).alias("copies"))
    return counts.groupBy(*by).agg(F.sum(F.col("copies") - 1).alias("duplicate_keys"))


def body_digest(hashed: DataFrame, *by: str) -> DataFrame:
    """Digest of a multiset of ``row_hash`` values, independent of order.

    Equal hashes are first reduced to one row with a count, so repeated rows do
    not pile up.  Hash prefixes then form a tree with three levels, in which no
    group holds more than 65536 members for up to 2**48 different rows.  Its two
    lower levels are windows over one sort; most leaves have a single row, and
    an aggregate would sort and pack the lists of each level twice.
    """

    def node(members: Column) -> Column:
        return F.sha2(F.array_join(F.sort_array(members), "\n"), 256)

    def level(rows: DataFrame, group: Sequence[str], name: str, *parts: str) -> DataFrame:
        """One row per ``group``, with the digest of its members."""
        places = Window.partitionBy(*group).orderBy(name)
        every = places.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        listed = rows.withColumn("members", F.collect_list(F.concat_ws(":", *parts)).over(every))
        listed = listed.withColumn("total", F.sum("n").over(every)).withColumn("place", F.row_number().over(places))
        return listed.filter("place = 1").select(*group, node(F.col("members")).alias("digest"), F.col("total").alias("n"))

    counted = hashed.groupBy(*by, "row_hash").agg(F.count(F.lit(1)).alias("n"))
    branch = counted.select(*by, F.substring("row_hash", 1, 4).alias("branch"), F.substring("row_hash", 5, 4).alias("leaf"), "row_hash", "n")
    leaves = level(branch.repartition(*by, "branch"), [*by, "branch", "leaf"], "row_hash", "row_hash", "n")
    branches = level(leaves, [*by, "branch"], "leaf", "leaf", "digest")
    return branches.groupBy(*by).agg(node(F.collect_list(F.concat_ws(":", "branch", "digest"))).alias("body_digest"), F.sum("n").alias("row_count"))


EMPTY_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def changed_columns(before: Column, after: Column, ignore: Sequence[str] = keys.VOLATILE_COLUMNS) -> Column:
    """Sorted names of the columns whose values differ; absent equals blank."""
    names = F.array_union(F.map_keys(before), F.map_keys(after))
    blank = F.lit("")
    moved = F.filter(
        names,
        lambda c: ~c.isin(list(ignore)) & (F.coalesce(before[c], blank) != F.coalesce(after[c], blank)),
    )
    return F.array_sort(moved)


def diff_snapshots(
    old: DataFrame,
    new: DataFrame,
    *,
    sources: tuple[str, str] | None = None,
    ignore: Sequence[str] = keys.VOLATILE_COLUMNS,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Change events ``kind, row_key, columns, row, previous`` between two snapshots.

    Both sides come from :func:`with_keys` and are reduced to the first row per
    key here.  One full outer join on the key; rows with equal ``diff_hash`` are
    dropped before any column is compared.
    """
    if sources and all(sources) and sources[0] != sources[1]:
        raise ValueError(f"refusing to compare {sources[0]!r} with {sources[1]!r}: different registers")
    group = [*scope, "row_key"]

    def side(rows: DataFrame, prefix: str) -> DataFrame:
        firsts = first_copies(rows.select(*group, "ordinal", "fields", "diff_hash"), scope=scope)
        return firsts.select(*group, F.col("fields").alias(prefix), F.col("diff_hash").alias(f"{prefix}_hash"))

    joined = side(old, "previous").join(side(new, "row"), group, "full_outer")
    return classify(joined.filter(~F.col("previous_hash").eqNullSafe(F.col("row_hash"))), group, ignore)


def classify(pairs: DataFrame, group: Sequence[str], ignore: Sequence[str] = keys.VOLATILE_COLUMNS) -> DataFrame:
    """Turn pairs of differing rows into change events."""
    kind = F.when(F.col("previous").isNull(), "added").when(F.col("row").isNull(), "removed").otherwise("changed")
    columns = F.when(
        F.col("previous").isNotNull() & F.col("row").isNotNull(),
        changed_columns(F.col("previous"), F.col("row"), ignore),
    ).otherwise(F.array().cast("array<string>"))
    return pairs.select(*group, kind.alias("kind"), columns.alias("columns"), "row", "previous")


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def ordered_changes(changes: DataFrame) -> DataFrame:
    """Added, changed, removed; by key within each."""
    return changes.orderBy(kind_rank(F.col("kind")), "row_key")


def _change_parts() -> tuple[list[Column], Column]:
    """The maps that a change row consists of, of which later ones win, and whether no column is in two of them."""
    head = F.create_map(
        F.lit("_change"), F.col("kind"),
        F.lit("_key"), keys.readable_key(F.col("row_key")),
        F.lit("_changed_columns"), F.array_join("columns", SEPARATOR),
    )
    former = F.map_from_entries(
        F.transform(
            "columns",
            lambda c: F.struct(
                F.concat(c, F.lit("__was")).alias("key"),
                F.coalesce(F.col("previous")[c], F.lit("")).alias("value"),
            ),
        )
    )
    body = F.coalesce("row", "previous")
    ours = F.concat(F.map_keys(head), F.transform("columns", lambda c: F.concat(c, F.lit("__was"))))
    apart = ~F.arrays_overlap(F.map_keys(body), ours) & (F.size(F.array_distinct(ours)) == F.size(ours))
    return [head, body, former], apart


def change_rows(changes: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """Events as ragged rows, with the former value of each changed column.

    Columns ``_change``, ``_key``, ``_changed_columns``, the row itself (the former
    one for removals) and ``<column>__was``.
    """
    parts, apart = _change_parts()
    fields = F.when(apart, F.map_concat(*parts)).otherwise(reduce(merge_maps, parts))
    return changes.select(*keep, "kind", "row_key", fields.alias("fields"))


def change_cells(changes: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., cells``: the values of :func:`change_rows`, without building its maps where they are put together as they are."""
    parts, apart = _change_parts()
    cells = F.when(apart, F.concat(*[F.map_values(p) for p in parts])).otherwise(F.map_values(reduce(merge_maps, parts)))
    return changes.select(*keep, cells.alias("cells"))


def apply_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The newer snapshot from the older one and the events between them.

    ``old`` has ``row_key`` and ``fields``; the result too, one row per key.
    """
    untouched = old.join(changes.select("row_key"), "row_key", "left_anti").select("row_key", "fields")
    present = changes.filter(F.col("kind") != "removed").select("row_key", F.col("row").alias("fields"))
    return untouched.unionByName(present)


def summarise(
    changes: DataFrame, old_meta: DataFrame, new_meta: DataFrame
) -> DataFrame:
    """One row: change counts, row counts, capture times and notes.

    The two meta tables are single catalogue rows.
    """
    counts = changes.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    before = old_meta.select(F.col("row_count").alias("old_rows"), F.col("captured_at").alias("old_captured_at"))
    after = new_meta.select(
        "source",
        F.col("row_count").alias("new_rows"),
        F.col("captured_at").alias("new_captured_at"),
        F.array_compact(
            F.array(
                F.when(F.size("key_columns") == 0, "no stable key: a modified row shows as one removal and one addition"),
                F.when(
                    F.col("duplicate_keys") > 0,
                    F.format_string(
                        "%d row(s) repeat an earlier key on %s and were not compared",
                        "duplicate_keys",
                        F.array_join("key_columns", ", "),
                    ),
                ),
            )
        ).alias("notes"),
    )
    return after.join(F.broadcast(before)).join(F.broadcast(counts))
