"""A watchlist over the whole archive: which events concern it, and how well the registers cover it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import merge_maps
from rollbook.model import register
from rollbook.operators import history, matching
from rollbook.operators.snapshots import change_rows
from rollbook.plans.archive import Archive
from rollbook.plans.match_store import MatchKeys
from rollbook.session import materialise


@dataclass
class Watch:
    """``events``: rows about watched entities; ``detail``: entity by entity; ``coverage``: per register; ``collisions``: keys that match nobody."""

    events: DataFrame
    detail: DataFrame
    coverage: DataFrame
    collisions: DataFrame


def _matched(store: MatchKeys, snapshots: Iterable[tuple[str, str]], index: DataFrame) -> DataFrame:
    parts = [store.matched(source, stamp, index) for source, stamp in sorted(set(snapshots))]
    if not parts:
        kind = "source string, stamp string, ordinal bigint, entity_id string, entity_label string, match string, match_column string, match_value string, row_key string, first boolean"
        return store.spark.createDataFrame([], kind)
    return reduce(DataFrame.unionByName, parts)


def watch(archive: Archive, watchlist: DataFrame, since: str = "", *, sources: Iterable[str] | None = None) -> Watch:
    """Events from ``since`` on about watched entities, and the coverage of the newest snapshots.

    Both come from the match keys stored with the snapshots: an event's row stands in the snapshot that brought it,
    or, if it was removed, in the one before.  No name is normalised again, but for events whose snapshot is
    retired or has no stored keys: those are matched by their own rows.  Registers that declare neither
    identifiers nor names are left out, as are those not in ``sources``, if given.
    """
    store = MatchKeys(archive)
    wanted = None if sources is None else set(sources)

    def watchable(source: str) -> bool:
        return register(source).entity_shaped and (wanted is None or source in wanted)

    newest = [(r.source, r.stamp) for r in history.nth_newest(archive.catalog()).select("source", "stamp").collect() if watchable(r.source)]
    runs = archive.change_runs().where(F.col("stamp") >= since).where("added + changed + removed > 0")
    told = [r for r in runs.select("source", "stamp", "against", "removed").distinct().collect() if watchable(r.source)]
    needed = {(r.source, r.stamp) for r in told} | {(r.source, r.against) for r in told if r.removed}
    stored = {s for s in needed | set(newest) if store.has(*s)}
    for source, stamp in set(newest) - stored:
        store.write(source, stamp)
    index = materialise(matching.watch_index(watchlist), "watch-index")
    matched = materialise(_matched(store, stored | set(newest), index), "matched")

    listed = sorted(s for s, _ in newest)
    latest = archive.spark.createDataFrame(newest, "source string, stamp string")
    found = matched.join(F.broadcast(latest), ["source", "stamp"], "left_semi")
    detail = matching.coverage_of(found, watchlist, listed)

    at = F.when(F.col("kind") == "removed", F.col("against")).otherwise(F.col("stamp"))
    events = archive.changes().where(F.col("stamp") >= since).where(F.col("source").isin(sorted({r.source for r in told}))).withColumn("at", at)
    known = archive.spark.createDataFrame(sorted(stored), "source string, at string")
    why = matched.where("first").withColumnRenamed("stamp", "at").drop("ordinal", "first")
    tagged = matching.tag_changes(change_rows(events, keep=("source", "stamp", "at")))
    by_key = tagged.join(why, ["source", "at", "row_key"])
    by_key = by_key.select("source", "stamp", "change", "row_key", "entity_id", "entity_label", "match", "match_column", "match_value", "fields")
    by_row = tagged.join(F.broadcast(known), ["source", "at"], "left_anti").drop("at")
    by_row = matching.match_rows(by_row, watchlist, matching.register_columns(archive.spark), by=("source", "stamp", "change", "row_key"), carry=("fields",))
    every = by_key.unionByName(by_row.select(*by_key.columns))
    every = every.withColumn("fields", merge_maps(matching.reason(), F.col("fields")))
    return Watch(every, detail, matching.coverage(detail), matching.collisions(watchlist))
