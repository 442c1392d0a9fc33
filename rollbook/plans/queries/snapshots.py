"""Keys, digests, change events and the archive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rollbook.functions import keys
from rollbook.operators import flatten as fl
from rollbook.operators import history
from rollbook.operators import snapshots as sn
from rollbook.plans.queries.base import (
    WHOLE,
    SQL_LINE_ORDER,
    SQL_ORDER_VERSIONS,
    customer_rows,
    line_order,
    money,
    order_documents,
    order_versions,
    query,
    rows_of,
    sql_money,
    table,
)

_SQL_CUSTOMER_JSON = f"""'{{"balance": "' || {sql_money('c_acctbal')} || '", "id": "' || c_custkey || '", "name": "' || c_name ||
      '", "nation": "' || c_nationkey || '", "segment": "' || c_mktsegment || '"}}'"""


@query(
    f"""SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_name || chr(31) || s_nationkey ELSE 'sha256:' || substr(sha256(
      '{{"balance": "' || {sql_money('s_acctbal')} || '", "name": " ", "nation": ""}}'), 1, 32) END AS row_key FROM supplier"""
)
def row_keys(spark, folder):
    """Declared key columns, or the content digest where all of them are blank."""
    supplier = table(spark, folder, "supplier")
    known = F.col("s_acctbal") >= 0
    rows = rows_of(
        supplier,
        "s_suppkey",
        {
            "name": F.when(known, F.col("s_name")).otherwise(" "),
            "nation": F.when(known, F.col("s_nationkey").cast("string")).otherwise(""),
            "balance": money("s_acctbal"),
        },
        "s_suppkey",
    )
    return rows.select("s_suppkey", keys.row_key(F.col("fields"), ["name", "nation"]).alias("row_key"))


@query(
    f"""SELECT c_custkey, 'sha256:' || substr(sha256({_SQL_CUSTOMER_JSON}), 1, 32) AS row_key, sha256({_SQL_CUSTOMER_JSON}) AS row_hash
      FROM customer"""
)
def content_keys(spark, folder):
    """Rows of a register without identifiers, known by their content."""
    rows = sn.with_keys(customer_rows(spark, folder), [])
    return rows.select(F.col("ordinal").alias("c_custkey"), "row_key", "row_hash")


_SQL_NODES = """counted AS (SELECT h, count(*) AS n FROM hashed GROUP BY h),
    leaves AS (SELECT substr(h, 1, 4) AS branch, substr(h, 5, 4) AS leaf, sum(n) AS n,
      sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS d FROM counted GROUP BY 1, 2),
    branches AS (SELECT branch, sum(n) AS n, sha256(string_agg(leaf || ':' || d, chr(10) ORDER BY leaf || ':' || d)) AS d FROM leaves GROUP BY 1)
    SELECT sha256(string_agg(branch || ':' || d, chr(10) ORDER BY branch || ':' || d)) AS body_digest, CAST(sum(n) AS BIGINT) AS row_count
    FROM branches"""


@query(f"WITH hashed AS (SELECT sha256({_SQL_CUSTOMER_JSON}) AS h FROM customer UNION ALL SELECT sha256({_SQL_CUSTOMER_JSON}) FROM customer WHERE c_nationkey = 1), {_SQL_NODES}")
def body_digest(spark, folder):
    """Digest of a snapshot, whatever the order of its rows; repeated rows count."""
    rows = customer_rows(spark, folder)
    return sn.body_digest(sn.with_keys(rows.union(rows.filter(F.col("fields")["nation"] == "1")), ["id"]))


def _keyed_lines(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("ord", line_order())
    rows = rows_of(lines, "ord", {"order": "l_orderkey", "line": "l_linenumber", "part": "l_partkey"})
    return sn.with_keys(rows, ["order", "line"]).select("row_key", "ordinal", "fields")


@query(
    f"""SELECT k, part, copies FROM (SELECT l_orderkey || '/' || l_linenumber AS k, CAST(l_partkey AS VARCHAR) AS part,
      count(*) OVER w AS copies, row_number() OVER (w ORDER BY {SQL_LINE_ORDER}) AS r FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)) WHERE r = 1"""
)
def dedupe_first(spark, folder):
    """The first row of every key and how often the key occurs."""
    firsts = sn.first_copies(_keyed_lines(spark, folder))
    return firsts.select(F.translate("row_key", "\x1f", "/").alias("k"), F.col("fields")["part"].alias("part"), "copies")


@query("SELECT CAST(count(*) - count(DISTINCT l_orderkey || '/' || l_linenumber) AS BIGINT) AS duplicate_keys FROM lineitem")
def duplicate_keys(spark, folder):
    return sn.duplicate_keys(_keyed_lines(spark, folder))


def _order_events(spark, folder):
    old, new = order_versions(spark, folder)
    return sn.diff_snapshots(sn.with_keys(old, ["key"]), sn.with_keys(new, ["key"]), sources=("orders", "orders"))


def _shown(events):
    row = F.coalesce("row", "previous")
    return events.select(
        F.col("row_key").alias("k"), "kind", F.array_join("columns", " | ").alias("columns"), row["status"].alias("status"), row["total"].alias("total")
    )


_SQL_EVENTS = f"WITH {SQL_ORDER_VERSIONS} SELECT k, kind, columns, status, total FROM events"


@query(_SQL_EVENTS)
def diff_orders(spark, folder):
    """Added, changed and removed orders with the columns that moved."""
    return _shown(sn.ordered_changes(_order_events(spark, folder)))


@query(
    f"""WITH {SQL_ORDER_VERSIONS} SELECT kind AS _change, k AS _key, columns AS _changed_columns, status, total,
      CASE WHEN contains(columns, 'status') THEN old_status END AS status_was,
      CASE WHEN contains(columns, 'total') THEN old_total END AS total_was FROM events"""
)
def change_rows(spark, folder):
    """Events as rows, with the former value of each changed column."""
    rows = sn.change_rows(_order_events(spark, folder))
    columns = ["_change", "_key", "_changed_columns", "status", "total", "status__was", "total__was"]
    wide = fl.to_wide(rows, columns, keep=())
    return wide.withColumnsRenamed({"status__was": "status_was", "total__was": "total_was"})


@query(
    f"""WITH {SQL_ORDER_VERSIONS} SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'changed') AS changed,
      count(*) FILTER (kind = 'removed') AS removed, (SELECT count(*) FROM old) AS old_rows, (SELECT count(*) FROM new) AS new_rows,
      '' AS notes FROM events"""
)
def diff_summary(spark, folder):
    """One row that sums the events up."""
    old, new = order_versions(spark, folder)

    def meta(rows):
        return rows.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit("orders").alias("source"), "row_count", F.lit("").alias("captured_at"), F.array(F.lit("key")).alias("key_columns"),
            F.lit(0).alias("duplicate_keys"),
        )

    summary = sn.summarise(_order_events(spark, folder), meta(old), meta(new))
    return summary.select("added", "changed", "removed", "old_rows", "new_rows", F.array_join("notes", "; ").alias("notes"))


@query(f"WITH {SQL_ORDER_VERSIONS} SELECT k, status, total FROM new")
def apply_changes(spark, folder):
    """The older snapshot plus the events gives the newer one."""
    old, _ = order_versions(spark, folder)
    restored = sn.apply_changes(sn.first_copies(sn.with_keys(old, ["key"])), _order_events(spark, folder))
    f = F.col("fields")
    return restored.select(F.col("row_key").alias("k"), f["status"].alias("status"), f["total"].alias("total"))


_FLAG_COLUMNS = {f: " | ".join(f"line{f}_{c}" for c in ("count", "part", "price", "shipped", "type_s")) for f in "ANR"}


@query(
    """WITH n AS (SELECT l_orderkey AS k, """
    + ", ".join(
        f"count(*) FILTER (l_returnflag = '{f}' AND l_linestatus = 'O') > 0 AS moved{f}" for f in "ANR"
    )
    + """ FROM lineitem GROUP BY 1)
    SELECT 'o' || o_orderkey AS k, 'changed' AS kind, concat_ws(' | ', """
    + ", ".join(f"CASE WHEN moved{f} THEN '{c}' END" for f, c in _FLAG_COLUMNS.items())
    + """, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'status' END) AS columns
    FROM orders LEFT JOIN n ON o_orderkey = k
    WHERE movedA OR movedN OR movedR OR (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F')"""
)
def diff_flattened_orders(spark, folder):
    """Documents to one row per order in two versions, and the events between them.

    In the earlier version open lines are not there yet and urgent orders are not finished.
    """
    later = order_documents(spark, folder)
    fields = F.col("fields")
    earlier = order_documents(spark, folder, "l_linestatus <> 'O'")
    urgent = (fields["type_s"] == "parent") & (fields["priority"] == "1-URGENT")
    finished = F.transform_values(fields, lambda k, v: F.when(k == "status", "F").otherwise(v))
    later = later.withColumn("fields", F.when(urgent, finished).otherwise(fields))

    def snapshot(docs):
        return sn.with_keys(fl.flatten_blocks(docs, span=WHOLE), ["_root_"])

    events = sn.diff_snapshots(snapshot(earlier), snapshot(later))
    return events.select(F.col("row_key").alias("k"), "kind", F.array_join("columns", " | ").alias("columns"))


_OLD, _NEW = "20260101T000000Z", "20260102T000000Z"


def _order_archive(spark, folder):
    """Both versions of the orders, archived by two ingest runs."""
    from rollbook.plans.archive import Archive
    from rollbook.plans.ingest import ingest
    from rollbook.session import shared_folder

    archive = Archive(spark, shared_folder(spark, "archive"))
    old, new = order_versions(spark, folder)
    named = lambda rows: rows.withColumn("fields", F.transform_keys("fields", lambda k, _: F.when(k == "key", "EntityCode").otherwise(k)))
    for day, rows in ((1, old), (2, new)):
        (outcome,) = ingest(
            archive, {"eba-psd": lambda rows=rows: named(rows)}, now=dt.datetime(2026, 1, day, tzinfo=dt.timezone.utc), run_id=f"r{day}"
        )
        if not outcome.ok:
            raise RuntimeError(outcome.error)
    return archive


@query(_SQL_EVENTS)
def archived_changes(spark, folder):
    """Events as recorded by two ingest runs and read back from the archive."""
    archive = _order_archive(spark, folder)
    return _shown(archive.read_changes("eba-psd", since="20260102"))


@query(
    f"""WITH {SQL_ORDER_VERSIONS} SELECT k, kind FROM events
      ORDER BY list_position(['added', 'changed', 'removed'], kind) DESC, k DESC LIMIT 50"""
)
def archived_last_changes(spark, folder):
    """The newest fifty events."""
    return _order_archive(spark, folder).read_changes("eba-psd", last=50).select(F.col("row_key").alias("k"), "kind")


@query(
    f"""WITH {SQL_ORDER_VERSIONS} SELECT 'r1' AS run_id, true AS ok, (SELECT count(*) FROM old) AS rows, 0 AS added, 0 AS changed, 0 AS removed
    UNION ALL SELECT 'r2', true, (SELECT count(*) FROM new), count(*) FILTER (kind = 'added'), count(*) FILTER (kind = 'changed'),
      count(*) FILTER (kind = 'removed') FROM events"""
)
def ingest_runs(spark, folder):
    """The run log of two ingests."""
    return _order_archive(spark, folder).run_log().select("run_id", "ok", "rows", "added", "changed", "removed")


@query(
    f"""WITH {SQL_ORDER_VERSIONS} SELECT '{_OLD}' AS stamp, true AS ok, 'ok' AS reason, (SELECT count(*) FROM old) AS row_count
    UNION ALL SELECT '{_NEW}', true, 'ok', (SELECT count(*) FROM new)"""
)
def verify_archive(spark, folder):
    """Every digest recomputed from the archived fields."""
    archive = _order_archive(spark, folder)
    checks = archive.verify().join(archive.catalog().select("source", "stamp", "row_count"), ["source", "stamp"])
    return checks.select("stamp", "ok", "reason", "row_count")


@query(f"WITH {SQL_ORDER_VERSIONS} SELECT k, status, total FROM old")
def read_snapshot(spark, folder):
    """One archived snapshot after checking its digest."""
    rows = _order_archive(spark, folder).read_snapshot("eba-psd", _OLD)
    f = F.col("fields")
    return rows.select(F.col("row_key").alias("k"), f["status"].alias("status"), f["total"].alias("total"))


@query(f"WITH {SQL_ORDER_VERSIONS} SELECT '{_OLD}' AS stamp, '' AS against, CAST(0 AS BIGINT) AS events UNION ALL SELECT '{_NEW}', '{_OLD}', count(*) FROM events")
def change_runs(spark, folder):
    """One entry per comparison, also where nothing was there to compare."""
    runs = _order_archive(spark, folder).change_runs()
    return runs.select("stamp", "against", (F.col("added") + F.col("changed") + F.col("removed")).alias("events"))


# -- the event table read as a snapshot catalogue ---------------------------------

_NOW = dt.datetime(2024, 2, 2, 6, tzinfo=dt.timezone.utc)
_SQL_CATALOG = """cat AS (SELECT event_type AS source, strftime(ts, '%Y%m%dT%H0000Z') AS stamp, date_trunc('hour', ts) AS taken,
      count(*) AS row_count FROM events GROUP BY ALL),
    newest AS (SELECT source, max(stamp) AS latest, max(taken) AS taken, count(*) AS snapshots FROM cat GROUP BY 1),
    cadence AS (SELECT unnest(['click', 'error', 'view', 'signup', 'vies']) AS source,
      unnest([24.0, 720.0, NULL, 48.0, 24.0]) AS hours, unnest([true, true, true, true, false]) AS listable)"""


def _catalog(spark, folder):
    events = table(spark, folder, "events")
    stamp = F.date_format(F.date_trunc("hour", "ts"), "yyyyMMdd'T'HHmmss'Z'")
    return events.groupBy(F.col("event_type").alias("source"), stamp.alias("stamp")).agg(F.count(F.lit(1)).alias("row_count"))


def _registers(spark):
    rows = [("click", 24.0, True), ("error", 720.0, True), ("view", None, True), ("signup", 48.0, True), ("vies", 24.0, False)]
    return spark.createDataFrame(rows, "key string, cadence_hours double, bulk_readable boolean")


@query(
    f"""WITH {_SQL_CATALOG}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY stamp DESC) AS n FROM cat)
    SELECT source, stamp, row_count, CAST(n AS INTEGER) AS n FROM r WHERE n <= 2"""
)
def latest_previous(spark, folder):
    """The newest and the second newest snapshot of every register."""
    catalog = _catalog(spark, folder)
    parts = [history.nth_newest(catalog, n).withColumn("n", F.lit(n)) for n in (1, 2)]
    return parts[0].unionByName(parts[1])


@query(
    f"""WITH {_SQL_CATALOG} SELECT source, snapshots, latest, CAST(round(date_diff('second', taken, TIMESTAMP '2024-02-02 06:00:00') / 3600.0, 1) * 10
      AS BIGINT) AS age_tenths, coalesce(date_diff('second', taken, TIMESTAMP '2024-02-02 06:00:00') / 3600.0 > 2 * hours, false) AS stale
    FROM newest LEFT JOIN cadence USING (source)"""
)
def freshness(spark, folder):
    """Age of the newest snapshots, and which are stale for their register's cadence."""
    catalog = _catalog(spark, folder).withColumn("captured_at", F.col("stamp"))
    fresh = history.freshness(catalog, _registers(spark), F.lit(_NOW))
    return fresh.select("source", "snapshots", "latest", F.round(F.col("age_hours") * 10).cast("bigint").alias("age_tenths"), "stale")


@query(
    f"""WITH {_SQL_CATALOG} SELECT source, CASE WHEN NOT listable THEN 'not listable'
      WHEN date_diff('second', taken, TIMESTAMP '2024-02-02 06:00:00') / 3600.0 < 0.5 * hours THEN 'fresh' ELSE 'due' END AS status
    FROM cadence LEFT JOIN newest USING (source)"""
)
def due_registers(spark, folder):
    """Which registers the next run should read."""
    return history.due_registers(_catalog(spark, folder), _registers(spark), F.lit(_NOW)).select("source", "status")


@query(
    f"""WITH {_SQL_CATALOG}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY stamp DESC) AS n FROM cat)
    SELECT source, stamp FROM r WHERE n > 100 AND taken < TIMESTAMP '2024-02-02 06:00:00' - INTERVAL 14 DAY"""
)
def retention_plan(spark, folder):
    """Snapshots past the window, the newest hundred of each register kept."""
    return history.plan_retention(_catalog(spark, folder), F.lit(_NOW), keep_days=14, keep_last=100)


@query(
    f"""WITH {_SQL_CATALOG} SELECT source, max(stamp) AS stamp FROM cat WHERE source IN ('click', 'view') GROUP BY source"""
)
def archive_answers(spark, folder):
    """The newest snapshot answers only under the selection it was taken with."""
    catalog = _catalog(spark, folder).withColumn("select", F.when(F.col("source") == "error", "part").otherwise("")).withColumn("query", F.lit(None).cast("string"))
    asked = [history.archive_answer(catalog, s) for s in ("click", "error", "view")]
    return asked[0].unionByName(asked[1]).unionByName(asked[2]).select("source", "stamp")


@query(f"WITH {SQL_ORDER_VERSIONS} SELECT k, kind, columns FROM events WHERE kind <> 'removed' UNION ALL SELECT k, 'added', '' FROM old")
def streamed_row_changes(spark, folder):
    """Additions and changes from a stream of snapshot rows with per-key state."""
    from rollbook.session import shared_folder
    from rollbook.streaming.changes import follow_rows, read_row_changes

    landing, out, marks = (shared_folder(spark, n) for n in ("stream-in", "stream-out", "stream-marks"))
    for stamp, rows in zip(("s1", "s2"), order_versions(spark, folder)):
        keyed = sn.with_keys(rows, ["key"])
        keyed.select(F.lit("orders").alias("source"), F.lit(stamp).alias("stamp"), "row_key", "ordinal", "fields").write.mode("append").parquet(landing)
    stream = spark.readStream.schema(spark.read.parquet(landing).schema).parquet(landing)
    follow_rows(stream, out, marks).awaitTermination()
    return read_row_changes(spark, out).select(F.col("row_key").alias("k"), "kind", F.array_join("columns", " | ").alias("columns"))


@query(_SQL_EVENTS)
def streamed_snapshot_changes(spark, folder):
    """Events recorded as catalogue rows of complete snapshots arrive."""
    from rollbook.plans.archive import Archive
    from rollbook.session import shared_folder
    from rollbook.streaming.changes import follow_catalog

    archive = Archive(spark, shared_folder(spark, "followed"))
    for stamp, rows in zip((_OLD, _NEW), order_versions(spark, folder)):
        archive.write_snapshot("eba-psd", rows, stamp=stamp, key_columns=["key"])
    follow_catalog(archive, shared_folder(spark, "follow-marks")).awaitTermination()
    return _shown(archive.changes())


_SQL_EXPORT = f"""rows AS (SELECT CAST(c_nationkey AS VARCHAR) AS row_key, sha256({_SQL_CUSTOMER_JSON}) AS row_hash FROM customer),
    placed AS (SELECT row_key, row_hash, row_number() OVER (ORDER BY row_key, row_hash) - 1 AS position FROM rows)"""


@query(f"WITH {_SQL_EXPORT} SELECT * FROM placed")
def export_positions(spark, folder):
    """The place of every row in the canonical order of an export."""
    rows = customer_rows(spark, folder)
    return sn.export_positions(sn.with_keys(rows, ["nation"]))


@query(
    f"""WITH {_SQL_EXPORT}, pages AS (SELECT position // 100 AS page, sha256(string_agg(row_hash, chr(10) ORDER BY position)) AS d FROM placed GROUP BY 1),
    books AS (SELECT page // 100 AS book, sha256(string_agg(d, chr(10) ORDER BY page)) AS d FROM pages GROUP BY 1),
    shelves AS (SELECT sha256(string_agg(d, chr(10) ORDER BY book)) AS d, count(*) AS n FROM books)
    SELECT (SELECT count(*) FROM rows) AS rows, CASE WHEN (SELECT count(*) FROM pages) = 1 THEN (SELECT max(d) FROM pages)
      WHEN n = 1 THEN (SELECT max(d) FROM books) ELSE shelves.d END AS digest FROM shelves"""
)
def export_digest(spark, folder):
    """One digest of an export in canonical order."""
    rows = customer_rows(spark, folder).repartition(5)
    return sn.export_digest(sn.with_keys(rows, ["nation"]), page=100)
