"""Counts, profiles and log roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.functions import codes
from rollbook.operators import stats
from rollbook.plans.queries.base import (
    customer_rows,
    document_rows,
    order_documents,
    order_versions,
    query,
    rows_of,
    SQL_ORDER_VERSIONS,
    table,
)


def _order_rows(spark, folder):
    return rows_of(
        table(spark, folder, "orders"), "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority", "blank": F.lit(" ")}
    )


@query("SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1")
def count_values(spark, folder):
    lines = rows_of(table(spark, folder, "lineitem"), "l_orderkey", {"flag": "l_returnflag"})
    return stats.ordered_counts(stats.count_values(lines, "flag"))


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS value FROM part) GROUP BY 1")
def count_values_split(spark, folder):
    """Parts of packed cells, counted one by one."""
    part = table(spark, folder, "part")
    packed = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(" | ")), F.lit(" |"), F.lit(" | "), F.lower("p_type"))
    return stats.count_values(rows_of(part, "p_partkey", {"words": packed}), "words", split="|")


@query("SELECT lower(o_orderpriority) AS value, count(*) AS n FROM orders GROUP BY 1")
def facet_priority(spark, folder):
    return stats.facet(_order_rows(spark, folder), "priority")


# A service cell is three statements with one of three separators; which ones
# follows from brand, type and size of the part.
_STATEMENTS = (
    ("a. providing custody", "a"),
    ("Exchange between crypto assets and fiat currency", "c"),
    ("exchange for other crypto-assets", "d"),
    ("(b) trading platform", "b"),
    ("something else", "?"),
    ("Providing Advice.", "h"),
    ("j", "j"),
)


def _service_cells(spark, folder):
    texts = F.array(*[F.lit(t) for t, _ in _STATEMENTS])
    pick = lambda number: F.element_at(texts, (number % len(_STATEMENTS) + 1).cast("int"))
    first, second, third = pick(F.col("p_size")), pick(F.length("p_name")), pick(F.length("p_brand") + F.length("p_type"))
    separator = F.element_at(F.array(F.lit(" | "), F.lit("/ "), F.lit("\n")), F.length("p_name") % 3 + 1)
    return table(spark, folder, "part").select("p_partkey", F.concat(first, separator, second, separator, third).alias("cell"))


_SQL_PICKS = "[" + ", ".join(f"'{l}'" for _, l in _STATEMENTS) + "]"
_SQL_TEXTS = "[" + ", ".join("'" + t.rstrip(".") + "'" for t, _ in _STATEMENTS) + "]"
_SQL_NUMBERS = "[p_size % 7 + 1, length(p_name) % 7 + 1, (length(p_brand) + length(p_type)) % 7 + 1]"


@query(
    f"""WITH f AS (SELECT p_partkey, list_transform({_SQL_NUMBERS}, lambda i: {_SQL_PICKS}[i]) AS l FROM part)
    SELECT p_partkey, concat_ws('|', nullif(array_to_string(list_sort(list_distinct(list_filter(l, lambda x: x <> '?'))), '|'), ''),
      CASE WHEN list_contains(l, '?') THEN '?' END) AS letters FROM f"""
)
def normalise_services(spark, folder):
    """Free-text service cells to sorted letters, unknown wording visible."""
    return _service_cells(spark, folder).select("p_partkey", codes.service_letters(F.col("cell")).alias("letters"))


@query(f"SELECT value, count(*) AS n FROM (SELECT unnest(list_transform({_SQL_NUMBERS}, lambda i: {_SQL_TEXTS}[i])) AS value FROM part) GROUP BY 1")
def count_service_fragments(spark, folder):
    """Single statements counted, not cells."""
    fragments = _service_cells(spark, folder).select(F.explode(codes.service_fragments(F.col("cell"))).alias("fragment"))
    return stats.count_cells(fragments, F.col("fragment"))


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def count_parent_documents(spark, folder):
    """A parent column counted over parents and children together."""
    return stats.count_document_values(order_documents(spark, folder), "lineA_status", prefix="lineA_")


@query(
    """SELECT 'status' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL
    SELECT 'priority', word, count(*) FROM (SELECT unnest(string_split(o_orderpriority, '-')) AS word FROM orders) GROUP BY 2"""
)
def list_enums(spark, folder):
    """Value counts of all declared columns in one pass."""
    return stats.list_enums(_order_rows(spark, folder), {"status": None, "priority": "-", "blank": None})


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def merge_counts(spark, folder):
    """Counts of parts summed to counts of the whole."""
    orders = _order_rows(spark, folder)
    status = F.col("fields")["status"]
    parts = [stats.count_values(orders.filter(status == s), "priority") for s in ("F", "O", "P")]
    return stats.merge_counts(*parts)


@query(
    """WITH cells AS (SELECT doc_id, unnest(['text', 'lang', 'source', 'extra']) AS field,
        unnest([text, lang, source, CASE WHEN lang = 'de' THEN 'x' ELSE '' END]) AS cell FROM documents
      UNION ALL SELECT doc_id, 'french', source FROM documents WHERE lang = 'fr')
    SELECT field, count(*) AS present, count(*) FILTER (cell <> '') AS non_empty,
      count(DISTINCT cell) FILTER (cell <> '') AS distinct_values, min(doc_id) AS first_seen,
      round(count(*) * 100.0 / (SELECT count(*) FROM documents), 1) AS coverage FROM cells GROUP BY field"""
)
def profile_documents(spark, folder):
    """Presence, filling, exact distinct counts and coverage of every field."""
    documents = document_rows(spark, folder)
    f = F.col("fields")
    extra = F.create_map(F.lit("extra"), F.when(f["lang"] == "de", "x").otherwise(""))
    french = F.when(f["lang"] == "fr", F.create_map(F.lit("french"), f["source"])).otherwise(F.create_map().cast("map<string,string>"))
    ragged = documents.select("ordinal", F.map_concat(f, extra, french).alias("fields"))
    return stats.profile(ragged).drop("samples")


@query(
    """WITH cells AS (SELECT c_custkey AS k, unnest(['name', 'nation', 'segment']) AS field,
        unnest([c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS cell FROM customer),
    firsts AS (SELECT field, cell, row_number() OVER (PARTITION BY field ORDER BY min(k)) AS r FROM cells GROUP BY field, cell)
    SELECT field, string_agg(cell, ' ; ' ORDER BY r) AS samples FROM firsts WHERE r <= 3 GROUP BY field"""
)
def profile_samples(spark, folder):
    """The first distinct values of every field in order of arrival."""
    rows = rows_of(
        table(spark, folder, "customer"), "c_custkey", {"name": "c_name", "nation": "c_nationkey", "segment": "c_mktsegment"}
    )
    return stats.profile(rows).select("field", F.array_join("samples", " ; ").alias("samples"))


@query(
    """WITH probe AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 100)
    SELECT field, present, distinct_values FROM (
      SELECT 'segment' AS field, count(*) AS present, count(DISTINCT c_mktsegment) AS distinct_values FROM probe UNION ALL
      SELECT 'nation', count(*), count(DISTINCT c_nationkey) FROM probe UNION ALL
      SELECT 'name', count(*), count(DISTINCT c_name) FROM probe UNION ALL
      SELECT 'id', count(*), count(DISTINCT c_custkey) FROM probe UNION ALL
      SELECT 'balance', count(*), count(DISTINCT c_acctbal) FROM probe)"""
)
def inspect_first_rows(spark, folder):
    """Field discovery on the first records, the way one looks at an unknown register."""
    raw, _ = stats.inspect(customer_rows(spark, folder), n=100)
    return raw.select("field", "present", "distinct_values")


_INSPECTED = 250


@query(
    f"""WITH total AS (SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS n),
    blocks AS (SELECT o_orderkey AS k, o_orderpriority AS priority, CAST('0x' || substr(md5('o' || o_orderkey), 1, 8) AS BIGINT) AS point FROM orders
      UNION ALL SELECT DISTINCT l_orderkey, NULL, CAST('0x' || substr(md5('o' || l_orderkey), 1, 8) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)),
    chosen AS (SELECT k, priority FROM blocks, total WHERE n <= {4 * _INSPECTED} OR point <= greatest((SELECT min(point) FROM blocks), {4 * _INSPECTED} * 4294967296 // n)),
    firsts AS (SELECT * FROM chosen ORDER BY priority IS NULL, k LIMIT {_INSPECTED}),
    lines AS (SELECT l_orderkey AS k, count(*) AS n, string_agg(l_partkey, ' | ' ORDER BY l_partkey, l_suppkey) AS parts FROM lineitem JOIN firsts ON k = l_orderkey GROUP BY 1)
    SELECT 'priority' AS field, count(*) AS present, count(DISTINCT priority) AS distinct_values FROM firsts WHERE priority IS NOT NULL
    UNION ALL SELECT 'line_count', count(*), count(DISTINCT n) FROM lines UNION ALL SELECT 'line_part', count(*), count(DISTINCT parts) FROM lines"""
)
def inspect_flattened(spark, folder):
    """Field discovery on flattened rows of whole blocks, where all children come behind all parents."""
    parents = rows_of(
        table(spark, folder, "orders"), "o_orderkey",
        {"id": F.concat(F.lit("o"), "o_orderkey"), "type_s": F.lit("parent"), "priority": "o_orderpriority"},
    )
    lines = table(spark, folder, "lineitem")
    behind = (F.col("l_orderkey") + F.lit(1 << 50)).alias("block")
    order = Window.partitionBy("block").orderBy("l_partkey", "l_suppkey")
    children = lines.select("*", behind).withColumn("at", F.col("block") * 1024 + F.row_number().over(order))
    children = rows_of(children, "at", {"_root_": F.concat(F.lit("o"), "l_orderkey"), "entity_type": F.lit("line"), "part": "l_partkey"})
    _, flat = stats.inspect(parents.unionByName(children), n=_INSPECTED, block_structured=True)
    return flat.select("field", "present", "distinct_values").where("field in ('priority', 'line_count', 'line_part')")


@query(
    """SELECT field, value, count(*) AS n, CAST(0 AS BIGINT) AS error FROM (
      SELECT 'lang' AS field, lower(lang) AS value FROM documents UNION ALL SELECT 'source', lower(source) FROM documents) WHERE value <> '' GROUP BY ALL"""
)
def facet_sketch(spark, folder):
    """Frequent values from sketches of parts of a table, merged; exact here, as there are few values."""
    rows = document_rows(spark, folder)
    parts = [stats.facet_sketches(rows.where(F.col("doc_id") % 3 == k), ["lang", "source"]) for k in range(3)]
    return stats.approximate_facet(stats.merge_facets(parts[0].unionByName(parts[1]).unionByName(parts[2])), 1000)


@query(
    f"""WITH {SQL_ORDER_VERSIONS} SELECT 'orders' AS source, 's2' AS stamp, count(*) FILTER (kind = 'added') AS added,
      count(*) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'removed') AS removed FROM events"""
)
def change_counts(spark, folder):
    from rollbook.operators.snapshots import diff_snapshots, with_keys

    old, new = order_versions(spark, folder)
    events = diff_snapshots(with_keys(old, ["key"]), with_keys(new, ["key"]))
    return stats.change_counts(events.withColumn("source", F.lit("orders")).withColumn("stamp", F.lit("s2")))


def _run_log(spark, folder):
    """The event table read as a run log: a user's day is a run, an event a register."""
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return events.select(
        F.concat_ws("-", F.date_format("ts", "yyyyMMdd"), F.col("user_id").cast("string")).alias("run_id"),
        kind.alias("source"),
        (kind != "error").alias("ok"),
        F.when(kind == "view", "fresh").otherwise("").alias("skipped"),
        cents.alias("rows"),
        F.when(kind == "signup", 1).otherwise(0).cast("bigint").alias("added"),
        F.when(kind == "click", 1).otherwise(0).cast("bigint").alias("changed"),
        F.when(kind == "purchase", 1).otherwise(0).cast("bigint").alias("removed"),
        (cents * 0.25).cast("double").alias("seconds"),
        F.create_map(F.lit("fetch"), (cents * 0.25).cast("double"), kind, (cents * 0.5).cast("double")).alias("phases"),
        F.struct(
            F.lit(1).cast("bigint").alias("requests"), F.when(kind == "error", 1).otherwise(0).cast("bigint").alias("retries"),
            F.lit(0).cast("bigint").alias("failures"), cents.alias("bytes_in"),
            (cents * 0.25).cast("double").alias("seconds_requesting"), F.lit(0.5).alias("seconds_waiting"),
        ).alias("http"),
    )


_SQL_RUN_LOG = """log AS (SELECT strftime(ts, '%Y%m%d') || '-' || user_id AS run_id, event_type AS kind,
      CAST(round(value * 100) AS BIGINT) AS cents, event_id, user_id FROM events)"""


@query(
    f"""WITH {_SQL_RUN_LOG} SELECT run_id, count(*) AS sources, count(*) FILTER (kind <> 'error') AS ok,
      count(*) FILTER (kind = 'error') AS failed, count(*) FILTER (kind = 'view') AS skipped, CAST(sum(cents) AS BIGINT) AS rows,
      count(*) FILTER (kind = 'signup') AS added, count(*) FILTER (kind = 'click') AS changed,
      count(*) FILTER (kind = 'purchase') AS removed, CAST(round(sum(cents * 0.25), 1) * 10 AS BIGINT) AS deciseconds
    FROM log GROUP BY run_id"""
)
def run_report(spark, folder):
    """Totals per run."""
    report = stats.run_report(_run_log(spark, folder))
    return report.withColumn("deciseconds", F.round(F.col("seconds") * 10).cast("bigint")).drop("seconds")


@query(
    f"""WITH {_SQL_RUN_LOG} SELECT run_id, phase, CAST(round(sum(c) * 1000) AS BIGINT) AS ms FROM (
      SELECT run_id, 'fetch' AS phase, cents * 0.25 AS c FROM log UNION ALL SELECT run_id, kind, cents * 0.5 FROM log) GROUP BY ALL"""
)
def run_phases(spark, folder):
    """Seconds per run and phase."""
    phases = stats.run_phases(_run_log(spark, folder))
    return phases.select("run_id", "phase", F.round(F.col("seconds") * 1000).cast("bigint").alias("ms"))


@query(
    f"""WITH {_SQL_RUN_LOG} SELECT user_id, event_id, CAST(r AS INTEGER) AS rank FROM (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, CAST(event_id AS VARCHAR)) AS r FROM log) WHERE r <= 5"""
)
def slowest_requests(spark, folder):
    """The five slowest requests of every user."""
    events = table(spark, folder, "events")
    requests = events.select(
        "user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("seconds"), F.col("event_id").cast("string").alias("url")
    )
    return stats.slowest_requests(requests, by=("user_id",)).select("user_id", "event_id", "rank")


@query(f"WITH {_SQL_RUN_LOG} SELECT run_id, count(*) AS sources FROM log GROUP BY 1 ORDER BY run_id DESC LIMIT 20")
def last_runs(spark, folder):
    """The newest twenty runs."""
    return stats.last_runs(stats.run_report(_run_log(spark, folder)), 20).select("run_id", "sources")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_type = 'error' AS unreadable FROM events")
def readable_runs(spark, folder):
    """Truncated run records stay in the history, flagged."""
    events = table(spark, folder, "events")
    cut = F.when(F.col("event_type") == "error", F.regexp_replace("props", r"\}$", "")).otherwise(F.col("props"))
    texts = events.select(F.col("event_id").alias("run_id"), cut.alias("body"))
    runs = stats.readable_runs(texts, "k bigint")
    return runs.select(F.col("run_id").alias("event_id"), F.col("record.k").alias("k"), "unreadable")


_SQL_FETCHES = r"""fetches AS (SELECT coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), '?') AS host,
      CASE WHEN contains(url, '?') THEN '302' ELSE '200' END AS status, CAST(length(html) AS BIGINT) AS bytes FROM pages)"""


@query(
    f"""WITH {_SQL_FETCHES} SELECT ['host+status', 'host', 'status', 'all'][grouping(host, status) + 1] AS level, host, status,
      count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes_in FROM fetches GROUP BY CUBE (host, status)"""
)
def fetch_log_rollup(spark, folder):
    """Requests and bytes by host and status, at every level."""
    pages = table(spark, folder, "pages")
    status = F.when(F.contains("url", F.lit("?")), 302).otherwise(200)
    return stats.fetch_log_rollup(pages.select("url", status.alias("status"), F.length("html").cast("bigint").alias("bytes")))


@query(
    r"""WITH f AS (SELECT coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), '?') AS host,
        CASE WHEN page_id % 7 = 0 THEN 'none' WHEN page_id % 5 = 0 THEN '503' ELSE '200' END AS status,
        CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN 'retry' WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN 'error' ELSE 'ok' END AS outcome,
        CAST(length(html) AS BIGINT) AS bytes, (page_id % 16) * 0.25 AS seconds, CASE WHEN page_id % 3 = 0 THEN 0.5 ELSE 0 END AS waited FROM pages)
    SELECT CASE grouping(host, status, outcome) WHEN 7 THEN 'all' WHEN 3 THEN 'host' WHEN 5 THEN 'status' WHEN 6 THEN 'outcome' ELSE 'host+outcome' END AS level,
        host, status, outcome, count(*) AS requests, count(*) FILTER (outcome = 'retry') AS retries, count(*) FILTER (outcome = 'error') AS failures,
        CAST(sum(bytes) AS BIGINT) AS bytes_in, CAST(sum(seconds) * 1000 AS BIGINT) AS ms_requesting, CAST(sum(waited) * 1000 AS BIGINT) AS ms_waiting
    FROM f GROUP BY GROUPING SETS ((), (host), (status), (outcome), (host, outcome))"""
)
def request_rollup(spark, folder):
    """Requests, retries, failures, bytes and seconds by host, status and outcome."""
    page, pages = F.col("page_id"), table(spark, folder, "pages")
    requests = pages.select(
        "url", F.when(page % 7 == 0, F.lit(None)).when(page % 5 == 0, 503).otherwise(200).cast("int").alias("status"), F.length("html").cast("bigint").alias("bytes"),
        F.when((page % 5 == 0) & (page % 2 == 0), "retry").alias("outcome"), ((page % 16) * 0.25).alias("seconds"), F.when(page % 3 == 0, 0.5).alias("waited"),
    )
    counted = stats.request_rollup(requests)
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return counted.select(
        "level", "host", "status", "outcome", "requests", "retries", "failures", "bytes_in", ms("seconds_requesting").alias("ms_requesting"), ms("seconds_waiting").alias("ms_waiting")
    )


@query(f"WITH {_SQL_FETCHES} SELECT host AS value, count(*) AS n FROM fetches GROUP BY 1")
def url_hosts(spark, folder):
    pages = table(spark, folder, "pages")
    return stats.count_cells(pages, stats.url_host(F.col("url")))


@query(
    f"""WITH {_SQL_RUN_LOG} SELECT run_id, count(*) AS requests, count(*) FILTER (kind = 'error') AS retries, CAST(0 AS BIGINT) AS failures,
      CAST(sum(cents) AS BIGINT) AS bytes_in, CAST(round(sum(cents * 0.25) * 1000) AS BIGINT) AS ms_requesting,
      CAST(count(*) * 500 AS BIGINT) AS ms_waiting FROM log GROUP BY run_id"""
)
def fetch_totals(spark, folder):
    """Request counters of run records, summed."""
    totals = stats.fetch_totals(_run_log(spark, folder))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return totals.select(
        "run_id", "requests", "retries", "failures", "bytes_in", ms("seconds_requesting").alias("ms_requesting"), ms("seconds_waiting").alias("ms_waiting")
    )
