"""Blocks, wide tables and nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import codes
from rollbook.functions.text import merge_maps, variant_cell
from rollbook.operators import flatten as fl
from rollbook.plans.queries.base import (
    CUSTOMER_COLUMNS,
    LINE_SPAN,
    WHOLE,
    SQL_LINE_ORDER,
    customer_rows,
    document_rows,
    money,
    order_documents,
    query,
    rows_of,
    sql_day,
    sql_money,
    table,
)

_FLAGS = ("A", "N", "R")
_LINE_COLUMNS = [f"line{f}_{c}" for f in _FLAGS for c in ("count", "part", "price", "shipped")]


@query(
    f"""WITH lines AS (SELECT l_orderkey, l_returnflag, CAST(l_partkey AS VARCHAR) AS part, {sql_money('l_extendedprice')} AS price,
          {sql_day('l_shipdate')} AS shipped, {SQL_LINE_ORDER} AS ord FROM lineitem),
    joined AS (SELECT l_orderkey AS k, """
    + ", ".join(
        f"""nullif(count(*) FILTER (l_returnflag = '{f}'), 0) AS n{f},
        string_agg(part, ' | ' ORDER BY ord) FILTER (l_returnflag = '{f}') AS part{f},
        string_agg(price, ' | ' ORDER BY ord) FILTER (l_returnflag = '{f}') AS price{f},
        string_agg(shipped, ' | ' ORDER BY ord) FILTER (l_returnflag = '{f}') AS shipped{f}"""
        for f in _FLAGS
    )
    + f""" FROM lines GROUP BY 1)
    SELECT 'o' || coalesce(o_orderkey, k) AS root, CASE WHEN o_orderkey IS NULL THEN 'true' END AS orphan,
      o_orderstatus AS status, o_orderpriority AS priority, {sql_money('o_totalprice')} AS total, """
    + ", ".join(
        f"CAST(n{f} AS VARCHAR) AS line{f}_count, part{f} AS line{f}_part, price{f} AS line{f}_price, shipped{f} AS line{f}_shipped"
        for f in _FLAGS
    )
    + " FROM orders FULL JOIN joined ON o_orderkey = k"
)
def flatten_orders(spark, folder):
    """One row per order; lines joined per return flag in order of arrival."""
    rows = fl.flatten_blocks(order_documents(spark, folder), span=WHOLE)
    wide = fl.to_wide(rows, ["_root_", "_orphan", "status", "priority", "total", *_LINE_COLUMNS], keep=())
    return wide.withColumnsRenamed({"_root_": "root", "_orphan": "orphan"})


@query(
    f"""WITH docs AS (SELECT 'o' || o_orderkey AS root, 'parent' AS bucket, 0 AS ord, o_orderstatus AS first_cell FROM orders UNION ALL
      SELECT 'o' || l_orderkey, 'line' || l_returnflag, {SQL_LINE_ORDER}, CAST(l_partkey AS VARCHAR) FROM lineitem)
    SELECT root, bucket, CAST(ord // {LINE_SPAN} AS BIGINT) AS piece, CAST(count(*) AS BIGINT) AS n,
      string_agg(first_cell, ' | ' ORDER BY ord) AS cell FROM docs GROUP BY ALL"""
)
def flatten_pieces(spark, folder):
    """The pieces an entity is joined in: bounded whatever its size."""
    cells = fl.flatten_cells(order_documents(spark, folder), span=LINE_SPAN)
    return cells.select(
        F.col("entity").alias("root"),
        F.coalesce("bucket", F.lit("parent")).alias("bucket"),
        "piece",
        F.col("n").cast("bigint").alias("n"),
        F.coalesce(F.col("head")["status"], F.col("cells")["part"]).alias("cell"),
    )


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS root, CASE WHEN count(*) FILTER (role = 'system') = 0 THEN 'true' END AS orphan,
      min(text) FILTER (role = 'system') AS instruction,
      CAST(nullif(count(*) FILTER (role = 'user'), 0) AS VARCHAR) AS user_count,
      string_agg(text, ' | ' ORDER BY turn) FILTER (role = 'user') AS user_text,
      CAST(nullif(count(*) FILTER (role = 'assistant'), 0) AS VARCHAR) AS assistant_count,
      string_agg(text, ' | ' ORDER BY turn) FILTER (role = 'assistant') AS assistant_text
    FROM conversations GROUP BY conv_id"""
)
def flatten_conversations(spark, folder):
    """Turns in buckets by role; a conversation without instruction is an orphan."""
    turns = table(spark, folder, "conversations")
    system = F.col("role") == "system"
    docs = rows_of(
        turns,
        "turn",
        {"_root_": "conv_id", "type_s": F.when(system, "parent").otherwise("child"), "entity_type": "role", "text": "text"},
    )
    columns = ["_root_", "_orphan", "text", "user_count", "user_text", "assistant_count", "assistant_text"]
    wide = fl.to_wide(fl.flatten_blocks(docs), columns, keep=())
    return wide.withColumnsRenamed({"_root_": "root", "_orphan": "orphan", "text": "instruction"})


@query("SELECT doc_id, text, lang, source FROM documents")
def passthrough_documents(spark, folder):
    """Flat documents as rows, bookkeeping fields dropped."""
    docs = document_rows(spark, folder)
    marked = docs.withColumn("fields", merge_maps(F.col("fields"), F.create_map(F.lit("_version_"), F.lit("1"))))
    return fl.to_wide(fl.passthrough(marked), ["text", "lang", "source"], keep=("doc_id",))


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, {sql_money('s_acctbal')} AS balance FROM supplier")
def flatten_auto_suppliers(spark, folder):
    """No parent anywhere, so the documents pass through."""
    docs = rows_of(table(spark, folder, "supplier"), "s_suppkey", {"id": "s_suppkey", "name": "s_name", "balance": money("s_acctbal")})
    return fl.to_wide(fl.flatten_auto(docs), ["id", "name", "balance"], keep=())


@query(
    """SELECT event_id, event_type || ' | ' || user_id || ' |  | true' AS listed,
      '{"a": [' || user_id || ', "x,y:z"], "k": ' || json_extract_string(props, '$.k') || '}' AS object,
      json_extract_string(props, '$.k') AS number FROM events"""
)
def scalar_cells(spark, folder):
    """JSON values as cells: lists joined, objects as sorted JSON, numbers as text."""
    events = table(spark, folder, "events")
    listed = F.concat(F.lit('["'), "event_type", F.lit('", '), F.col("user_id").cast("string"), F.lit(", null, true]"))
    number = F.get_json_object("props", "$.k")
    obj = F.concat(F.lit('{"k":'), number, F.lit(',"a":['), F.col("user_id").cast("string"), F.lit(',"x,y:z"]}'))
    return events.select(
        "event_id",
        variant_cell(F.parse_json(listed)).alias("listed"),
        variant_cell(F.parse_json(obj)).alias("object"),
        variant_cell(F.parse_json(number)).alias("number"),
    )


@query(
    f"""SELECT 'customer' AS origin, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, NULL AS brand FROM customer
    UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, NULL, NULL FROM supplier
    UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name, NULL, p_brand FROM part"""
)
def union_of_columns(spark, folder):
    """Tables with different columns under one header."""
    parts = []
    for name, key, columns in (
        ("customer", "c_custkey", {"id": "c_custkey", "name": "c_name", "segment": "c_mktsegment"}),
        ("supplier", "s_suppkey", {"id": "s_suppkey", "name": "s_name"}),
        ("part", "p_partkey", {"id": "p_partkey", "name": "p_name", "brand": "p_brand"}),
    ):
        rows = rows_of(table(spark, folder, name), key, columns, F.lit(name).alias("origin"))
        parts.append(fl.to_wide(rows, list(columns), keep=("origin",)))
    return fl.union_rows(*parts)


@query(
    """SELECT CAST(row_number() OVER (ORDER BY first_seen, name) AS BIGINT) AS position, name FROM (
      SELECT name, min(k) AS first_seen FROM (
        SELECT c_custkey AS k, unnest(['id', 'name', 'seg_' || c_mktsegment]) AS name FROM customer) GROUP BY name)"""
)
def column_order(spark, folder):
    """Columns of ragged rows in the order in which they first appear."""
    customer = table(spark, folder, "customer")
    fields = F.create_map(F.lit("id"), F.lit("x"), F.lit("name"), F.lit("y"), F.concat(F.lit("seg_"), "c_mktsegment"), F.lit("z"))
    names = fl.column_names(customer.select(F.col("c_custkey").alias("ordinal"), fields.alias("fields")))
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "position bigint, name string")


@query(
    f"""SELECT o_orderkey, o_orderstatus AS state, {sql_day('o_orderdate')} AS placed_day, o_orderpriority AS priority,
      o_orderpriority || ' | ' || o_orderstatus AS tags, '[{{"n": ' || o_custkey || '}}]' AS links FROM orders"""
)
def collapse_nested_orders(spark, folder):
    """Nested objects to dotted paths; nulls and empty lists have none."""
    from rollbook.sources.json_pages import collapse_nested

    orders = table(spark, folder, "orders")
    text = F.to_json(
        F.struct(
            F.struct(
                F.col("o_orderstatus").alias("state"),
                F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit(None).cast("string").alias("hour")).alias("placed"),
            ).alias("order"),
            F.struct(F.struct(F.col("o_orderpriority").alias("priority")).alias("x")).alias("deep"),
            F.array("o_orderpriority", F.lit(""), "o_orderstatus").alias("tags"),
            F.array(F.struct(F.col("o_custkey").alias("n"))).alias("links"),
            F.array().cast("array<string>").alias("none"),
        )
    )
    flat = collapse_nested(orders, F.parse_json(text))
    f = F.col("fields")
    return flat.select(
        "o_orderkey",
        f["order.state"].alias("state"),
        f["order.placed.day"].alias("placed_day"),
        f["deep.x.priority"].alias("priority"),
        f["tags"].alias("tags"),
        f["links"].alias("links"),
    )


@query("SELECT o_orderkey, o_orderpriority AS a, o_orderstatus AS b, CAST(2 AS INTEGER) AS n FROM orders")
def merge_properties(spark, folder):
    """A list of one-key objects as one object; a repeated key takes the later value."""
    orders = table(spark, folder, "orders")
    items = F.array(
        F.create_map(F.lit("a"), F.col("o_orderstatus")),
        F.create_map(F.lit("b"), F.col("o_orderstatus")),
        F.create_map(F.lit("a"), F.col("o_orderpriority")),
    )
    merged = orders.select("o_orderkey", codes.merge_single_key_objects(items).alias("m"))
    return merged.select("o_orderkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.size("m").alias("n"))


@query(
    """WITH used AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS c, l_linestatus AS s FROM lineitem),
    by_c AS (SELECT k, c, string_agg(s, ',' ORDER BY s) AS codes FROM used GROUP BY k, c),
    cs AS (SELECT k, string_agg(c, ' | ' ORDER BY c) AS cou, CAST(count(*) AS VARCHAR) AS n,
      string_agg(c || '=' || codes, ' | ' ORDER BY c) AS by_cou FROM by_c GROUP BY k),
    ss AS (SELECT k, string_agg(s, ' | ' ORDER BY s) AS ser FROM (SELECT DISTINCT k, s FROM used) GROUP BY k)
    SELECT k, ser AS ENT_SER, cou AS ENT_SER_COU, n AS ENT_SER_COU_count, by_cou AS ENT_SER_BY_COU FROM cs JOIN ss USING (k)"""
)
def passport_footprint(spark, folder):
    """Country -> services as the four footprint columns, per supplier."""
    used = table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()
    per_country = used.groupBy("l_suppkey", "l_returnflag").agg(F.array_sort(F.collect_set("l_linestatus")).alias("codes"))
    services = per_country.groupBy(F.col("l_suppkey").alias("k")).agg(
        F.map_from_entries(F.collect_list(F.struct("l_returnflag", "codes"))).alias("services")
    )
    columns = services.select("k", codes.passport_columns(F.col("services")).alias("fields"))
    return fl.to_wide(columns, ["ENT_SER", "ENT_SER_COU", "ENT_SER_COU_count", "ENT_SER_BY_COU"], keep=("k",))


@query(
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'E ' || source WHEN 'de' THEN 'D ' || source WHEN 'fr' THEN 'F ' || source
      ELSE 'S ' || source END AS title FROM documents"""
)
def pick_language(spark, folder):
    """One text of a multilingual object by order of preference."""
    documents = table(spark, folder, "documents")
    lang = F.col("lang")

    def when(code, prefix):
        return F.when(lang == code, F.concat(F.lit(prefix), "source")).otherwise("")

    texts = F.create_map(
        F.lit("spa"), F.concat(F.lit("S "), "source"), F.lit("fra"), when("fr", "F "), F.lit("eng"), when("en", "E "), F.lit("deu"), when("de", "D ")
    )
    return documents.select("doc_id", codes.pick_language(texts).alias("title"))


@query(
    """SELECT l_orderkey AS k, CAST(count(DISTINCT l_returnflag || l_linestatus) AS INTEGER) AS n FROM lineitem GROUP BY 1"""
)
def distinct_members(spark, folder):
    """Members of a multi-valued cell without blanks and repeats, counted."""
    cells = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_join(F.collect_set(F.concat("l_returnflag", "l_linestatus")), " | ").alias("cell")
    )
    twice = F.split(F.concat_ws(" | ", "cell", F.lit(""), "cell"), r" \| ")
    return cells.select("k", F.size(codes.distinct_parts(twice)).alias("n"))


@query(
    f"SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, {sql_money('c_acctbal')} AS balance, c_mktsegment AS segment FROM customer"
)
def csv_round_trip(spark, folder):
    """Rows written as CSV and read back by the CSV reader."""
    from rollbook.operators.sinks import write_csv
    from rollbook.session import shared_folder
    from rollbook.sources.csv_files import read_csv_rows

    path = shared_folder(spark, "csv")
    write_csv(customer_rows(spark, folder), path, list(CUSTOMER_COLUMNS))
    rows, header = read_csv_rows(spark, path, multiline=False)
    return fl.to_wide(rows, header, keep=())


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text, CASE WHEN lang = 'en' THEN source END AS source FROM documents")
def jsonl_round_trip(spark, folder):
    """Ragged rows as JSON lines and back; absent columns stay absent."""
    from rollbook.operators.sinks import write_jsonl
    from rollbook.session import shared_folder

    documents = table(spark, folder, "documents")
    source = F.when(F.col("lang") == "en", F.col("source"))
    rows = fl.from_wide(
        documents.select(F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("id"), "text", source.alias("source")),
        ["id", "text", "source"],
        keep=("ordinal",),
    )
    path = shared_folder(spark, "jsonl")
    write_jsonl(rows, path)
    return spark.read.schema("id string, text string, source string").json(path)
