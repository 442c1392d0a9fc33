"""Registry and the derived tables that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.codes import map_of
from rollbook.sizing import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL it must agree with."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(column: str) -> Column:
    """Two decimals as text, spelled alike by every engine."""
    return F.col(column).cast("decimal(18,2)").cast("string")


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def sql_money(column: str) -> str:
    return f"CAST(CAST({column} AS DECIMAL(18,2)) AS VARCHAR)"


def sql_day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def sql_fold(text: str) -> str:
    return f"translate(replace(lower({text}), 'ß', 'ss'), 'ςſ', 'σs')"


def rows_of(df: DataFrame, ordinal: str, columns: dict[str, Column | str], *keep: Column | str) -> DataFrame:
    """A typed table as register rows."""
    fields = map_of({n: F.col(c).cast("string") if isinstance(c, str) else c for n, c in columns.items()})
    return df.select(F.col(ordinal).cast("bigint").alias("ordinal"), fields.alias("fields"), *keep)


def customer_rows(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    return rows_of(
        customer,
        "c_custkey",
        {"id": "c_custkey", "name": "c_name", "nation": "c_nationkey", "balance": money("c_acctbal"), "segment": "c_mktsegment"},
    )


CUSTOMER_COLUMNS = ("id", "name", "nation", "balance", "segment")


def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return rows_of(documents, "doc_id", {"text": "text", "lang": "lang", "source": "source"}, "doc_id")


# Lines have no key of their own.  Their arrival order is the line number and then
# a digest of the line, so equal lines are interchangeable.
LINE_SPAN = 1 << 52
#: A span that holds all lines of an order, which are few.
WHOLE = 1 << 62


def line_order() -> Column:
    text = F.concat_ws(
        "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", money("l_extendedprice"), "l_returnflag", day("l_shipdate")
    )
    digest = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return F.col("l_linenumber").cast("bigint") * F.lit(LINE_SPAN) + digest


SQL_LINE_ORDER = f"""(CAST(l_linenumber AS BIGINT) * {LINE_SPAN} + CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey,
    l_suppkey, l_linenumber, {sql_money('l_extendedprice')}, l_returnflag, {sql_day('l_shipdate')})), 1, 13) AS BIGINT))"""


def order_documents(spark: SparkSession, folder: str, lines: str = "true") -> DataFrame:
    """Orders as parent documents, lines as children in a bucket per return flag.

    ``lines`` is a condition on the lines that have been published.
    """
    root = lambda key: F.concat(F.lit("o"), F.col(key).cast("string"))
    parents = spread(table(spark, folder, "orders")).select(
        F.lit(0).cast("bigint").alias("ordinal"),
        map_of(
            {
                "id": root("o_orderkey"), "_root_": root("o_orderkey"), "type_s": F.lit("parent"), "entity_type": F.lit("order"),
                "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "total": money("o_totalprice"),
                "_version_": F.col("o_custkey"),
            }
        ).alias("fields"),
    )
    children = spread(table(spark, folder, "lineitem").filter(lines)).select(
        line_order().alias("ordinal"),
        map_of(
            {
                "_root_": root("l_orderkey"), "type_s": F.lit("child"), "entity_type": F.concat(F.lit("line"), "l_returnflag"),
                "part": F.col("l_partkey"), "price": money("l_extendedprice"), "shipped": day("l_shipdate"),
            }
        ).alias("fields"),
    )
    return parents.unionByName(children)


def order_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the orders, an earlier and a later one.

    Earlier: orders that are not open yet are missing.  Later: finished ones have
    left, urgent ones of the rest are finished, low-priority ones were repriced.
    """
    orders = spread(table(spark, folder, "orders"))
    base = {"key": "o_orderkey", "customer": "o_custkey", "priority": "o_orderpriority"}
    old = rows_of(
        orders.filter("o_orderstatus <> 'O'"), "o_orderkey", {**base, "status": "o_orderstatus", "total": money("o_totalprice"), "note": F.lit("")}
    )
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    status = F.when(urgent, "F").otherwise(F.col("o_orderstatus"))
    total = F.when(low, F.concat(money("o_totalprice"), F.lit("0"))).otherwise(money("o_totalprice"))
    new = rows_of(
        orders.filter("o_orderstatus <> 'F'"), "o_orderkey", {**base, "status": status, "total": total, "timestamp": F.lit("now")}
    )
    return old, new


SQL_ORDER_VERSIONS = f"""
old AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority,
        o_orderstatus AS status, {sql_money('o_totalprice')} AS total FROM orders WHERE o_orderstatus <> 'O'),
new AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END AS status,
        {sql_money('o_totalprice')} || CASE WHEN o_orderpriority = '5-LOW' THEN '0' ELSE '' END AS total
        FROM orders WHERE o_orderstatus <> 'F'),
events AS (SELECT coalesce(n.k, o.k) AS k,
        CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS kind,
        CASE WHEN o.k IS NULL OR n.k IS NULL THEN '' ELSE concat_ws(' | ',
          CASE WHEN o.status <> n.status THEN 'status' END, CASE WHEN o.total <> n.total THEN 'total' END) END AS columns,
        coalesce(n.status, o.status) AS status, coalesce(n.total, o.total) AS total,
        o.status AS old_status, o.total AS old_total, n.k AS new_k
        FROM old o FULL JOIN new n ON o.k = n.k
        WHERE o.k IS NULL OR n.k IS NULL OR o.status <> n.status OR o.total <> n.total)"""
