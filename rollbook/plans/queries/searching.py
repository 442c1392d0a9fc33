"""Filters and the report on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import filters as ft
from rollbook.operators.flatten import to_wide
from rollbook.plans.queries.base import (
    CUSTOMER_COLUMNS,
    customer_rows,
    document_rows,
    money,
    query,
    sql_fold,
    sql_money,
    table,
)



@query(
    f"""SELECT doc_id FROM documents WHERE contains({sql_fold('text')}, 'und ') AND
      (contains({sql_fold('text')}, 'src1') OR contains({sql_fold('lang')}, 'src1') OR contains({sql_fold('source')}, 'src1'))"""
)
def contains_any(spark, folder):
    """Both needles occur somewhere in the row, whatever the column and case."""
    return ft.contains_any(document_rows(spark, folder), ["UND ", "", "Src1"]).select("doc_id")


@query(
    f"""SELECT p_partkey, p_name, {sql_money('p_retailprice')} AS price FROM part
      WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring'))"""
)
def contains_any_typed(spark, folder):
    """The same search over columns of a typed table."""
    hits = ft.contains_any_wide(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"], ["RING"])
    return hits.select("p_partkey", "p_name", money("p_retailprice").alias("price"))


_CUSTOMER_SQL = f"CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, {sql_money('c_acctbal')} AS balance, c_mktsegment AS segment"


@query(f"SELECT {_CUSTOMER_SQL} FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def field_equals(spark, folder):
    """Trimmed equality without regard to case; an absent column equals a blank."""
    tests = [ft.parse_field_test("segment= building "), ("nation", "7"), ("lei", "")]
    return to_wide(ft.field_equals(customer_rows(spark, folder), tests), CUSTOMER_COLUMNS, keep=())


@query(f"SELECT {_CUSTOMER_SQL} FROM customer WHERE contains(lower(c_mktsegment), 'mach') ORDER BY c_custkey LIMIT 25")
def first_matches(spark, folder):
    """The first matches in order of arrival."""
    hits = ft.apply_filters(customer_rows(spark, folder), contains=["mach"], limit=25)
    return to_wide(hits, CUSTOMER_COLUMNS, keep=())


@query(
    """SELECT c_custkey AS ordinal, (SELECT count(*) FROM customer) AS total_rows, CAST(least(40, (SELECT count(*) FROM customer
      WHERE c_mktsegment = 'FURNITURE')) AS BIGINT) AS returned_rows, true AS truncated
    FROM customer WHERE c_mktsegment = 'FURNITURE' ORDER BY c_custkey LIMIT 40"""
)
def served_page(spark, folder):
    """A bounded answer that says whether it is the whole one."""
    page = ft.served_page(customer_rows(spark, folder), 40, fields={"segment": "furniture"})
    return page.select("ordinal", "total_rows", "returned_rows", "truncated")


@query(
    f"""SELECT count(*) AS input_rows, count(*) FILTER (c_mktsegment = 'BUILDING' AND (contains(c_name, '7')
        OR contains(CAST(c_nationkey AS VARCHAR), '7') OR contains({sql_money('c_acctbal')}, '7'))) AS output_rows,
      'ghost' AS missing, CAST(NULL AS VARCHAR) AS none_missing, CAST(0 AS BIGINT) AS none_left,
      'every row was filtered out' AS reason FROM customer"""
)
def filter_report(spark, folder):
    """What the filters kept, which tested columns exist nowhere, why nothing is left."""
    rows = customer_rows(spark, folder)
    some = ft.filter_report(rows, contains=["7"], fields={"segment": "BUILDING", "ghost": ""})
    none = ft.filter_report(rows, contains=["no such words"])
    return some.select(
        "input_rows", "output_rows", F.array_join("missing_fields", ",").alias("missing")
    ).join(
        none.select(
            F.nullif(F.array_join("missing_fields", ","), F.lit("")).alias("none_missing"),
            F.col("output_rows").alias("none_left"),
            "reason",
        )
    )


@query("SELECT count(*) AS scanned, count(*) FILTER (c_nationkey = 3) AS kept FROM customer")
def observed_scan(spark, folder):
    """How many rows a filter saw and kept, as a by-product of one scan."""
    kept, seen = ft.observed_filter(customer_rows(spark, folder), ft.field_condition({"nation": "3"}), "scan")
    kept.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["scanned"], seen.get["kept"])], "scanned bigint, kept bigint")


_SQL_KIND = """CASE WHEN s_acctbal < 2000 THEN 'PSD_AG' WHEN s_acctbal < 4000 THEN 'PSD_BR' WHEN s_acctbal < 7000 THEN 'PSD_PI'
      ELSE 'PSD_EMI' END"""


@query(f"SELECT * FROM (SELECT s_suppkey, {_SQL_KIND} AS kind FROM supplier) WHERE kind IN ('PSD_PI', 'PSD_EMI')")
def select_types(spark, folder):
    """A selection as users write it, resolved to type codes."""
    from rollbook.sources.selection import institution_types

    balance = F.col("s_acctbal")
    kinds = F.when(balance < 2000, "PSD_AG").when(balance < 4000, "PSD_BR").when(balance < 7000, "PSD_PI").otherwise("PSD_EMI")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", kinds.alias("kind"))
    return suppliers.filter(F.col("kind").isin(institution_types("institutions; emi")))
