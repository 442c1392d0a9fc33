"""Governance and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.model import register_catalog
from rollbook.operators import quality
from rollbook.operators import snapshots as sn
from rollbook.plans.queries.base import customer_rows, document_rows, query, rows_of, table
from rollbook.plans.queries.snapshots import _SQL_CUSTOMER_JSON


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal >= 2500")
def without_personal_data(spark, folder):
    """Institutions only; the gate lets the default selection pass."""
    balance = F.col("s_acctbal")
    kind = F.when(balance < 0, "PSD_BR").when(balance < 2500, "PSD_AG").otherwise("PSD_PI")
    rows = rows_of(table(spark, folder, "supplier"), "s_suppkey", {"EntityType": kind}, "s_suppkey")
    return quality.without_dependents(quality.personal_data_gate(rows, "eba-psd")).select("s_suppkey")


@query(
    """WITH p AS (SELECT source, doc_id // 200 AS page, count(*) AS records, sum(n_chars) AS chars FROM documents GROUP BY ALL)
    SELECT source, CAST(sum(records) AS BIGINT) AS collected, CAST(max(records) * 3 AS BIGINT) AS reported,
      CAST(greatest(max(records) * 3 - sum(records), 0) AS BIGINT) AS missing,
      CASE WHEN sum(records) < max(records) * 3 THEN 'fewer records than reported' END AS warning FROM p GROUP BY source"""
)
def completeness(spark, folder):
    """What pages report in total against what they hold, per register."""
    documents = table(spark, folder, "documents")
    pages = documents.groupBy("source", F.floor(F.col("doc_id") / 200).alias("page")).agg(F.count(F.lit(1)).alias("records"))
    listed = pages.withColumn("total", F.col("records") * 3)
    return quality.completeness(listed, "source").select("source", "collected", "reported", "missing", "warning")


@query("SELECT CAST(o_orderkey // 200 AS BIGINT) AS page, count(*) AS records, CAST(max(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def page_totals(spark, folder):
    """Reported totals and held records, read from the pages themselves."""
    orders = table(spark, folder, "orders")
    pages = orders.groupBy(F.floor(F.col("o_orderkey") / 200).cast("bigint").alias("page")).agg(
        F.max("o_custkey").alias("total"), F.array_join(F.collect_list(F.lit("{}")), ",").alias("list")
    )
    body = F.concat(F.lit('{"pagination":{"totalRecords":'), F.col("total").cast("string"), F.lit('},"data":['), "list", F.lit("]}"))
    totals = quality.page_totals(pages.select(F.col("page").alias("file"), body.alias("body")), "$.pagination.totalRecords", "data")
    return totals.select(F.col("file").alias("page"), "records", "total")


@query("SELECT count(*) AS rows, 'missing fields' AS state, 'ghost' AS missing FROM documents")
def schema_drift(spark, folder):
    """Are the expected columns still there?"""
    drift = quality.schema_drift(document_rows(spark, folder), ["text", "lang", "ghost"])
    return drift.select("rows", "state", F.array_join("missing", ",").alias("missing"))


@query(
    """WITH e AS (SELECT source, unnest(['en', 'de', 'fr', 'es', 'xx']) AS field FROM (SELECT DISTINCT source FROM documents))
    SELECT source, field FROM e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = e.source AND d.lang = e.field)"""
)
def schema_drift_by_register(spark, folder):
    """Missing columns of all registers in one job."""
    documents = table(spark, folder, "documents")
    rows = documents.select("source", F.create_map("lang", "source").alias("fields"))
    expected = documents.select("source").distinct().select("source", F.explode(F.array(*map(F.lit, ("en", "de", "fr", "es", "xx")))).alias("field"))
    return quality.schema_drift_by(rows, expected, "source")


@query(
    """SELECT page_id, sha256(html) AS actual, CASE WHEN contains(url, '#') THEN sha256(url) WHEN contains(url, '?') THEN NULL ELSE sha256(html) END AS expected,
      NOT contains(url, '#') AS ok FROM pages"""
)
def file_integrity(spark, folder):
    """Digests of bodies against published ones, given bare or as a checksum line."""
    pages = table(spark, folder, "pages")
    files = pages.select(F.col("page_id").alias("file"), F.sha2("html", 256).alias("actual"))
    published = (
        F.when(F.contains("url", F.lit("#")), F.sha2("url", 256))
        .when(F.contains("url", F.lit("?")), F.lit(" "))
        .otherwise(F.concat(F.upper(F.sha2("html", 256)), F.lit("  page.html\n")))
    )
    compared = quality.compare_digests(files, pages.select(F.col("page_id").alias("file"), published.alias("digest")))
    return compared.select(F.col("file").alias("page_id"), "actual", "expected", "ok")


@query(
    f"""SELECT c_custkey, sha256({_SQL_CUSTOMER_JSON}) AS row_hash, 'd' || (SELECT count(*) FROM customer) AS body_digest, 'Swiss authorisation holders' AS title,
      'not stated by the publisher' AS data_licence, 'CH' AS jurisdiction, 'identifier' AS matched_on FROM customer"""
)
def evidence_table(spark, folder):
    """Rows with everything a receipt states about where they come from."""
    rows = sn.with_keys(customer_rows(spark, folder), ["id"]).withColumn("source", F.lit("finma")).withColumn("stamp", F.lit("s"))
    total = F.count(F.lit(1))
    header = rows.groupBy("source", "stamp").agg(total.alias("row_count")).select(
        "source", "stamp", F.lit("").alias("captured_at"), "row_count", F.concat(F.lit("d"), F.col("row_count").cast("string")).alias("body_digest"),
        F.array(F.lit("id")).alias("key_columns"), F.lit("").alias("select"), F.lit("").alias("query"),
    )
    evidence = quality.evidence_table(rows, header, register_catalog(spark), subject="all", matched_on="identifier")
    return evidence.select(
        F.col("row_key").cast("bigint").alias("c_custkey"), "row_hash", "body_digest", "title", "data_licence", "jurisdiction", "matched_on"
    )
