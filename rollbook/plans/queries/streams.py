"""Streams of rows against the state of their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.plans.queries.base import day, line_order, query, rows_of, SQL_LINE_ORDER, sql_day, table


@query(
    f"""WITH firsts AS (
      SELECT l_orderkey AS k, {sql_day('l_shipdate')} AS stamp, arg_min(row(l_returnflag, l_linestatus), {SQL_LINE_ORDER}) AS f FROM lineitem GROUP BY 1, 2),
    told AS (SELECT k, stamp, f, lag(f) OVER (PARTITION BY k ORDER BY stamp) AS p FROM firsts)
    SELECT CAST(k AS VARCHAR) AS row_key, stamp, CASE WHEN p IS NULL THEN 'added' ELSE 'changed' END AS kind,
      CASE WHEN p IS NULL THEN '' ELSE concat_ws(',', CASE WHEN f[1] <> p[1] THEN 'flag' END, CASE WHEN f[2] <> p[2] THEN 'status' END) END AS columns
    FROM told WHERE p IS NULL OR f <> p"""
)
def stream_row_changes(spark, folder):
    """Events of a stream that brings one year of lines after the other, each compared with the state that the years before left."""
    from rollbook.session import shared_folder
    from rollbook.streaming.changes import follow_rows, read_row_changes

    lines = table(spark, folder, "lineitem").withColumn("at", line_order()).withColumn("year", F.year("l_shipdate"))
    rows = rows_of(
        lines, "at", {"flag": "l_returnflag", "status": "l_linestatus"},
        F.lit("orders").alias("source"), day("l_shipdate").alias("stamp"), F.col("l_orderkey").cast("string").alias("row_key"), "year",
    )
    base = shared_folder(spark, "stream")
    for year in sorted(r.year for r in rows.select("year").distinct().collect()):
        # A year lands in as many files as tasks write it, and one batch takes all that is new.
        rows.where(F.col("year") == year).drop("year").write.mode("append").parquet(f"{base}/landed")
        stream = spark.readStream.schema(spark.read.parquet(f"{base}/landed").schema).parquet(f"{base}/landed")
        follow_rows(stream, f"{base}/out", f"{base}/marks").awaitTermination()
    events = read_row_changes(spark, f"{base}/out")
    return events.select("row_key", "stamp", "kind", F.array_join("columns", ",").alias("columns"))
