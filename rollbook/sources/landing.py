"""Landed response bodies: files to numbered pages, pages to documents."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.text import is_object, members, variant_cell

#: Documents of one page have ordinals ``page * PAGE_STEP + position``.
PAGE_STEP = 1 << 32

#: A task numbers its rows with this many bits (``monotonically_increasing_id``).
_PLACE_BITS = 33

#: What the recorder of a fetch leaves beside the bodies.
MANIFEST_FILE = "manifest.jsonl"

#: Levels of a nested value that are opened before the data are asked for more.
_ROUNDS = 6


def strip_nul(value: Column) -> Column:
    return F.translate(value, "\x00", "")


def _file_key(path: str) -> tuple[int, str, str]:
    """Order of landed files: the number a name starts with, else the last number in it, else 0; then name and path."""
    name = os.path.basename(path)
    number = re.match(r"\d+", name) or re.search(r"\d+(?=\D*$)", name)
    return int(number[0]) if number else 0, name, path


def file_order(scan: DataFrame) -> list[str]:
    """Paths of the files of ``scan`` in their order.  Spark's driver holds the list of a scan's files anyway."""
    return sorted({re.sub("^file:/+", "/", f) for f in scan.inputFiles()}, key=_file_key)


def file_path() -> Column:
    """The path of the file a row comes from, spelled as in :func:`file_order`."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")


def read_bodies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, page, body``: one row per landed file, NULs removed; ``page`` counts the files in order."""
    text = spark.read.text(path, wholetext=True)
    pages = spark.createDataFrame(list(enumerate(file_order(text))), "page bigint, _path string")
    bodies = text.select(
        file_path().alias("_path"), F.col("_metadata.file_name").alias("file"), strip_nul(F.col("value")).alias("body")
    )
    return bodies.join(pages, "_path").filter(F.col("file") != MANIFEST_FILE).select("file", "page", "body")


def with_ordinals(scan: DataFrame, *columns: Column | str, first_rank: int = 0) -> DataFrame:
    """``columns`` of a file scan with a unique ``ordinal`` in arrival order, without a shuffle.

    Splits are ranked by file and start; a row's ordinal is the rank of its split and its place among the rows
    of its task, which Spark itself numbers with 33 bits.  The splits, one or a few per task, are listed
    by a pass that reads no columns.  Ranks begin at ``first_rank``.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    rows = scan.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), place.alias("_place"), *columns
    )
    splits = [(r["_path"], r["_start"]) for r in rows.select("_path", "_start").distinct().collect()]
    splits.sort(key=lambda s: (_file_key(s[0]), s[1]))
    ranks = scan.sparkSession.createDataFrame(
        [(*s, rank) for rank, s in enumerate(splits, first_rank)], "_path string, _start bigint, _rank bigint"
    )
    ordinal = F.shiftleft("_rank", _PLACE_BITS) + F.col("_place")
    kept = [c for c in rows.columns if c not in ("_path", "_start", "_place")]
    return rows.join(ranks, ["_path", "_start"]).select(ordinal.alias("ordinal"), *[F.col(f"`{c}`") for c in kept])


#: One line per landed body, as the recorder of a fetch writes it.
MANIFEST = (
    "seq bigint, file string, url string, status int, content_type string, content_length bigint, "
    "last_modified string, fetched_at string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The requests of a fetch: ``url, status, bytes`` and what else was noted."""
    return spark.read.schema(MANIFEST).json(path).withColumn("bytes", F.col("content_length"))


#: A run as reported by the tool that landed the files.
RUN_RECORD = (
    "run_id string, started_at string, finished_at string, sources bigint, ok bigint, failed bigint, skipped bigint, "
    "rows bigint, added bigint, changed bigint, removed bigint, seconds double, phases map<string,double>, "
    "http struct<requests:bigint,retries:bigint,failures:bigint,bytes_in:bigint,seconds_requesting:double,"
    "seconds_waiting:double,by_status:map<string,bigint>,by_host:map<string,bigint>,by_outcome:map<string,bigint>,"
    "slowest:array<struct<seconds:double,method:string,url:string>>>"
)


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per run file, newest last by id; a truncated file stays, flagged."""
    from rollbook.operators.stats import readable_runs

    bodies = read_bodies(spark, path)
    texts = bodies.select(F.regexp_replace("file", r"\.json$", "").alias("run_id"), "body")
    return readable_runs(texts, RUN_RECORD)


def page_documents(bodies: DataFrame, *path: str) -> DataFrame:
    """``ordinal, doc``: the array at ``path`` of every page, in page order.

    The page is read with a schema down to the array, so only its members become
    VARIANT values and no page has to fit one.
    """
    schema = "array<variant>"
    for name in reversed(path):
        schema = f"struct<`{name}`:{schema}>"
    array = F.from_json("body", schema, {"maxStringLen": "2147483647"})
    for name in path:
        array = array[name]
    return bodies.select("page", F.posexplode(array).alias("position", "doc")).select(
        (F.col("page") * F.lit(PAGE_STEP) + F.col("position")).alias("ordinal"), "doc"
    )


def cells(doc: Column, *, skip_blank: bool = False) -> Column:
    """A JSON object as ragged fields, every member rendered as one cell."""
    return F.transform_values(members(doc), lambda _, v: variant_cell(v, skip_blank=skip_blank))


def as_rows(documents: DataFrame, fields: Column) -> DataFrame:
    """Documents that are JSON objects as rows; anything else holds no record."""
    return documents.filter(is_object(F.col("doc"))).select("ordinal", fields.alias("fields"))


def unnested(table: DataFrame, value: Column, open_node, can_open, *, into: str = "nodes") -> DataFrame:
    """Add the nodes of a nested JSON value, opened by ``open_node`` until ``can_open`` holds for none.

    A node is ``key`` (dotted path) and ``value``; ``open_node`` maps one node to
    an array of nodes.  Each round is its own projection, which keeps the
    expressions small for the analyser.  After some rounds the table is asked whether
    anything is left to open.
    """
    root = F.array(F.struct(F.lit("").alias("key"), value.alias("value")))
    table = table.withColumn(into, root)
    while True:
        for _ in range(_ROUNDS):
            table = table.withColumn(into, F.flatten(F.transform(into, open_node)))
        if table.filter(F.exists(into, lambda n: can_open(n["value"]))).isEmpty():
            return table
