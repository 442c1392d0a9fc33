"""Replies of the enterprise register, as XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.keys import printed_uid
from rollbook.functions.text import SEPARATOR, is_list, is_object, list_of, members, merge_maps, strip
from rollbook.sources.landing import unnested, with_ordinals

# Elements that hold one organisation, and wrappers without meaning.
ITEM_TAG = "uidEntitySearchResultItem"
DIRECT_TAG = "organisationType"
WRAPPERS = ("organisationType", "organisation")
UID_CATEGORY = "organisationIdentification.uid.uidOrganisationIdCategorie"
UID_NUMBER = "organisationIdentification.uid.uidOrganisationId"
ITEM_EXTRAS = ("rating", "isHistoryMatch")

def _opened(node: Column) -> Column:
    """An element as its children with a longer path, a repeated one as its copies."""

    def child(m: Column) -> Column:
        name = F.regexp_replace(m["key"], "^.*:", "")
        step = F.when(~name.isin(*WRAPPERS), name)
        return F.struct(F.concat_ws(".", F.nullif(node["key"], F.lit("")), step).alias("key"), m["value"].alias("value"))

    def copy(v: Column) -> Column:
        return F.struct(node["key"].alias("key"), v.alias("value"))

    children = F.transform(F.map_entries(members(node["value"])), child)
    return F.coalesce(children, F.transform(list_of(node["value"]), copy), F.array(node))


def organisation_fields(table: DataFrame, doc: Column) -> DataFrame:
    """Add ``fields``: one organisation as dotted columns, repeated paths joined.

    The two halves of the identification number become one printed ``uid``.
    """

    def text(n: Column) -> Column:
        return F.struct(n["key"].alias("key"), strip(F.coalesce(n["value"].cast("string"), F.lit(""))).alias("value"))

    opened = unnested(table, doc, _opened, lambda v: is_object(v) | is_list(v), into="_nodes")
    entries = opened.withColumn("_nodes", F.filter(F.transform("_nodes", text), lambda t: t["value"] != ""))
    names = F.array_distinct(F.transform("_nodes", lambda e: e["key"]))
    joined = F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(
                n.alias("key"),
                F.array_join(
                    F.transform(F.filter("_nodes", lambda e: e["key"] == n), lambda e: e["value"]), SEPARATOR
                ).alias("value"),
            ),
        )
    )
    whole = entries.withColumn("fields", joined).drop("_nodes")
    fields = F.col("fields")
    uid = F.create_map(F.lit("uid"), printed_uid(fields[UID_CATEGORY], fields[UID_NUMBER]))
    rest = F.map_filter(fields, lambda k, _: ~k.isin(UID_CATEGORY, UID_NUMBER))
    return whole.withColumn("fields", merge_maps(uid, rest))


def _elements(spark: SparkSession, path: str, tag: str) -> DataFrame | None:
    """One row per element as JSON text; NULL if the files have none.

    Values are read as text, so a code such as ``0151`` keeps its zero.
    """
    reader = spark.read.format("xml").option("rowTag", tag).option("excludeAttribute", True).option("inferSchema", False)
    table = reader.load(path)
    columns = [c for c in table.columns if c != "_corrupt_record"]
    if not columns:
        return None
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    return with_ordinals(table, F.parse_json(body).alias("doc"))


def read_uid_xml(spark: SparkSession, path: str) -> DataFrame:
    """Every organisation of every reply, all seats included, as rows."""
    parts = []
    items = _elements(spark, path, ITEM_TAG)
    if items is not None:
        organisation = F.try_variant_get("doc", "$.organisation", "variant")
        extras = F.array(
            *[
                F.struct(F.lit(n).alias("key"), F.try_variant_get("doc", f"$.{n}", "string").alias("value"))
                for n in ITEM_EXTRAS
            ]
        )
        extra_map = F.map_from_entries(F.filter(extras, lambda e: F.coalesce(e["value"], F.lit("")) != ""))
        rows = organisation_fields(items, organisation)
        parts.append(rows.select("ordinal", merge_maps(F.col("fields"), extra_map).alias("fields")))
    direct = _elements(spark, path, DIRECT_TAG)
    if direct is not None:
        parts.append(organisation_fields(direct, F.col("doc")).select("ordinal", "fields"))
    if not parts:
        return spark.createDataFrame([], "ordinal bigint, fields map<string,string>")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def faults(spark: SparkSession, path: str) -> DataFrame:
    """Replies that report a fault instead of an answer: ``file, detail``."""
    bodies = spark.read.text(path, wholetext=True)
    has_fault = F.col("value").rlike(r"<(?:\w+:)?Fault[\s>]")
    detail = F.regexp_replace(F.regexp_extract("value", r"(?s)<(?:\w+:)?Fault[\s>].*", 0), r"(?s)<[^>]*>", " ")
    return bodies.filter(has_fault).select(F.col("_metadata.file_name").alias("file"), strip(detail).alias("detail"))
