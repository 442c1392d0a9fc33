"""JSON pages: device actors, clinical trials, legal entities, notices, VAT answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import codes
from rollbook.functions.text import (
    SEPARATOR,
    is_json_null,
    is_list,
    is_object,
    let,
    list_of,
    members,
    merge_maps,
    split_literal,
    strip,
    variant_cell,
    variant_json,
)
from rollbook.sources import selection
from rollbook.sources.landing import PAGE_STEP, as_rows, cells, page_documents, read_bodies, unnested

_ENTRIES = "array<struct<key:string,value:string>>"


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.cast("string").alias("value"))


def _nested(value: Column) -> Column:
    return is_list(value) | is_object(value)


def _strings(value: Column, path: str) -> Column:
    """Non-blank strings at ``path`` of every member of a list, joined."""
    found = F.transform(list_of(value), lambda v: F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))
    return F.coalesce(F.array_join(F.filter(found, lambda t: t != ""), SEPARATOR), F.lit(""))


def _path(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _actor_entries(name: Column, value: Column) -> Column:
    """One member of an actor record as one or more columns."""
    plain_list = F.coalesce(~F.exists(list_of(value), lambda v: _nested(v) | is_json_null(v)), F.lit(False))
    extras = F.filter(
        F.array(
            _entry(name, _path(value, "$.code")),
            *[
                _entry(F.concat(name, F.lit(f"_{extra}")), _path(value, f"$.{extra}"))
                for extra in ("srnCode", "category", "name")
            ],
        ),
        lambda e: e["value"].isNotNull(),
    )
    country = F.array(
        _entry(name, F.coalesce(_path(value, "$.isoCode"), F.lit(""))),
        _entry(F.concat(name, F.lit("_name")), F.coalesce(_path(value, "$.name"), F.lit(""))),
    )
    laws = F.array(
        _entry(F.lit("legislationCodes"), _strings(value, "$.legislationCode")),
        _entry(F.lit("legislationLinks"), _strings(value, "$.link")),
    )
    texts = F.array(_entry(name, _strings(F.try_variant_get(value, "$.texts", "variant"), "$.text")))
    return (
        F.when(~_nested(value), F.array(_entry(name, variant_cell(value))))
        .when(plain_list, F.array(_entry(name, variant_cell(value))))
        .when(name.isin("names", "abbreviatedNames"), texts)
        .when((name == "legislationLinks") & is_list(value), laws)
        .when(_path(value, "$.code").isNotNull(), extras)
        .when(_path(value, "$.isoCode").isNotNull(), country)
        .otherwise(F.array(_entry(name, variant_json(value))))
    )


def actor_rows(documents: DataFrame, actor_types: str | None = None) -> DataFrame:
    """Actor records as rows: reference data by code, texts joined, the rest kept as JSON."""
    wanted = selection.actor_types(actor_types)
    if wanted:
        documents = documents.filter(F.try_variant_get("doc", "$.actorType.code", "string").isin(wanted))
    entries = F.flatten(
        F.transform(F.map_entries(members(F.col("doc"))), lambda e: _actor_entries(e["key"], e["value"]))
    )
    return as_rows(documents, codes.entries_to_map(entries))


def read_eudamed_pages(spark: SparkSession, path: str, actor_types: str | None = None) -> DataFrame:
    return actor_rows(page_documents(read_bodies(spark, path), "content"), actor_types)


def trial_rows(documents: DataFrame) -> DataFrame:
    """Trial records as rows; blanks inside lists are skipped."""
    return as_rows(documents, cells(F.col("doc"), skip_blank=True))


def read_ctis_pages(spark: SparkSession, path: str) -> DataFrame:
    return trial_rows(page_documents(read_bodies(spark, path), "data"))


def _opened(node: Column) -> Column:
    """An object as its members with a longer path, anything else as it is."""
    prefix = F.when(node["key"] != "", F.concat(node["key"], F.lit("."))).otherwise("")
    inner = F.transform(
        F.map_entries(members(node["value"])),
        lambda m: F.struct(F.concat(prefix, m["key"]).alias("key"), m["value"].alias("value")),
    )
    return F.coalesce(inner, F.array(node))


def collapse_nested(table: DataFrame, value: Column, *, into: str = "fields") -> DataFrame:
    """Add a nested JSON object as a map of dotted paths.

    Nulls and empty lists have no path.  Lists of plain values are joined without
    blanks, other lists stay JSON.
    """

    def has_text(n: Column) -> Column:
        node = n["value"]
        return ~is_json_null(node) & (F.coalesce(F.size(list_of(node)), F.lit(1)) != 0)

    def leaf(n: Column) -> Column:
        node = n["value"]
        listed = F.exists(list_of(node), _nested)
        text = F.when(listed, variant_json(node)).otherwise(variant_cell(node, depth=1, skip_blank=True))
        return _entry(n["key"], text)

    opened = unnested(table, value, _opened, is_object, into="_nodes")
    leaves = F.transform(F.filter("_nodes", has_text), leaf)
    return opened.withColumn(into, codes.entries_to_map(leaves)).drop("_nodes")


def legal_entity_rows(documents: DataFrame, countries: str | None = None) -> DataFrame:
    """Legal entity records as rows of dotted paths, keyed by the record id."""
    wanted = selection.countries_alpha2(countries)
    if wanted:
        country = F.try_variant_get("doc", "$.attributes.entity.legalAddress.country", "string")
        documents = documents.filter(country.isin(wanted))
    lei = F.create_map(F.lit("lei"), F.coalesce(F.try_variant_get("doc", "$.id", "string"), F.lit("")))
    attributes = F.try_variant_get("doc", "$.attributes", "variant")
    flat = collapse_nested(documents.filter(is_object(F.col("doc"))), attributes)
    return flat.select("ordinal", merge_maps(lei, F.col("fields")).alias("fields"))


def read_gleif_pages(spark: SparkSession, path: str, countries: str | None = None) -> DataFrame:
    return legal_entity_rows(page_documents(read_bodies(spark, path), "data"), countries)


def _texts_by_language(value: Column) -> Column:
    return F.transform_values(members(value), lambda _, v: variant_cell(v, skip_blank=True))


def _notice_entries(name: Column, value: Column) -> Column:
    text = codes.pick_language(_texts_by_language(value))
    names = codes.distinct_parts(F.transform(split_literal(text, SEPARATOR), strip))
    listed = codes.distinct_parts(F.transform(list_of(value), lambda v: variant_cell(v)))
    return (
        F.when(name == "links", F.array().cast(_ENTRIES))
        .when(
            is_object(value) & (name == "winner-name"),
            let(
                names,
                lambda w: F.array(_entry(F.lit("winner_count"), F.size(w)), _entry(name, F.array_join(w, SEPARATOR))),
            ),
        )
        .when(is_object(value), F.array(_entry(name, text)))
        .when(is_list(value), F.array(_entry(name, F.array_join(listed, SEPARATOR))))
        .otherwise(F.array(_entry(name, variant_cell(value))))
    )


def notice_rows(documents: DataFrame, countries: str | None = None) -> DataFrame:
    """Procurement notices as rows: one language per text, repeats removed."""
    wanted = selection.countries_alpha3(countries)
    if wanted:
        buyers = F.try_variant_get("doc", "$.buyer-country", "array<string>")
        documents = documents.filter(F.arrays_overlap(buyers, F.array(*map(F.lit, wanted))))
    entries = F.flatten(
        F.transform(F.map_entries(members(F.col("doc"))), lambda e: _notice_entries(e["key"], e["value"]))
    )
    return as_rows(documents, codes.entries_to_map(entries))


def read_ted_pages(spark: SparkSession, path: str, countries: str | None = None) -> DataFrame:
    return notice_rows(page_documents(read_bodies(spark, path), "notices"), countries)


def vat_rows(bodies: DataFrame) -> DataFrame:
    """VAT answers as rows; objects give ``name.inner`` columns.

    The country of the request stands in where the answer names none.  It is read
    from the file name (``..-DE.json``) unless ``bodies`` has a ``country`` column.
    """
    if "country" not in bodies.columns:
        bodies = bodies.withColumn("country", F.regexp_extract("file", r"-([A-Z]{2})\.[^.]*$", 1))

    def spread(name: Column, value: Column) -> Column:
        inner = F.transform(
            F.map_entries(members(value)),
            lambda e: _entry(F.concat(name, F.lit("."), e["key"]), variant_cell(e["value"])),
        )
        return F.when(is_object(value), inner).otherwise(F.array(_entry(name, variant_cell(value))))

    documents = bodies.select(
        (F.col("page") * PAGE_STEP).alias("ordinal"), "country", F.try_parse_json("body").alias("doc")
    )
    entries = F.flatten(F.transform(F.map_entries(members(F.col("doc"))), lambda e: spread(e["key"], e["value"])))
    answer = codes.entries_to_map(entries)
    asked = F.when(F.col("country") != "", F.create_map(F.lit("countryCode"), F.col("country"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    return documents.select("ordinal", merge_maps(asked, answer).alias("fields"))


def read_vies_answers(spark: SparkSession, path: str) -> DataFrame:
    return vat_rows(read_bodies(spark, path))


def vat_status_rows(bodies: DataFrame) -> DataFrame:
    """One row per member state: does its system answer?"""
    schema = "vow struct<available:string>, countries array<struct<countryCode:string,availability:string>>"
    doc = F.from_json("body", schema)
    parsed = bodies.select("page", doc.alias("doc")).select(
        "page", F.col("doc.vow.available").alias("vow"), F.posexplode("doc.countries").alias("position", "c")
    )
    fields = codes.map_of(
        {
            "countryCode": F.coalesce("c.countryCode", F.lit("")),
            "availability": F.coalesce("c.availability", F.lit("")),
            "vow_available": F.coalesce("vow", F.lit("")),
        }
    )
    return parsed.select((F.col("page") * PAGE_STEP + F.col("position")).alias("ordinal"), fields.alias("fields"))


def split_vat(table: DataFrame, column: str) -> DataFrame:
    """Every VAT number of a text column, split; what is none is flagged, not dropped.

    A cell may list several numbers separated by commas or semicolons, each with
    or without a leading ``vat=``.
    """
    names = r"(?i)^\s*(?:vat|vat_number|number)\s*=\s*"
    items = F.filter(F.transform(F.split(column, "[,;]"), strip), lambda v: v != "")
    exploded = table.select("*", F.posexplode(items).alias("item_position", "item"))
    parsed = codes.vat_number(F.regexp_replace("item", names, ""))
    return exploded.withColumn("vat", parsed).select(
        *table.columns,
        "item_position",
        "item",
        F.col("vat.country").alias("country"),
        F.col("vat.number").alias("number"),
        F.col("vat").isNotNull().alias("parses"),
    )
