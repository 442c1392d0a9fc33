"""The payment institution golden copy and its code lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import codes
from rollbook.functions.text import SEPARATOR, let, merge_maps, split_literal, strip, variant_cell
from rollbook.session import materialise
from rollbook.sources import selection
from rollbook.sources.landing import PAGE_STEP, as_rows, read_bodies, strip_nul, with_ordinals


def entity_documents(bodies: DataFrame) -> DataFrame:
    """``ordinal, doc`` of every entity in documents shaped ``[[...], [...]]``."""
    lists = F.from_json("body", "array<array<variant>>", {"maxStringLen": "2147483647"})
    exploded = bodies.select("page", F.posexplode(F.flatten(lists)).alias("position", "doc"))
    return _entities(exploded.select((F.col("page") * PAGE_STEP + F.col("position")).alias("ordinal"), "doc"))


def entity_lines(lines: DataFrame) -> DataFrame:
    """``ordinal, doc`` from one entity per line; the form that splits over tasks."""
    return _entities(lines.select("ordinal", F.try_parse_json("body").alias("doc")))


def _entities(documents: DataFrame) -> DataFrame:
    code = F.try_variant_get("doc", "$.EntityCode", "string")
    kind = F.try_variant_get("doc", "$.EntityType", "string")
    return documents.filter(code.isNotNull() & kind.isNotNull())


def _services(doc: Column) -> Column:
    """Country -> distinct service codes; a code may come bare or in a list."""
    blocks = F.try_variant_get(doc, "$.Services", "array<map<string,variant>>")

    def listed(value: Column) -> Column:
        codes_ = F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.array(value.cast("string")))
        return F.transform(codes_, lambda c: strip(F.coalesce(c, F.lit(""))))

    pairs = F.flatten(
        F.transform(
            F.coalesce(blocks, F.array().cast("array<map<string,variant>>")),
            lambda m: F.map_entries(F.transform_values(m, lambda _, v: listed(v))),
        )
    )

    def by_country(all_: Column) -> Column:
        countries = F.array_distinct(F.transform(all_, lambda p: p["key"]))
        return F.transform(countries, lambda c: F.struct(c.alias("key"), codes_of(all_, c).alias("value")))

    def codes_of(all_: Column, country: Column) -> Column:
        blocks_ = F.filter(all_, lambda p: p["key"] == country)
        return codes.distinct_parts(F.flatten(F.transform(blocks_, lambda p: p["value"])))

    return F.map_from_entries(let(pairs, by_country))


def institution_rows(entities: DataFrame, select: str | None = None) -> DataFrame:
    """Entities as rows: own properties, service footprint and version."""
    wanted = selection.institution_types(select)
    kind = F.try_variant_get("doc", "$.EntityType", "string")
    if wanted is not None:
        entities = entities.filter(kind.isin(wanted))
    doc = F.col("doc")

    def own(name: str) -> Column:
        return F.coalesce(F.try_variant_get(doc, f"$.{name}", "string"), F.lit(""))

    properties = F.transform(
        F.coalesce(
            F.try_variant_get(doc, "$.Properties", "array<map<string,variant>>"),
            F.array().cast("array<map<string,variant>>"),
        ),
        lambda m: F.transform_values(m, lambda _, v: variant_cell(v)),
    )
    head = codes.map_of({n: own(n) for n in ("CA_OwnerID", "EntityCode", "EntityType")})
    merged = F.aggregate(properties, head, merge_maps)
    tail = merge_maps(codes.passport_columns(_services(doc)), codes.map_of({"__EBA_EntityVersion": own("__EBA_EntityVersion")}))
    return as_rows(entities, merge_maps(merged, tail))


def read_eba_golden_copy(
    spark: SparkSession, path: str, select: str | None = None, *, lines: bool = False, code_lists: DataFrame | None = None
) -> DataFrame:
    """Payment institutions, with labels where ``code_lists`` is given.

    ``lines`` reads one entity per line, which splits over tasks; the published
    single document is parsed by one task.
    """
    if lines:
        lines = with_ordinals(spark.read.text(path), strip_nul(F.col("value")).alias("body"))
        entities = entity_lines(lines)
    else:
        entities = entity_documents(read_bodies(spark, path))
    rows = institution_rows(entities, select)
    return rows if code_lists is None else label_institutions(rows, code_lists)


def code_list_table(bodies: DataFrame) -> DataFrame:
    """``code_list, code, label`` from the register's metadata document."""
    schema = (
        "array<struct<CodeLists:array<struct<CodeListCode:string,`Values`:array<struct<CodeValue:string,"
        "CodeValueDisplay:string>>>>,ServiceDefinition:array<struct<CodeValue:string,CodeValueDisplay:string>>>>"
    )
    docs = bodies.select(F.inline(F.from_json("body", schema)))
    lists = docs.select(F.inline("CodeLists")).select("CodeListCode", F.inline("Values"))
    services = docs.select(F.lit("ServiceDefinition").alias("CodeListCode"), F.inline("ServiceDefinition"))
    return (
        lists.unionByName(services)
        .filter("CodeValue <> ''")
        .select(
            F.col("CodeListCode").alias("code_list"),
            F.col("CodeValue").alias("code"),
            F.coalesce("CodeValueDisplay", F.lit("")).alias("label"),
        )
        .dropDuplicates(["code_list", "code"])
    )


def read_code_lists(spark: SparkSession, path: str) -> DataFrame:
    return code_list_table(read_bodies(spark, path))


# Fixed values: (column, label column, code list, holds several codes).
LABELS = (
    ("EntityType", "EntityTypeLabel", "ENT_TYP_PSD", False),
    ("CA_OwnerID", "CA_OwnerName", "RDL_COM_AUT_PSD", False),
    ("ENT_COU_RES", "ENT_COU_RES_label", "RDL_COU_COD_EEA", False),
    ("ENT_SER", "ENT_SER_label", "ServiceDefinition", True),
    ("ENT_EXC", "ENT_EXC_label", "ENUM_ENT_EXC", True),
)


def label_codes(
    rows: DataFrame,
    code_lists: DataFrame,
    spec: Sequence[tuple[str, str, str, bool]],
    *,
    separator: str = SEPARATOR,
    optional: Sequence[str] = (),
) -> DataFrame:
    """Add label columns from a table ``code_list, code, label``.

    A single unknown code gets a blank label, an unknown member of a multi-valued
    cell keeps its code; blank members are left out.  Columns in ``optional`` get no label where they are
    absent.  Rows are told apart by a number of their own, written with them, so
    rows that share an ordinal keep their own labels.
    """
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "unlabelled")
    fields = F.col("fields")
    cells, blanks = [], []
    for column, target, code_list, several in spec:
        cell = F.coalesce(fields[column], F.lit(""))
        parts = F.filter(split_literal(cell, separator), lambda p: p != "") if several else F.array(cell)
        wanted = F.map_contains_key(fields, F.lit(column)) | F.lit(column not in optional)
        parts = F.when(wanted, parts)
        blanks.append(F.when(wanted, F.struct(F.lit(target).alias("key"), F.lit("").alias("value"))))
        named = (F.lit(target).alias("target"), F.lit(code_list).alias("code_list"), F.lit(several).alias("several"))
        cells.append(F.struct(*named, parts.alias("parts")))
    codes_of = rows.select("_row", F.inline(F.array(*cells)))
    codes_of = codes_of.select("_row", "target", "code_list", "several", F.posexplode("parts").alias("position", "code"))
    lists = [s[2] for s in spec]
    labels = code_lists.filter(F.col("code_list").isin(lists)).groupBy("code_list", "code").agg(F.max("label").alias("label"))
    labelled = codes_of.join(labels, ["code_list", "code"], "left").withColumn(
        "text", F.when(F.col("several"), F.coalesce(F.nullif("label", F.lit("")), "code")).otherwise(F.coalesce("label", F.lit("")))
    )
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"])
    per_column = labelled.groupBy("_row", "target").agg(F.array_join(in_order, separator).alias("value"))
    added = per_column.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("target", "value"))).alias("added"))
    blank = F.map_from_entries(F.array_compact(F.array(*blanks)))
    nothing = F.create_map().cast("map<string,string>")
    whole = merge_maps(merge_maps(fields, blank), F.coalesce("added", nothing))
    return rows.join(added, "_row", "left").withColumn("fields", whole).drop("_row", "added")


def label_institutions(rows: DataFrame, code_lists: DataFrame) -> DataFrame:
    """Labels of type, authority, country, services and exclusions, and the version time."""
    labelled = label_codes(rows, code_lists, LABELS, optional=("ENT_EXC",))
    fields = F.col("fields")
    version = F.create_map(F.lit("__EBA_EntityVersion_iso"), codes.version_time(fields["__EBA_EntityVersion"]))
    return labelled.withColumn("fields", merge_maps(fields, version))
