"""Watchlists from JSON documents and spreadsheets exported as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.functions import keys
from rollbook.functions.text import is_list, strip

_RAW = ["file", "position", "id", "label", "identifiers", "names", "sources", "note", "bare"]


def _cleaned(values: Column) -> Column:
    return F.filter(F.transform(values, strip), lambda v: v != "")


def _cell(text: Column) -> Column:
    return _cleaned(F.split(F.coalesce(text, F.lit("")), r"\|"))


def _json_entities(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    bodies = spark.read.text(list(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("doc")
    )
    listed = F.when(is_list(F.col("doc")), F.col("doc")).otherwise(
        F.try_variant_get("doc", "$.entities", "variant")
    )
    items = bodies.select("file", F.posexplode(F.try_variant_get(listed, "$", "array<variant>")).alias("position", "item"))

    def text(name: str) -> Column:
        return F.try_variant_get("item", f"$.{name}", "string")

    def values(*names: str) -> Column:
        found = []
        for name in names:
            members = F.try_variant_get("item", f"$.{name}", "array<string>")
            cell = F.when(members.isNull(), _cell(text(name))).otherwise(_cleaned(members))
            found.append(F.when(F.size(cell) > 0, cell))
        return F.coalesce(*found, F.array().cast("array<string>"))

    bare = F.schema_of_variant("item") == "STRING"
    label = F.coalesce(F.when(text("label") != "", text("label")), text("name"), F.lit(""))
    return items.select(
        "file",
        "position",
        F.when(bare, F.col("item").cast("string")).otherwise(F.coalesce(text("id"), F.lit(""))).alias("id"),
        F.when(bare, F.col("item").cast("string")).otherwise(label).alias("label"),
        values("identifiers", "identifier").alias("identifiers"),
        values("names").alias("names"),
        values("sources").alias("sources"),
        F.coalesce(text("note"), F.lit("")).alias("note"),
        bare.alias("bare"),
    )


def _csv_entities(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    raw = spark.read.csv(list(paths), header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    have = {c.strip().lstrip("﻿"): c for c in raw.columns}

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"`{have[name]}`"), F.lit("")) if name in have else F.lit("")

    label = F.when(text("label") != "", text("label")).otherwise(text("name"))
    identifiers = F.when(text("identifiers") != "", text("identifiers")).otherwise(text("identifier"))
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("position"),
        text("id").alias("id"),
        label.alias("label"),
        _cell(identifiers).alias("identifiers"),
        _cell(text("names")).alias("names"),
        _cell(text("sources")).alias("sources"),
        text("note").alias("note"),
        F.lit(False).alias("bare"),
    )


def read_watchlist(spark: SparkSession, *paths: str) -> DataFrame:
    """Entities of all files with their ``file`` and ``problem`` (NULL when fine).

    JSON may be an object with ``entities`` or a bare list, whose members may be
    plain names.  CSV cells hold several values separated by ``|``.  A missing id
    is derived from the label.
    """
    csv = [p for p in paths if p.lower().endswith(".csv")]
    other = [p for p in paths if p not in csv]
    parts = [read(spark, group) for read, group in ((_json_entities, other), (_csv_entities, csv)) if group]
    raw = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    in_file = Window.partitionBy("file").orderBy("position")
    label = strip(F.col("label"))
    numbered = raw.select(*_RAW).withColumn("position", F.row_number().over(in_file)).withColumn("label", label)
    slug = F.replace(keys.name_key("label"), F.lit(" "), F.lit("-"))
    given = strip(F.col("id"))
    entity_id = (
        F.when(given != "", given)
        .when(~F.col("bare") & (slug != ""), slug)
        .otherwise(F.concat(F.lit("entity-"), F.col("position").cast("string")))
    )
    extended = F.when(
        (F.col("label") != "") & ~F.col("bare") & ~F.array_contains("names", F.col("label")),
        F.concat(F.array("label"), "names"),
    ).otherwise(F.col("names"))
    entities = numbered.withColumn("id", entity_id).withColumn("names", extended)
    entities = entities.withColumn(
        "label", F.when((F.col("label") == "") & ~F.col("bare"), F.col("id")).otherwise(F.col("label"))
    )
    same_id = Window.partitionBy("file", "id").orderBy("position")
    problem = F.when(
        ~F.col("bare") & (F.size("identifiers") == 0) & (F.size("names") == 0), "neither an identifier nor a name"
    ).when(F.row_number().over(same_id) > 1, "id is used twice in this file")
    return entities.withColumn("problem", problem).drop("bare")


def merged_watchlist(entities: DataFrame, files: Sequence[str] = ()) -> DataFrame:
    """One entity per id; the first file that names an id wins.

    Files count in the order given by name, or alphabetically.
    """
    names = F.array(*[F.lit(f) for f in files]).cast("array<string>")
    hit = F.array_position(F.transform(names, lambda f: F.endswith(F.col("file"), f)), F.lit(True))
    first = Window.partitionBy("id").orderBy(hit, "file", "position")
    return (
        entities.filter(F.col("problem").isNull())
        .withColumn("n", F.row_number().over(first))
        .filter("n = 1")
        .select("id", "label", "identifiers", "names", "sources", "note")
    )


def load_watchlist(spark: SparkSession, *paths: str) -> DataFrame:
    """A checked, merged watchlist; refuses files with unusable entries."""
    entities = read_watchlist(spark, *paths)
    bad = entities.filter(F.col("problem").isNotNull()).select("file", "position", "id", "problem").orderBy("file", "position").collect()
    if bad:
        listed = "; ".join(f"{b['file']} entry {b['position']} ({b['id']}): {b['problem']}" for b in bad)
        raise ValueError(f"unusable watchlist entries: {listed}")
    return merged_watchlist(entities, paths)
