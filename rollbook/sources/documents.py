"""Parent/child document pages of the securities register index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.text import blank_to_null
from rollbook.operators.flatten import BlockLayout, flatten_auto
from rollbook.session import materialise
from rollbook.sources.landing import as_rows, cells, page_documents, read_bodies

# Document types read by default, and those that hold past states.
DOC_TYPES = ("ae", "aeActivity", "aeNotHostMmbSt")
HISTORY_DOC_TYPES = ("aeActivityHistory",)
SELECT_FIELD = "ae_entityTypeCode"


def parse_pages(bodies: DataFrame) -> DataFrame:
    """``ordinal, fields`` of every document of every page."""
    documents = page_documents(bodies, "response", "docs")
    return as_rows(documents, cells(F.col("doc")))


def read_solr_pages(spark: SparkSession, path: str) -> DataFrame:
    return parse_pages(read_bodies(spark, path))


def select_solr(
    docs: DataFrame, value: str, field: str = SELECT_FIELD, *, layout: BlockLayout | None = None, blocks: bool = True
) -> DataFrame:
    """Documents of all blocks whose parent has ``field = value``, ignoring case.

    Flat documents (``blocks=False``) are simply filtered.
    """
    layout = layout or BlockLayout()
    fields = F.col("fields")
    matching = docs.filter(F.lower(fields[field]) == value.lower())
    if not blocks:
        return matching
    # Written once: counting and joining them would otherwise parse the pages again.
    roots = materialise(matching.select(fields[layout.id_field].alias("_root")).distinct(), "roots")
    keyed = docs.withColumn("_root", blank_to_null(fields[layout.root_field]))
    return keyed.join(roots, "_root", "left_semi").drop("_root")


def doc_type_filter(docs: DataFrame, *, include_history: bool = False, types: tuple[str, ...] = DOC_TYPES) -> DataFrame:
    wanted = [*types, *HISTORY_DOC_TYPES] if include_history else list(types)
    return docs.filter(F.col("fields")["entity_type"].isin(wanted))


def read_upreg(
    spark: SparkSession, path: str, *, select: str | None = None, include_history: bool = False
) -> DataFrame:
    """The authorised-entity register as one row per entity."""
    docs = doc_type_filter(read_solr_pages(spark, path), include_history=include_history)
    if select:
        docs = select_solr(docs, select)
    return flatten_auto(docs, block_structured=True)


def read_generic_docs(spark: SparkSession, path: str) -> DataFrame:
    """An index nobody has described: blocks are detected, flat documents pass through."""
    return flatten_auto(read_solr_pages(spark, path))
