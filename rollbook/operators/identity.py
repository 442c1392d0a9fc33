"""One identity for rows of several registers that share identifiers, also by way of others.

Rows and keys form a graph with an edge per row and key, never one per pair of rows, so a key that a third of all rows
has costs one edge for each of them.  The smallest row label spreads: to every key the smallest
of its rows', to every row the smallest of its keys'; both are minima with a partial step before the exchange.
Each round also replaces a row's label by the label of that row, which halves long chains.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import keys
from rollbook.functions.text import strip
from rollbook.session import materialise

#: Columns of a register that hold another register's identifier of the same entity.
BRIDGES: Mapping[str, Sequence[str]] = {"gleif": ("entity.registeredAs",)}
ROW = ("source", "row_key")


def bridge_keys(rows: DataFrame, bridges: Mapping[str, Sequence[str]] = BRIDGES) -> DataFrame:
    """``source, row_key, kind, key`` of the identifiers by which rows name their entry in another register.

    ``rows`` has ``source, row_key, fields``.  They identify the entity but are not the row's own, so watchlists do not match them.
    """
    cells = [
        F.when(F.col("source") == source, strip(F.coalesce(F.col("fields")[column], F.lit(""))))
        for source, columns in bridges.items()
        for column in columns
    ]
    forms = F.flatten(F.transform(F.array_compact(F.array(*cells)), keys.identifier_forms))
    return rows.select(*ROW, F.lit("identifier").alias("kind"), F.explode(F.array_distinct(forms)).alias("key"))


def _label(row: Sequence[str]) -> Column:
    """A row as text, so that labels compare; parts are told apart even if they hold the separator."""
    parts = [F.replace(F.col(c), F.lit(keys.KEY_SEPARATOR), F.lit(keys.KEY_SEPARATOR_ESCAPED)) for c in row]
    return F.concat_ws(keys.KEY_SEPARATOR, *parts)


def resolve(rows: DataFrame, keyed: DataFrame, *, kinds: Sequence[str] = ("identifier",)) -> DataFrame:
    """``source, row_key, entity_source, entity_key, entity_rows`` of every distinct row.

    ``rows`` has ``source, row_key``; ``keyed`` has these and ``kind, key`` (:func:`rollbook.operators.matching.match_keys` and
    :func:`bridge_keys`).  Rows belong to one entity if they share a key of one of ``kinds``, or are linked by rows that do;
    names prove no identity and are left out unless asked for.  An entity goes by its smallest row, by source and then key.
    """
    nodes = rows.select(*ROW).distinct()
    edges = keyed.where(F.col("kind").isin(*kinds)).select(*ROW, "kind", "key").distinct().withColumn("row", _label(ROW))
    # Keys of one row link nothing.
    linking = edges.groupBy("kind", "key").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("kind", "key")
    edges = materialise(edges.join(linking, ["kind", "key"], "left_semi").select("row", "kind", "key"), "edges")
    labels = materialise(edges.select("row", F.col("row").alias("label")).distinct(), "labels")
    while True:
        of_key = edges.join(labels, "row").groupBy("kind", "key").agg(F.min("label").alias("label"))
        spread = materialise(edges.join(of_key, ["kind", "key"]).groupBy("row").agg(F.min("label").alias("label")), "labels")
        target = spread.select(F.col("row").alias("label"), F.col("label").alias("next"))
        after = materialise(spread.join(target, "label").select("row", F.least("label", "next").alias("label")), "labels")
        moved = not after.join(labels.withColumnRenamed("label", "before"), "row").where("label <> before").isEmpty()
        labels = after
        if not moved:
            break
    named = nodes.withColumn("row", _label(ROW)).join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    sizes = named.groupBy("label").agg(F.count("*").alias("entity_rows"), F.min(F.struct(*ROW)).alias("e"))
    named = named.join(sizes, "label")
    return named.select(*ROW, F.col("e.source").alias("entity_source"), F.col("e.row_key").alias("entity_key"), "entity_rows")
