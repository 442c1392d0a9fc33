"""Parent/child documents to one row per entity, and ragged rows to wide tables.

A document table has ``ordinal BIGINT`` (arrival order) and
``fields MAP<STRING,STRING>`` (values already rendered as cells, NULL for a JSON
null).  Further columns named in ``scope`` (``source``, ``stamp``) separate
registers that are flattened in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import SEPARATOR, blank_to_null, let, merge_maps

# Bookkeeping fields of the document index.
INTERNAL_FIELDS = ("_version_", "collectorParent")

#: Documents of one entity whose ordinals share this many consecutive values are
#: joined in one task; longer entities are joined in several.
SPAN = 1 << 16


@dataclass(frozen=True)
class BlockLayout:
    """How to tell parents, children and their grouping key apart."""

    root_field: str = "_root_"
    id_field: str = "id"
    parent_field: str = "type_s"
    parent_value: str = "parent"
    group_field: str = "entity_type"
    separator: str = SEPARATOR
    counts: bool = True
    drop: tuple[str, ...] = INTERNAL_FIELDS

    def entity_key(self, fields: Column) -> Column:
        return F.coalesce(
            blank_to_null(fields[self.root_field]), blank_to_null(fields[self.id_field]), F.lit("")
        )

    def is_parent(self, fields: Column) -> Column:
        return F.coalesce(fields[self.parent_field] == self.parent_value, F.lit(False))

    def group(self, fields: Column) -> Column:
        return F.coalesce(blank_to_null(fields[self.group_field]), F.lit("child"))

    def dropping(self, *names: str) -> BlockLayout:
        return replace(self, drop=(*self.drop, *names))


def _by_ordinal(documents: Column) -> Column:
    return _sorted(documents, "ordinal")


def _sorted(structs: Column, field: str) -> Column:
    # Structs that hold a map are not orderable, so their places are sorted.  A comparator would be interpreted for every pair.
    places = F.sort_array(F.transform(structs, lambda s, i: F.struct(s[field].alias("at"), i.alias("place"))))
    in_order = F.transform(places, lambda p: F.get(structs, p["place"]))
    return F.when(F.size(structs) < 2, structs).otherwise(in_order)


def _filled(fields: Column) -> Column:
    return F.transform_values(fields, lambda _, v: F.coalesce(v, F.lit("")))


def _joined_cells(documents: Column, separator: str, drop: Sequence[str]) -> Column:
    """Map of field to the positionally aligned values of all documents."""
    unwanted = F.array(*map(F.lit, drop)).cast("array<string>")

    def cells(all_: Column) -> Column:
        names = F.array_except(F.flatten(F.transform(all_, lambda d: F.map_keys(d["fields"]))), unwanted)
        return F.transform(names, lambda n: F.struct(n.alias("key"), cell(all_, n).alias("value")))

    def cell(all_: Column, name: Column) -> Column:
        return F.array_join(F.transform(all_, lambda d: F.coalesce(d["fields"][name], F.lit(""))), separator)

    return F.map_from_entries(let(documents, cells))


def flatten_cells(
    docs: DataFrame,
    layout: BlockLayout | None = None,
    *,
    scope: Sequence[str] = (),
    span: int = SPAN,
) -> DataFrame:
    """Join the documents of each entity, one piece per bucket and ordinal span.

    Returns ``scope..., entity, bucket, piece, first_ordinal, n, head, cells``.
    ``bucket`` is NULL for parents, whose ``head`` is the first parent document
    of the piece; ``cells`` then holds the later ones.  Every piece covers at most
    ``span`` ordinals, so no task gathers an unbounded entity; concatenating the
    pieces of a bucket in order gives the whole cell.
    """
    layout = layout or BlockLayout()
    fields = F.col("fields")
    parent = layout.is_parent(fields)
    child_drop = [*layout.drop, layout.root_field, layout.group_field]
    keyed = docs.select(
        *scope,
        layout.entity_key(fields).alias("entity"),
        F.when(~parent, layout.group(fields)).alias("bucket"),
        F.floor(F.col("ordinal") / F.lit(span)).alias("piece"),
        F.struct("ordinal", "fields").alias("doc"),
        "ordinal",
    )
    pieces = keyed.groupBy(*scope, "entity", "bucket", "piece").agg(
        F.collect_list("doc").alias("docs"), F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_ordinal")
    )
    pieces = pieces.withColumn("docs", _by_ordinal(F.col("docs")))
    is_parent = F.col("bucket").isNull()
    # A parent keeps its own bookkeeping columns; a child does not repeat them.
    head = _filled(F.map_filter(F.col("docs")[0]["fields"], lambda k, _: ~k.isin(list(layout.drop))))
    children = _joined_cells(F.col("docs"), layout.separator, child_drop)
    later = _joined_cells(F.slice("docs", 2, F.size("docs")), layout.separator, child_drop)
    return pieces.select(
        *scope,
        "entity",
        "bucket",
        "piece",
        "first_ordinal",
        "n",
        F.when(is_parent, head).alias("head"),
        F.when(~is_parent, children).when(F.col("n") > 1, later).otherwise(_no_columns()).alias("cells"),
    )


def _no_columns() -> Column:
    return F.create_map().cast("map<string,string>")


def _bucket_columns(bucket: Column, chunks: Column, layout: BlockLayout) -> Column:
    """Columns ``<bucket>_count`` and ``<bucket>_<field>`` from ordered chunks."""
    names = F.array_distinct(F.flatten(F.transform(chunks, lambda c: F.map_keys(c["cells"]))))
    sep = layout.separator

    def chunk_text(chunk: Column, name: Column) -> Column:
        blanks = F.repeat(F.lit(sep), chunk["n"] - 1)
        return F.coalesce(chunk["cells"][name], blanks)

    columns = F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(
                F.concat(bucket, F.lit("_"), n).alias("key"),
                F.array_join(F.transform(chunks, lambda c: chunk_text(c, n)), sep).alias("value"),
            ),
        )
    )
    if not layout.counts:
        return columns
    total = F.aggregate(chunks, F.lit(0), lambda acc, c: acc + c["n"]).cast("string")
    count = F.create_map(F.concat(bucket, F.lit("_count")), total)
    return merge_maps(count, columns)


def assemble_blocks(
    cells: DataFrame, layout: BlockLayout | None = None, *, scope: Sequence[str] = ()
) -> DataFrame:
    """Pieces of :func:`flatten_cells` to one row per entity.

    One exchange on the entity serves both groupings below.  What it moves are
    joined cells, not documents.
    """
    layout = layout or BlockLayout()
    key = [*scope, "entity"]
    name = F.coalesce("bucket", F.lit("duplicateParent"))
    by_bucket = (
        cells.withColumn("bucket", name)
        .repartition(*key)
        .groupBy(*key, "bucket")
        .agg(
            F.min("first_ordinal").alias("first_ordinal"),
            F.collect_list(F.struct("piece", "n", "head", "cells")).alias("pieces"),
        )
        .withColumn("pieces", _sorted(F.col("pieces"), "piece"))
        .withColumn("first_parent", F.get(F.filter("pieces", lambda p: p["head"].isNotNull()), F.lit(0)))
    )
    child_drop = [*layout.drop, layout.root_field, layout.group_field]
    pieces, first_parent = F.col("pieces"), F.col("first_parent")

    def as_chunk(n: Column, cells_: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), cells_.alias("cells"))

    def whole(piece: Column) -> Column:
        return as_chunk(piece["n"], piece["cells"])

    def without_parent(piece: Column) -> Column:
        # Only the first parent of the entity gives the row its own columns; the
        # first parent of a later piece is one of those that follow.
        head = as_chunk(F.lit(1), F.map_filter(piece["head"], lambda k, _: ~k.isin(child_drop)))
        tail = as_chunk(piece["n"] - 1, piece["cells"])
        later = F.when(piece["piece"] != first_parent["piece"], head)
        parents = F.array_compact(F.array(later, F.when(piece["n"] > 1, tail)))
        return F.when(piece["head"].isNull(), F.array(whole(piece))).otherwise(parents)

    chunks = F.when(first_parent.isNull(), F.transform(pieces, whole)).otherwise(
        F.flatten(F.transform(pieces, without_parent))
    )
    buckets = by_bucket.select(
        *key, "first_ordinal", first_parent["head"].alias("parent"), "bucket", chunks.alias("chunks")
    ).select(
        *key,
        "first_ordinal",
        "parent",
        F.when(F.size("chunks") > 0, _bucket_columns(F.col("bucket"), F.col("chunks"), layout)).alias("columns"),
    )
    entities = buckets.groupBy(*key).agg(
        F.min("first_ordinal").alias("ordinal"),
        _by_ordinal(F.collect_list(F.struct(F.col("first_ordinal").alias("ordinal"), "parent", "columns"))).alias("parts"),
    )
    parents = F.filter(F.col("parts"), lambda p: p["parent"].isNotNull())
    orphan = F.create_map(F.lit("_orphan"), F.lit("true"), F.lit(layout.root_field), F.col("entity"))
    start = F.when(F.size(parents) > 0, parents[0]["parent"]).otherwise(orphan)
    buckets_only = F.transform(F.filter(F.col("parts"), lambda p: p["columns"].isNotNull()), lambda p: p["columns"])
    maps = F.concat(F.array(start), buckets_only)
    return entities.select(*scope, "ordinal", let(maps, _merge_in_order).alias("fields"))


def _merge_in_order(maps: Column) -> Column:
    """One map from several; only where a key repeats are they merged one by one."""
    keys = F.flatten(F.transform(maps, F.map_keys))
    together = F.map_from_entries(F.flatten(F.transform(maps, F.map_entries)))
    one_by_one = F.aggregate(maps, _no_columns(), merge_maps)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), together).otherwise(one_by_one)


#: Documents from which an entity counts as heavy, and entities that the search for them keeps track of.
HEAVY, TRACKED = 100_000, 10_000
#: Tables that Spark estimates below so many bytes hold no entity too large for a task.
SMALL_BYTES = 256 << 20


def heavy_entities(docs: DataFrame, layout: BlockLayout, *, scope: Sequence[str] = ()) -> DataFrame | None:
    """``scope..., entity`` of the entities that no single task should gather; None if there are none.

    A mergeable sketch of frequent keys, so one pass without an exchange of documents.  It finds every entity with a share of the
    documents above ``3.5 / 16384``; one below it is no hot spot on a table of that size.
    """
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) < SMALL_BYTES:
        return None
    key = F.to_json(F.struct(*scope, layout.entity_key(F.col("fields")).alias("entity")))
    found = docs.select(key.alias("key")).agg(F.expr(f"approx_top_k(key, {TRACKED}, {TRACKED})").alias("top")).first().top or []
    keys = [t["item"] for t in found if t["count"] >= HEAVY]
    if not keys:
        return None
    kind = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in scope), "entity string"])
    told = docs.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return told.select(F.from_json("key", kind).alias("k")).select("k.*")


def flatten_blocks(
    docs: DataFrame,
    layout: BlockLayout | None = None,
    *,
    scope: Sequence[str] = (),
    span: int = SPAN,
) -> DataFrame:
    """One row per entity from a mixed stream of parent and child documents.

    The first parent gives the row its own columns, later parents become bucket
    ``duplicateParent``, children become ``<bucket>_<field>`` columns whose values
    are joined in arrival order with blanks kept.  An entity without a parent is
    kept and marked ``_orphan``.

    Documents are exchanged once, by entity.  Those of heavy entities (:func:`heavy_entities`) are joined in pieces first, and only
    the pieces meet.  An entity too large for one row is available whole, in pieces, from :func:`flatten_cells`.
    """
    layout = layout or BlockLayout()
    heavy = heavy_entities(docs, layout, scope=scope)
    if heavy is None:
        return _flatten_together(docs, layout, scope)
    key = [*scope, "entity"]
    keyed = docs.withColumn("entity", layout.entity_key(F.col("fields")))
    # TRACKED rows at most.
    few = F.broadcast(heavy)
    in_pieces = assemble_blocks(flatten_cells(keyed.join(few, key, "left_semi"), layout, scope=scope, span=span), layout, scope=scope)
    return _flatten_together(keyed.join(few, key, "left_anti"), layout, scope).unionByName(in_pieces)


def _flatten_together(docs: DataFrame, layout: BlockLayout, scope: Sequence[str]) -> DataFrame:
    """:func:`flatten_blocks` with all documents of an entity in one task."""
    key, fields = [*scope, "entity"], F.col("fields")
    parent = layout.is_parent(fields)
    bucket = F.when(parent, "duplicateParent").otherwise(layout.group(fields))
    doc = F.struct("ordinal", parent.alias("parent"), bucket.alias("bucket"), "fields")
    keyed = docs.select(*scope, layout.entity_key(fields).alias("entity"), doc.alias("doc"))
    gathered = keyed.repartition(*key).groupBy(*key).agg(F.collect_list("doc").alias("docs"), F.min("doc.ordinal").alias("ordinal"))
    gathered = gathered.withColumn("docs", _by_ordinal(F.col("docs")))
    leads = F.filter("docs", lambda d: d["parent"])
    head = _filled(F.map_filter(leads[0]["fields"], lambda k, _: ~k.isin(list(layout.drop))))
    orphan = F.create_map(F.lit("_orphan"), F.lit("true"), F.lit(layout.root_field), F.col("entity"))
    gathered = gathered.withColumn("leads", leads).withColumn("head", F.when(F.size("leads") > 0, head).otherwise(orphan))
    # Parents first: other documents that call their bucket so follow them.
    children = F.filter("docs", lambda d: ~d["parent"])
    rest = F.when(F.size("leads") > 1, F.concat(F.slice("leads", 2, F.size("leads")), children)).otherwise(children)
    gathered = gathered.withColumn("rest", rest).withColumn("buckets", F.array_distinct(F.col("docs")["bucket"]))

    def columns(name: Column) -> Column:
        return let(F.filter("rest", lambda d: d["bucket"] == name)["fields"], lambda maps: _bucket_cells(name, maps, layout))

    # In the order in which the buckets begin, the first parent counting for its own.
    cells = gathered.select(*scope, "ordinal", "head", F.transform("buckets", columns).alias("cells"))
    # Keys of a bucket differ; only where one repeats between buckets are they merged one by one.
    every = cells.select(*scope, "ordinal", "head", "cells", F.concat(F.map_entries("head"), F.flatten("cells")).alias("every"))
    keys = F.col("every")["key"]
    one_by_one = F.aggregate(F.transform("cells", F.map_from_entries), F.col("head"), merge_maps)
    merged = F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries("every")).otherwise(one_by_one)
    return every.select(*scope, "ordinal", merged.alias("fields"))


def _bucket_cells(bucket: Column, maps: Column, layout: BlockLayout) -> Column:
    """Columns ``<bucket>_count`` and ``<bucket>_<field>`` of a whole bucket, its documents in order; none if there are none."""
    unwanted = F.array(*map(F.lit, [*layout.drop, layout.root_field, layout.group_field])).cast("array<string>")
    names = F.array_except(F.flatten(F.transform(maps, F.map_keys)), unwanted)

    def cell(name: Column) -> Column:
        joined = F.array_join(F.transform(maps, lambda m: F.coalesce(m[name], F.lit(""))), layout.separator)
        return F.struct(F.concat(bucket, F.lit("_"), name).alias("key"), joined.alias("value"))

    if not layout.counts:
        return F.transform(names, cell)
    count = F.array(F.struct(F.concat(bucket, F.lit("_count")).alias("key"), F.size(maps).cast("string").alias("value")))
    # A field called "count" gives its own column, as the count would be merged over.
    none = F.array().cast("array<struct<key:string,value:string>>")

    def told(named: Column) -> Column:
        own = (F.size(maps) == 0) | F.array_contains(named, F.lit("count"))
        return F.concat(F.when(own, none).otherwise(count), F.transform(named, cell))

    return let(names, told)


def passthrough(docs: DataFrame, drop: Sequence[str] = INTERNAL_FIELDS) -> DataFrame:
    """Flat documents as rows: bookkeeping fields dropped, nulls blank, no shuffle."""
    kept = F.map_filter(F.col("fields"), lambda k, _: ~k.isin(list(drop)))
    return docs.withColumn("fields", _filled(kept))


def flatten_auto(
    docs: DataFrame,
    layout: BlockLayout | None = None,
    *,
    block_structured: bool | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Flatten documents that come in blocks, pass flat ones through.

    When not told, looks for one parent document; the search stops at the first.
    """
    layout = layout or BlockLayout()
    if block_structured is None:
        block_structured = not docs.filter(layout.is_parent(F.col("fields"))).limit(1).isEmpty()
    if block_structured:
        return flatten_blocks(docs, layout, scope=scope)
    return passthrough(docs, layout.drop)


def column_names(rows: DataFrame) -> list[str]:
    """Every column of ragged rows, ordered by the row that shows it first.

    Columns first seen in the same row are ordered by name.
    """
    names = (
        rows.select("ordinal", F.explode(F.map_keys("fields")).alias("name"))
        .groupBy("name")
        .agg(F.min("ordinal").alias("first_seen"))
        .orderBy("first_seen", "name")
    )
    return [r["name"] for r in names.collect()]


def to_wide(rows: DataFrame, columns: Sequence[str] | None = None, *, keep: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Ragged rows as a table with one string column per name; NULL means absent."""
    columns = list(columns) if columns is not None else column_names(rows)
    return rows.select(*keep, *[F.col("fields")[c].alias(c) for c in columns])


def from_wide(df: DataFrame, columns: Sequence[str], *, keep: Sequence[Column | str] = ()) -> DataFrame:
    """A typed table as ragged rows; NULL cells become absent columns."""
    pairs = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    present = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
    return df.select(*keep, F.map_from_entries(present).alias("fields"))


def union_rows(*tables: DataFrame) -> DataFrame:
    """Union of wide tables whose columns differ; what one lacks is absent."""
    result, *others = tables
    for table in others:
        result = result.unionByName(table, allowMissingColumns=True)
    return result
