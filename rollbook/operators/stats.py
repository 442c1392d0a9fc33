"""Profiles and counts over ragged rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.text import shorten, split_literal, strip
from rollbook.model import register


def _parts(cell: Column, separator: str | None) -> Column:
    values = split_literal(cell, separator) if separator else F.array(cell)
    return F.filter(F.transform(values, strip), lambda v: v != "")


def ordered_counts(counts: DataFrame) -> DataFrame:
    """Most frequent first, ties by value."""
    return counts.orderBy(F.desc("n"), "value")


def count_cells(table: DataFrame, cell: Column, *, split: str | None = None) -> DataFrame:
    """``value, n`` for a column expression; ``split`` counts the parts of a cell."""
    text = F.coalesce(cell, F.lit(""))
    value = F.explode(_parts(text, split)) if split else strip(text)
    values = table.select(value.alias("value")).filter("value <> ''")
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def count_values(rows: DataFrame, field: str, *, split: str | None = None) -> DataFrame:
    return count_cells(rows, F.col("fields")[field], split=split)


def count_document_values(docs: DataFrame, field: str, *, prefix: str = "authorisation_") -> DataFrame:
    """Counts over parent and child documents together.

    Accepts the flattened column name as well: the bucket prefix is dropped where
    no document has the full name.
    """
    fields = F.col("fields")
    plain = field.split(prefix, 1)[-1]
    if plain == field:
        return count_values(docs, field)
    # Both spellings are counted in one pass; the short one only stands in when
    # the long one has no value at all.
    spelled = F.array(
        F.struct(F.lit(0).alias("rank"), fields[field].alias("cell")),
        F.struct(F.lit(1).alias("rank"), fields[plain].alias("cell")),
    )
    counts = (
        docs.select(F.explode(spelled).alias("s"))
        .select("s.rank", strip(F.coalesce("s.cell", F.lit(""))).alias("value"))
        .filter("value <> ''")
        .groupBy("rank", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.agg(F.min("rank").alias("rank"))
    return counts.join(F.broadcast(best), "rank").select("value", "n")


def facet(docs: DataFrame, field: str) -> DataFrame:
    """Exact counts of the lower-cased values of one field."""
    value = F.lower(F.col("fields")[field])
    return docs.select(value.alias("value")).filter("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


#: Values that a facet sketch keeps track of.
TRACKED = 10_000
#: Two to this power registers count the different values.
_HLL = 12


def facet_sketches(docs: DataFrame, fields: Sequence[str], *, tracked: int = TRACKED) -> DataFrame:
    """``field, n, sketch``: mergeable sketches of the frequent lower-cased values of several fields, in one pass.

    A sketch has a bounded size whatever the number of values.  Kept per snapshot, sketches of many are merged without reading their rows.
    ``values`` is a sketch of how many different values there are.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col("fields")[f]).alias("value")) for f in fields])
    values = docs.select(F.inline(cells)).filter("value <> ''")
    return values.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("sketch"), F.hll_sketch_agg("value", _HLL).alias("values")
    )


def merge_facets(sketches: DataFrame, *, tracked: int = TRACKED) -> DataFrame:
    """One sketch per field from those of several snapshots."""
    return sketches.groupBy("field").agg(
        F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"), F.hll_union_agg("values").alias("values")
    )


def approximate_facet(sketches: DataFrame, k: int = 100, *, tracked: int = TRACKED) -> DataFrame:
    """``field, value, n, error``: the ``k`` most frequent values of every field and how far their counts may be off.

    A count is off by ``3.5 n / m`` at most, ``m`` the power of two that holds ``tracked``, and values more frequent than that are never
    missing.  A sketch drops nothing before it has met three quarters of ``m`` values; where there are clearly fewer (six tenths, counted
    to within 1.6 % as a rule) counts are exact and ``error`` is 0.  :func:`facet` is always exact.
    """
    size = 1 << (tracked - 1).bit_length()
    error = F.when(F.hll_sketch_estimate("values") < 0.6 * size, 0).otherwise(F.ceil(3.5 * F.col("n") / size)).cast("bigint")
    told = sketches.select("field", error.alias("error"), F.inline(F.expr(f"approx_top_k_estimate(sketch, {k})")))
    return told.select("field", F.col("item").alias("value"), F.col("count").alias("n"), "error")


def list_enums(rows: DataFrame, separators: Mapping[str, str | None]) -> DataFrame:
    """``field, value, n`` for several fields in one pass."""

    def tagged(name: str, separator: str | None) -> Column:
        parts = _parts(F.coalesce(F.col("fields")[name], F.lit("")), separator)
        return F.transform(parts, lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))

    cells = [tagged(name, separator) for name, separator in separators.items()]
    exploded = rows.select(F.explode(F.flatten(F.array(*cells))).alias("c")).select("c.*")
    return exploded.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def list_register_enums(rows: DataFrame, key: str) -> DataFrame:
    """Counts of all columns that a register declares worth enumerating."""
    declared = register(key)
    return list_enums(rows, {name: declared.multi_value_fields.get(name) for name in declared.enum_fields})


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sum partial ``value, n`` tables."""
    total, *others = parts
    for part in others:
        total = total.unionByName(part)
    return total.groupBy("value").agg(F.sum("n").alias("n"))


def profile(rows: DataFrame, *, samples: int = 3, width: int = 60) -> DataFrame:
    """Field discovery: ``field, present, non_empty, distinct_values, first_seen, coverage, samples``.

    Equal values are counted before the exchange, so a value that fills a third of
    all cells costs one partial row per task.  Distinct counts are exact.  Samples
    are the first distinct shortened texts in arrival order.
    """
    text = F.coalesce("value", F.lit(""))
    # What is moved of a value is its digest and shortened text, never the whole of it.
    cells = rows.select("ordinal", F.explode("fields").alias("field", "value")).select(
        "field",
        F.when(text != "", F.unhex(F.sha2(text, 256))).alias("digest"),
        F.when(text != "", shorten(text, width)).alias("sample"),
        "ordinal",
    )
    texts = cells.groupBy("field", "digest", "sample").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_seen"))
    shown = texts.groupBy("field", "sample").agg(
        F.sum("n").alias("n"), F.count("digest").alias("values"), F.min("first_seen").alias("first_seen")
    )
    totals = shown.groupBy("field").agg(
        F.sum("n").alias("present"),
        F.sum(F.when(F.col("sample").isNotNull(), F.col("n")).otherwise(0)).alias("non_empty"),
        F.sum("values").alias("distinct_values"),
        F.min("first_seen").alias("first_seen"),
    )
    # A rank filter is applied before the exchange too, so a field with many
    # distinct values sends only ``samples`` rows per task.  Ordering by the count
    # as well makes both branches need the same columns of ``shown``, whose
    # exchange is then computed once and reused.
    order = Window.partitionBy("field").orderBy("first_seen", F.desc("n"), "sample")
    firsts = (
        shown.filter(F.col("values") > 0)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= samples)
        .groupBy("field")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample"))), lambda s: s["sample"]).alias("samples"))
    )
    population = rows.agg(F.count(F.lit(1)).alias("records"))
    return (
        totals.join(firsts, "field", "left")
        .join(F.broadcast(population))
        .select(
            "field",
            "present",
            "non_empty",
            "distinct_values",
            "first_seen",
            F.round(F.col("present") * 100.0 / F.col("records"), 1).alias("coverage"),
            F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        )
        .orderBy(F.desc("present"), "field")
    )


def whole_blocks(docs: DataFrame, layout=None, *, n: int = 1000) -> DataFrame:
    """All documents of some blocks, ``n`` documents or so, or all of one block if that is more.

    Blocks are chosen by a hash of their key, so none is cut wherever its documents stand, and the same ones are chosen every time.
    """
    from rollbook.operators.flatten import BlockLayout

    key = (layout or BlockLayout()).entity_key(F.col("fields"))
    point = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")
    told = docs.agg(F.count(F.lit(1)).alias("n"), F.min(point).alias("least")).first()
    if told.n <= n:
        return docs
    return docs.filter(point <= max(told.least, n * (1 << 32) // told.n))


def inspect(docs: DataFrame, layout=None, *, n: int = 200, block_structured: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Profile of the first ``n`` documents as received and of ``n`` flattened rows.

    The rows are flattened from a sample of whole blocks, several times as many documents as rows are asked for.
    """
    from rollbook.operators.filters import first_n
    from rollbook.operators.flatten import flatten_auto

    flat = flatten_auto(whole_blocks(docs, layout, n=max(4 * n, n + 50)), layout, block_structured=block_structured)
    return profile(first_n(docs, n)), profile(first_n(flat, n))


def change_counts(changes: DataFrame, *by: str) -> DataFrame:
    """``added, changed, removed`` per ``by`` columns (default source and stamp)."""
    by = by or ("source", "stamp")
    return changes.groupBy(*by).agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in ("added", "changed", "removed")]
    )


def run_report(run_log: DataFrame) -> DataFrame:
    """One row per run: outcome, row and change totals, seconds."""
    return run_log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("ok")).alias("ok"),
        F.count_if(~F.col("ok") & (F.col("skipped") == "")).alias("failed"),
        F.count_if(F.col("skipped") != "").alias("skipped"),
        *[F.sum(c).alias(c) for c in ("rows", "added", "changed", "removed")],
        F.round(F.sum("seconds"), 1).alias("seconds"),
    )


def run_phases(run_log: DataFrame) -> DataFrame:
    """Seconds per run and phase, summed over registers."""
    return (
        run_log.select("run_id", F.explode("phases").alias("phase", "seconds"))
        .groupBy("run_id", "phase")
        .agg(F.round(F.sum("seconds"), 3).alias("seconds"))
    )


def slowest_requests(requests: DataFrame, *, n: int = 5, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """The ``n`` slowest requests of each run."""
    order = Window.partitionBy(*by).orderBy(F.desc("seconds"), "url")
    return requests.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def last_runs(reports: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` runs, oldest first; run ids sort by time."""
    return reports.orderBy(F.desc("run_id")).limit(n).orderBy("run_id")


def readable_runs(texts: DataFrame, schema: str) -> DataFrame:
    """Run records from JSON text; one that does not parse stays, flagged.

    ``texts`` has ``run_id`` and ``body``.
    """
    parsed = F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    whole = F.try_parse_json("body").isNotNull()
    return texts.select("run_id", F.when(whole, parsed).alias("record"), (~whole).alias("unreadable"))


def url_host(url: Column) -> Column:
    """Host and port of a URL, ``?`` where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.coalesce(F.when(host != "", host), F.lit("?"))


def fetch_log_rollup(requests: DataFrame) -> DataFrame:
    """Requests and bytes by host, by status, by both and in total.

    ``requests`` has ``url``, ``status`` and ``bytes``.  ``level`` is ``all``,
    ``host``, ``status`` or ``host+status``.
    """
    keyed = requests.select(
        url_host(F.col("url")).alias("host"), F.coalesce(F.col("status").cast("string"), F.lit("none")).alias("status"), "bytes"
    )
    grouped = keyed.cube("host", "status").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("requests"),
        F.sum("bytes").alias("bytes_in"),
    )
    level = F.element_at(F.array(*map(F.lit, ("host+status", "host", "status", "all"))), (F.col("gid") + 1).cast("int"))
    return grouped.select(level.alias("level"), "host", "status", "requests", "bytes_in")


def _counted(requests: DataFrame) -> DataFrame:
    """``requests`` with ``outcome`` (``ok``, ``retry``, ``error``; from the status where it is not noted), ``seconds`` and ``waited``."""
    failed = F.col("status").isNull() | (F.col("status") >= 400)
    guessed = F.when(failed, "error").otherwise("ok")
    outcome = F.coalesce("outcome", guessed) if "outcome" in requests.columns else guessed
    number = lambda name: F.greatest(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)) if name in requests.columns else F.lit(0.0)
    return requests.select(
        url_host(F.col("url")).alias("host"), F.coalesce(F.col("status").cast("string"), F.lit("none")).alias("status"), outcome.alias("outcome"),
        F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(0)).alias("bytes"), number("seconds").alias("seconds"), number("waited").alias("waited"),
    )


_COUNTERS = ("requests", "retries", "failures", "bytes_in", "seconds_requesting", "seconds_waiting")


def _counters() -> list[Column]:
    values = (
        F.count(F.lit(1)), F.count_if(F.col("outcome") == "retry"), F.count_if(F.col("outcome") == "error"), F.coalesce(F.sum("bytes"), F.lit(0)),
        F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3), F.round(F.coalesce(F.sum("waited"), F.lit(0.0)), 3),
    )
    return [value.alias(name) for name, value in zip(_COUNTERS, values, strict=True)]


def request_totals(requests: DataFrame) -> DataFrame:
    """One row with the counters of all requests: how many, retries, failures, bytes, seconds requesting and waiting.

    Seconds of waiting (throttling and backing off) are kept apart from those of requesting: much of the first is
    politeness, much of the second a register in trouble.
    """
    return _counted(requests).agg(*_counters())


def request_rollup(requests: DataFrame) -> DataFrame:
    """The counters by host, by status, by outcome, by host and outcome, and in total: ``level, host, status, outcome`` and counters.

    ``requests`` has ``url``, ``status`` and ``bytes``, and where they were noted ``outcome``, ``seconds`` and ``waited``.
    """
    names = ("host", "status", "outcome")
    sets = [(), ("host",), ("status",), ("outcome",), ("host", "outcome")]
    grouped = _counted(requests).groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.grouping_id().alias("gid"), *_counters())
    level = F.create_map(*[F.lit(x) for s in sets for x in (sum(1 << 2 - i for i, n in enumerate(names) if n not in s), "+".join(s) or "all")])
    return grouped.select(level[F.col("gid").cast("int")].alias("level"), *names, *_COUNTERS)


def fetch_totals(run_log: DataFrame) -> DataFrame:
    """Sum the request counters that each run record carries."""
    return run_log.groupBy("run_id").agg(*[F.round(F.sum(f"http.{n}"), 3).alias(n) for n in _COUNTERS])
