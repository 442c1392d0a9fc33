"""Row filters over ragged rows, and the report that explains an empty result."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rollbook.functions.text import fold, let, strip

FieldTests = Mapping[str, str] | Sequence[tuple[str, str]]


def parse_field_test(text: str) -> tuple[str, str]:
    """``name=value``; the value may itself hold ``=`` or be empty."""
    name, found, value = text.partition("=")
    if not found or not name.strip():
        raise ValueError(f"a field test is NAME=VALUE, got {text!r}")
    return name.strip(), value.strip()


def _pairs(tests: FieldTests) -> list[tuple[str, str]]:
    return list(tests.items()) if isinstance(tests, Mapping) else list(tests)


def contains_condition(needles: Iterable[str]) -> Column:
    """Every needle occurs in some value of the row; blank needles are ignored."""
    return _mention_all(F.map_values("fields"), needles)


def _mention_all(values: Column, needles: Iterable[str]) -> Column:
    wanted = [fold(F.lit(n)) for n in needles if n]

    def all_mentioned(folded: Column) -> Column:
        return reduce(Column.__and__, [_mentioned(folded, w) for w in wanted])

    return let(F.transform(values, fold), all_mentioned) if wanted else F.lit(True)


def _mentioned(folded: Column, needle: Column) -> Column:
    return F.exists(folded, lambda v: F.contains(v, needle))


def field_condition(tests: FieldTests) -> Column:
    """Each named field equals its value, ignoring case and outer blanks."""
    equal = [
        fold(strip(F.coalesce(F.col("fields")[name], F.lit("")))) == fold(F.lit(value.strip()))
        for name, value in _pairs(tests)
    ]
    return reduce(Column.__and__, equal, F.lit(True))


def contains_any(rows: DataFrame, needles: Sequence[str]) -> DataFrame:
    return rows.filter(contains_condition(needles))


def field_equals(rows: DataFrame, tests: FieldTests) -> DataFrame:
    return rows.filter(field_condition(tests))


def contains_any_wide(table: DataFrame, columns: Sequence[str], needles: Sequence[str]) -> DataFrame:
    """:func:`contains_any` on a typed table; only ``columns`` are searched."""
    texts = F.array(*[F.col(c).cast("string") for c in columns])
    return table.filter(_mention_all(texts, needles))


def first_n(rows: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows in arrival order; none or zero keeps all."""
    return rows.orderBy("ordinal").limit(n) if n else rows


def apply_filters(
    rows: DataFrame,
    *,
    contains: Sequence[str] = (),
    fields: FieldTests = (),
    limit: int | None = None,
) -> DataFrame:
    """All conditions together, then the first ``limit`` matches."""
    return first_n(rows.filter(contains_condition(contains) & field_condition(fields)), limit)


def filter_report(rows: DataFrame, *, contains: Sequence[str] = (), fields: FieldTests = ()) -> DataFrame:
    """One row that says what the filters did, in one pass.

    ``missing_fields`` lists tested fields that no row has.  ``reason`` tells the
    two causes of an empty result apart and is NULL otherwise.
    """
    names = [name for name, _ in _pairs(fields)]
    keep = contains_condition(contains) & field_condition(fields)
    seen = [
        F.coalesce(F.max(F.map_contains_key("fields", F.lit(n))), F.lit(False)).alias(f"seen_{i}")
        for i, n in enumerate(names)
    ]
    totals = rows.agg(F.count(F.lit(1)).alias("input_rows"), F.count_if(keep).alias("output_rows"), *seen)
    missing = F.array_compact(
        F.array(*[F.when(~F.col(f"seen_{i}"), F.lit(n)) for i, n in enumerate(names)]).cast("array<string>")
    )
    report = totals.select("input_rows", "output_rows", missing.alias("missing_fields"))
    return report.withColumn(
        "reason",
        F.when(F.size("missing_fields") > 0, "a tested field exists in no row").when(
            (F.col("input_rows") > 0) & (F.col("output_rows") == 0), "every row was filtered out"
        ),
    )


def served_page(rows: DataFrame, n: int, *, ceiling: int | None = None, **conditions) -> DataFrame:
    """A bounded answer with ``total_rows``, ``returned_rows`` and ``truncated``.

    A bound above ``ceiling``, where one is given, is refused.  ``truncated`` is also true
    where filters, not the bound, removed rows.
    """
    if ceiling is not None and n > ceiling:
        raise ValueError(f"at most {ceiling} rows are served at once, not {n}")
    page = apply_filters(rows, limit=n, **conditions)
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    returned = page.agg(F.count(F.lit(1)).alias("returned_rows"))
    counts = total.join(F.broadcast(returned)).withColumn("truncated", F.col("returned_rows") < F.col("total_rows"))
    return page.join(F.broadcast(counts))


def observed_filter(rows: DataFrame, condition: Column, name: str) -> tuple[DataFrame, Observation]:
    """Filter during the scan and count ``scanned`` and ``kept`` as a side effect.

    The observation is available after the first action on the result.
    """
    observation = Observation(name)
    watched = rows.observe(observation, F.count(F.lit(1)).alias("scanned"), F.count_if(condition).alias("kept"))
    return watched.filter(condition), observation
