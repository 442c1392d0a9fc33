"""CSV exports: crypto-asset providers, authorisation holders, trade licences."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import codes
from rollbook.functions.keys import uid_digits
from rollbook.functions.text import SEPARATOR, merge_maps, strip
from rollbook.operators.flatten import INTERNAL_FIELDS, BlockLayout, flatten_blocks
from rollbook.sources import selection
from rollbook.sources.landing import file_order, file_path, strip_nul, with_ordinals

#: Columns that services are derived from: ``{new column: expression over fields}``.
DERIVED_SERVICES = {"ac_serviceCode_normalised": ("ac_serviceCode", codes.service_letters)}


def _by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files of ``path`` in order, grouped by their first line; empty files have none and are left out."""
    lines = spark.read.text(path)
    start, place = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    firsts = lines.select(file_path().alias("file"), start.alias("start"), place.alias("place"), "value")
    firsts = firsts.filter("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("line"))
    line_of = {r["file"]: r["line"].lstrip("\ufeff").rstrip() for r in firsts.collect()}
    groups: dict[str, list[str]] = {}
    for file in file_order(lines):
        if file in line_of:
            groups.setdefault(line_of[file], []).append(file)
    return list(groups.values())


def csv_header(spark: SparkSession, path: str | list[str], *, sep: str = ",") -> list[str]:
    """Column names of a CSV file, blank for nameless columns; empty for an empty file."""
    first = spark.read.csv(path, sep=sep, header=False, multiLine=True, quote='"', escape='"', encoding="UTF-8").limit(1)
    row = first.collect()
    return [(v or "").strip().lstrip("﻿").strip() for v in row[0]] if row else []


def _read_cells(
    spark: SparkSession, path: str, header: list[str], *, sep: str, spare: int, multiline: bool
) -> DataFrame:
    schema = ", ".join(f"_{i} string" for i in range(len(header) + spare))
    return spark.read.csv(
        path, schema=schema, sep=sep, header=True, multiLine=multiline, quote='"', escape='"', encoding="UTF-8"
    )


def _spare_columns(spark: SparkSession, path: str, header: list[str], *, sep: str, multiline: bool) -> int:
    """How many columns beyond the header are needed to hold every surplus cell."""
    spare = 8
    while not (
        _read_cells(spark, path, header, sep=sep, spare=spare, multiline=multiline)
        .filter(F.col(f"_{len(header) + spare - 1}").isNotNull())
        .isEmpty()
    ):
        spare *= 2
    return spare


def _cell(i: int) -> Column:
    return strip(strip_nul(F.coalesce(F.col(f"_{i}"), F.lit(""))))


def read_csv_rows(
    spark: SparkSession,
    path: str | list[str],
    *,
    sep: str = ",",
    keep_surplus: bool = False,
    keep_blank: bool = False,
    multiline: bool = True,
) -> tuple[DataFrame, list[str]]:
    """``ordinal, file, fields`` and the header, which survives a file without rows.

    Every file is read by its own header.  Cells are stripped, nameless columns and blank rows
    dropped.  With ``keep_surplus`` the cells beyond the header go to ``_extra_columns``.
    """
    groups, read, splits = _by_header(spark, path) or [path], [], 0
    for files in groups:
        read.append(_read_alike(spark, files, sep, keep_surplus, keep_blank, multiline, splits))
        if len(groups) > 1:
            # As many as the files have parts of the least size a split can have: ranks of two groups never meet.
            splits += spark.read.format("binaryFile").load(files).agg(F.sum(F.floor(F.col("length") / 4096) + 1)).first()[0]
    header = list(dict.fromkeys(name for _, names in read for name in names))
    return functools.reduce(DataFrame.unionByName, [rows for rows, _ in read]), header


def _read_alike(
    spark: SparkSession, path: str | list[str], sep: str, keep_surplus: bool, keep_blank: bool, multiline: bool, first_rank: int
) -> tuple[DataFrame, list[str]]:
    """Rows of files that share one header."""
    names = csv_header(spark, path, sep=sep)
    header = [n for n in names if n]
    if not names:
        return spark.createDataFrame([], "ordinal bigint, file string, fields map<string,string>"), []
    spare = _spare_columns(spark, path, names, sep=sep, multiline=multiline) if keep_surplus else 0
    raw = _read_cells(spark, path, names, sep=sep, spare=spare, multiline=multiline)
    entries = [
        F.struct(F.lit(n).alias("key"), _cell(i).alias("value")) for i, n in enumerate(names) if n
    ]
    fields = codes.entries_to_map(F.array(*entries)) if len(set(header)) < len(header) else F.map_from_entries(F.array(*entries))
    if spare:
        surplus = F.filter(
            F.array(*[F.col(f"_{i}") for i in range(len(names), len(names) + spare)]), lambda v: v != ""
        )
        extra = F.when(
            F.size(surplus) > 0, F.create_map(F.lit("_extra_columns"), F.array_join(surplus, SEPARATOR))
        ).otherwise(F.create_map().cast("map<string,string>"))
        fields = merge_maps(fields, extra)
    rows = with_ordinals(raw, F.col("_metadata.file_name").alias("file"), fields.alias("fields"), first_rank=first_rank)
    return rows if keep_blank else rows.filter(_filled()), header


def _filled() -> Column:
    return F.exists(F.map_values("fields"), lambda v: v != "")


def derive(rows: DataFrame, columns: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add columns computed from one existing column each; rows lacking it stay as they are."""
    fields = F.col("fields")
    for name, (origin, expression) in columns.items():
        added = F.create_map(F.lit(name), expression(fields[origin]))
        fields = F.when(F.map_contains_key(fields, F.lit(origin)), merge_maps(fields, added)).otherwise(fields)
    return rows.withColumn("fields", fields)


def read_mica_csv(spark: SparkSession, path: str, *, derived: bool = True) -> tuple[DataFrame, list[str]]:
    """Crypto-asset register file as rows and header."""
    rows, header = read_csv_rows(spark, path, keep_surplus=True)
    rows = rows.drop("file")
    return (derive(rows, DERIVED_SERVICES) if derived else rows), header


# Synthesised document fields that do not belong in the output.
FINMA_LAYOUT = BlockLayout(drop=(*INTERNAL_FIELDS, "id", "type_s", "entity_type", "_root_"))


def authorisation_documents(rows: DataFrame, select: str | None = None, *, derived: bool = True) -> DataFrame:
    """One row per authorisation to parent and child documents.

    An institution is its UID, else name and city.  Its first row gives the parent.
    """
    fields = F.col("fields")

    def cell(name: str) -> Column:
        return F.coalesce(fields[name], F.lit(""))

    haystack = F.lower(F.concat_ws(" ", cell("AuthorisationTypeEN"), cell("AuthorisationTypeDE")))
    needles = selection.authorisation_needles(select)
    if needles:
        rows = rows.filter(codes.any_of([F.contains(haystack, F.lit(n)) for n in needles]))
    place = F.trim(F.concat(cell("Name"), F.lit("|"), cell("City")), F.lit("|"))
    key = F.coalesce(F.when(cell("UID") != "", cell("UID")), F.when(place != "", place), F.lit("?"))
    keyed = rows.select("ordinal", key.alias("entity"), "fields")
    columns = {"id": F.col("entity"), "type_s": F.lit("parent"), "entity_type": F.lit("institution"), "_root_": F.col("entity")}
    columns |= {name: cell(name) for name in ("Name", "City", "UID")}
    if derived:
        columns["uid_digits"] = uid_digits(cell("UID"))
    parents = keyed.groupBy("entity").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("fields", "ordinal").alias("fields")
    ).select((F.col("ordinal") * 2).alias("ordinal"), codes.map_of(columns).alias("fields"))
    marks = codes.map_of(
        {
            "id": F.concat_ws("#", "entity", "ordinal"),
            "type_s": F.lit("child"),
            "entity_type": F.lit("authorisation"),
            "_root_": F.col("entity"),
        }
    )
    types = F.map_filter(fields, lambda k, _: F.startswith(k, F.lit("AuthorisationType")))
    children = keyed.select((F.col("ordinal") * 2 + 1).alias("ordinal"), merge_maps(marks, types).alias("fields"))
    return parents.unionByName(children)


def read_finma_csv(spark: SparkSession, path: str, select: str | None = None, *, derived: bool = True) -> DataFrame:
    """Swiss authorisation holders as one row per institution."""
    rows, _ = read_csv_rows(spark, path, sep=";")
    return flatten_blocks(authorisation_documents(rows.drop("file"), select, derived=derived), FINMA_LAYOUT)


def filter_trade_rows(tests: Mapping[str, str]) -> Column:
    """Condition for ``column=value`` tests, ignoring case of names and values."""
    lowered = F.transform_keys("fields", lambda k, _: F.lower(k))
    conditions = [F.coalesce(F.lower(lowered[n]), F.lit("")) == v.lower() for n, v in tests.items()]
    return ~codes.any_of([~c for c in conditions])


def read_gisa_csv(
    spark: SparkSession,
    path: str,
    filters: Mapping[str, str] | str | None = None,
    select: str | None = None,
    *,
    derived: bool = True,
    multiline: bool = False,
) -> tuple[DataFrame, Observation]:
    """Trade licences that pass the tests, and the observed ``scanned``/``kept`` counts.

    The file is split over tasks and filtered in the scan stage.  The counts are those
    of one evaluation, so observe a write or a count, not a global sort, which
    evaluates its input twice.  Set ``multiline``
    for exports with line breaks inside cells; such a file is read by one task.
    """
    tests = selection.column_tests(filters) if isinstance(filters, str) else {k.lower(): v for k, v in (filters or {}).items()}
    kind = selection.trade_kind(select)
    if kind:
        tests = {"gewerbeart": kind, **tests}
    rows, header = read_csv_rows(spark, path, keep_blank=True, multiline=multiline)
    unknown = sorted(set(tests) - {h.lower() for h in header}) if header else []
    if unknown:
        raise selection.UnknownSelection(f"no such column(s) {', '.join(unknown)}; there are: {', '.join(header)}")
    condition = _filled() & filter_trade_rows(tests)
    seen = Observation()
    kept = rows.observe(seen, F.count(F.lit(1)).alias("scanned"), F.count_if(condition).alias("kept")).filter(condition)
    if derived:
        kept = label_trades(kept, F.col("file"))
    return kept.drop("file"), seen


def label_trades(rows: DataFrame, file_name: Column | None = None) -> DataFrame:
    """Labels for coded columns and the vintage stated in the file name."""
    extra = codes.trade_labels(F.col("fields"))
    if file_name is not None:
        month = codes.vintage(file_name)
        stamp = F.when(month != "", F.create_map(F.lit("_vintage"), month)).otherwise(
            F.create_map().cast("map<string,string>")
        )
        extra = merge_maps(stamp, extra)
    return rows.withColumn("fields", merge_maps(F.col("fields"), extra))


def label_licences(licences: DataFrame, trade_codes: DataFrame) -> DataFrame:
    """Licences with the wording of their trade code; the key is the code number.

    The code list has under a thousand rows and is broadcast after a count.
    """
    
    wording = trade_codes.select(
        F.col("fields")["gewerbeschluessel"].alias("_code"),
        F.col("fields")["gewerbewortlaut"].alias("code_wording"),
        F.col("fields")["gewerbeart"].alias("code_kind"),
    ).dropDuplicates(["_code"])
    keyed = licences.withColumn("_code", F.col("fields")["gewerbeschluessel"])
    return keyed.join(wording, "_code", "left").drop("_code")
