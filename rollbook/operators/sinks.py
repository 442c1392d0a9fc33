"""Row sinks: CSV with one header, JSON lines with ragged keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.flatten import column_names, to_wide


def write_csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None) -> list[str]:
    """All columns of ragged rows, blank where a row lacks one; returns the header."""
    columns = list(columns) if columns is not None else column_names(rows)
    wide = to_wide(rows, columns, keep=()).na.fill("")
    options = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    wide.write.options(**options).mode("errorifexists").csv(path)
    return columns


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object per row; a column a row lacks stays out of its object."""
    rows.select(F.to_json("fields", {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)
