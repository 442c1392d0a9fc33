"""Substring search over an archive that opens only the files that can hold the term.

Every data file of a snapshot, and of the events between two, has a signature: a bit map of the hashes of all runs of ``GRAM``
letters in its cells, folded as the search folds them.  A file without one of a term's runs cannot hold the term.  Signatures are
kept in long form, a row per file and 64 bits, so a term reads the few rows that its own bits fall into.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook import model
from rollbook.functions.text import fold
from rollbook.model import register
from rollbook.operators import history, quality
from rollbook.operators.snapshots import change_cells
from rollbook.plans.archive import Archive

#: Letters of a run; bits of a signature.  Files with more different runs than bits pass more often; results stay the same.
GRAM, BITS = 3, 1 << 17
SIGNATURES = "file string, word int, bits bigint, part string, source string, stamp string"
#: What has signatures.
SNAPSHOTS, CHANGES = "snapshots", "changes"


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS)).cast("int")


def signatures(rows: DataFrame) -> DataFrame:
    """``file, word, bits`` of ``rows`` (``file``, ``fields``)."""
    return cell_signatures(rows.select("file", F.map_values("fields").alias("cells")))


def cell_signatures(rows: DataFrame) -> DataFrame:
    """:func:`signatures` of rows given as ``file, cells``."""
    cells = rows.select("file", F.explode("cells").alias("cell")).select("file", fold(F.col("cell")).alias("cell"))
    at = F.explode(F.expr(f"case when length(cell) >= {GRAM} then sequence(1, length(cell) - {GRAM - 1}) end"))
    grams = cells.select("file", "cell", at.alias("at")).select("file", _bit(F.expr(f"substring(cell, at, {GRAM})")).alias("bit"))
    bits = F.bit_or(F.expr("shiftleft(1L, bit % 64)"))
    return grams.groupBy("file", F.expr("bit div 64").cast("int").alias("word")).agg(bits.alias("bits"))


def _file() -> Column:
    return F.element_at(F.split("_metadata.file_path", "/"), -1)


class SearchIndex:
    def __init__(self, archive: Archive):
        self.archive, self.spark = archive, archive.spark

    def _data(self, part: str, source: str, stamp: str) -> str:
        return self.archive._partition(part, source, stamp)

    def _path(self, part: str, source: str, stamp: str) -> str:
        return self.archive._partition(f"signatures/part={part}", source, stamp)

    def _rows(self, part: str, source: str, stamp: str) -> DataFrame:
        """The cells of a partition's rows as a search sees them, and the file that each row is in."""
        schema = model.SNAPSHOT_ROWS if part == SNAPSHOTS else model.CHANGES.split(", source string")[0]
        rows = self.spark.read.schema(schema).parquet(self._data(part, source, stamp)).withColumn("file", _file())
        return rows.select("file", F.map_values("fields").alias("cells")) if part == SNAPSHOTS else change_cells(rows, keep=("file",))

    def write(self, source: str, stamp: str) -> None:
        """Sign a committed snapshot and the events that came with it; once more gives the same."""
        for part in (SNAPSHOTS, CHANGES):
            if self.archive._exists(self._data(part, source, stamp)):
                cell_signatures(self._rows(part, source, stamp)).write.mode("overwrite").parquet(self._path(part, source, stamp))

    def retire(self, source: str, stamp: str) -> None:
        """Events outlive the snapshot they came with, and so does their signature."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(SNAPSHOTS, source, stamp))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def files(self, term: str, part: str, partitions: Iterable[tuple[str, str]]) -> list[str]:
        """Paths of the files in ``partitions`` that can hold ``term``; all files where there is no signature."""
        partitions = sorted(set(partitions))
        signed = [p for p in partitions if self.archive._exists(f"{self._path(part, *p)}/_SUCCESS")]
        paths = [f"{self._data(part, *p)}" for p in partitions if p not in signed and self.archive._exists(self._data(part, *p))]
        folded = self.spark.range(1).select(fold(F.lit(term))).first()[0]
        grams = sorted({folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)})
        if not signed:
            return paths
        if not grams:  # too short a term
            return paths + [self._data(part, *p) for p in signed]
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bit(F.col("gram")).alias("bit"))
        masks = asked.groupBy(F.expr("bit div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask")).collect()
        told = self.spark.read.schema(SIGNATURES).option("basePath", self.archive._path("signatures")).parquet(*[self._path(part, *p) for p in signed])
        mask = F.create_map(*[F.lit(x) for m in masks for x in (m.word, m.mask)])[F.col("word")]
        hits = told.where(F.col("word").isin([m.word for m in masks])).where(F.col("bits").bitwiseAND(mask) == mask)
        found = hits.groupBy("source", "stamp", "file").count().where(F.col("count") == len(masks)).collect()  # names of files
        return paths + sorted(f"{self._data(part, r.source, r.stamp)}/{r.file}" for r in found)

    def _read(self, part: str, paths: list[str]) -> DataFrame:
        schema = model.SNAPSHOTS if part == SNAPSHOTS else model.CHANGES
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.archive._path(part)).parquet(*paths)

    def lookup(self, term: str, *, per_source: int = 4, last: int = 20, sources: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """The first rows of every register's newest snapshot that mention ``term``, and the newest events that do.

        Registers that declare neither identifiers nor names are not searched.  Rows as from
        :func:`rollbook.operators.quality.lookup` and ``lookup_changes`` over everything.
        """
        wanted = None if sources is None else set(sources)
        searched = lambda source: register(source).entity_shaped and (wanted is None or source in wanted)
        newest = [(r.source, r.stamp) for r in history.nth_newest(self.archive.catalog()).select("source", "stamp").collect() if searched(r.source)]
        runs = self.archive.change_runs().where("added + changed + removed > 0").select("source", "stamp").distinct()
        told = [(r.source, r.stamp) for r in runs.collect() if searched(r.source)]
        rows = self._read(SNAPSHOTS, self.files(term, SNAPSHOTS, newest))
        events = self._read(CHANGES, self.files(term, CHANGES, told))
        return quality.lookup(rows, term, per_source=per_source), quality.lookup_changes(events, term, last=last)
