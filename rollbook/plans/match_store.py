"""Match keys stored beside each snapshot, bucketed by key.

Names are normalised once, at ingest.  A watchlist then meets the stored keys of a snapshot by a join on the key
for which only the index is exchanged: the table is written in ``BUCKETS`` buckets of the key, sorted within.  Keys
with more than ``HOT_ROWS`` rows would make one bucket a large one; their rows are kept apart, in as many
files as were written, and the few index rows that concern them are sent to all tasks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.model import register
from rollbook.operators import matching
from rollbook.plans.archive import Archive
from rollbook.session import materialise

#: Buckets of a snapshot's keys.  It is part of the layout: all snapshots of an archive share it.
BUCKETS = 32
#: A key of more rows than this is kept apart; there are at most ``claims / HOT_ROWS`` of them.
HOT_ROWS = 100_000
BY = ("kind", "key")
COLUMNS = "row_key string, ordinal bigint, first boolean, rank bigint, kind string, `column` string, value string, key string"


class MatchKeys:
    """``row_key, ordinal, first, rank, kind, column, value, key`` of every snapshot of an archive.

    ``first`` marks the rows that events speak of: the first one of each ``row_key``.
    """

    def __init__(self, archive: Archive):
        self.archive, self.spark = archive, archive.spark

    def _path(self, source: str, stamp: str, part: str) -> str:
        return self.archive._partition(f"match_keys/{part}", source, stamp)

    def has(self, source: str, stamp: str) -> bool:
        return self.archive._exists(f"{self._path(source, stamp, 'hot')}/_SUCCESS")

    def write(self, source: str, stamp: str) -> None:
        """Store the keys of one committed snapshot; once more gives the same."""
        rows = self.archive._rows(source, stamp).select("source", "row_key", "ordinal", "fields")
        columns = matching.register_columns(self.spark, [register(source)])
        claims = materialise(matching.match_keys(rows, columns, keep=("row_key", "ordinal")), "claims")
        if self.archive.header(source, stamp)["duplicate_keys"]:
            firsts = rows.groupBy("row_key").agg(F.min("ordinal").alias("at"))
            claims = claims.join(firsts, "row_key").withColumn("first", F.col("ordinal") == F.col("at")).drop("at")
        else:
            claims = claims.withColumn("first", F.lit(True))
        claims = claims.selectExpr("row_key", "ordinal", "first", "rank", "kind", "`column`", "value", "key")
        hot = materialise(claims.groupBy(*BY).count().where(F.col("count") > HOT_ROWS).select(*BY), "hot-keys")
        cold = claims.join(hot, list(BY), "left_anti").select(*claims.columns).repartition(BUCKETS, *BY)
        self._forget(source, stamp)
        writer = cold.write.format("parquet").mode("overwrite").option("path", self._path(source, stamp, "cold"))
        writer.bucketBy(BUCKETS, *BY).sortBy(*BY).saveAsTable(self._name(source, stamp))
        # Last, as the sign that both parts are there.
        claims.join(hot, list(BY), "left_semi").select(*claims.columns).write.mode("overwrite").parquet(self._path(source, stamp, "hot"))

    def _name(self, source: str, stamp: str) -> str:
        return f"match_keys_{hashlib.md5(self._path(source, stamp, 'cold').encode()).hexdigest()}"

    def _forget(self, source: str, stamp: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(source, stamp)}")

    def read(self, source: str, stamp: str) -> DataFrame:
        """All but hot keys, in buckets.  The table is made known to this session if another one wrote it."""
        name, path = self._name(source, stamp), self._path(source, stamp, "cold").replace("'", "\\'")
        kept = f"CLUSTERED BY ({', '.join(BY)}) SORTED BY ({', '.join(BY)}) INTO {BUCKETS} BUCKETS"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet {kept} LOCATION '{path}'")
        return self.spark.table(name)

    def hot(self, source: str, stamp: str) -> DataFrame:
        return self.spark.read.schema(COLUMNS).parquet(self._path(source, stamp, "hot"))

    def retire(self, source: str, stamp: str) -> None:
        self._forget(source, stamp)
        for part in ("hot", "cold"):  # the mark goes first
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(source, stamp, part))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def matched(self, source: str, stamp: str, index: DataFrame) -> DataFrame:
        """The strongest match of every row of a snapshot: ``source, stamp, row_key, ordinal, first`` and the match.

        ``index`` is :func:`rollbook.operators.matching.watch_index`.
        """
        index = index.where(matching.covers(F.lit(source)))
        hot = self.hot(source, stamp)
        # As many index rows as there are hot keys at most.
        apart = F.broadcast(index.join(hot.select(*BY).distinct(), list(BY), "left_semi"))
        hits = self.read(source, stamp).join(index, list(BY)).unionByName(hot.join(apart, list(BY)))
        best = F.struct("entity_id", "entity_label", F.col("kind").alias("match"), F.col("column").alias("match_column"), F.col("value").alias("match_value"), "row_key", "first")
        found = hits.groupBy("ordinal").agg(F.min_by(best, "rank").alias("m"))
        return found.select(F.lit(source).alias("source"), F.lit(stamp).alias("stamp"), "ordinal", "m.*")
