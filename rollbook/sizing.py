"""Use of all cores by scans with few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a table that one task of a spread scan gets at most, on average.
PIECE_BYTES = 2 << 20
#: Larger tables have splits enough, and more to exchange.
SPREAD_BYTES = 512 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for what follows a scan that has too few splits, by pieces that do not grow with the table.

    A row group is read by one task, however many splits its file has, and so is everything up to the
    next exchange; compact tables have few of them.  A scan of many bytes with enough splits comes back unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    pieces = max(cores, -(-size // PIECE_BYTES)) if size <= SPREAD_BYTES else cores
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df
