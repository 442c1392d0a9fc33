"""Token sequences in training order, as fixed-stride binary shards.

Texts are tokenised once and packed into sequences of equal length.  A keyed Feistel network
over the smallest square domain of bits, walked until it lands below the number of
sequences, is a permutation: it gives every sequence a global slot without a sort or a
shuffled index.  A shard is a range of slots.  Shards are written by Spark's own committers
as records of equal length (the ids as little-endian 16-bit numbers, then one line feed), so
they can lie in any store, the place of a slot is arithmetic, and a training run reads them
front to back from any slot.  Ranges of shards are written one after the other and noted in
a manifest; a run that broke off goes on with the first range that is not in it.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.session import materialise, shared_folder

#: Folder of the public tokenizers' files and the one used; ids fit into 16 bits.
TOKENIZER_FOLDER, TOKENIZER = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published splitting pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Separates documents and fills the last sequence of a task; a free id of the vocabulary.
END = 50256
#: Tokens of a sequence, sequences of a shard, and ranges in which shards are written.
SEQUENCE, SHARD, RANGES = 1024, 2048, 4
#: Bytes from one record to the next.
STRIDE = 2 * SEQUENCE + 1
KEY, ROUNDS = 0x5DEECE66D, 6


@functools.cache
def tokenizer(folder: str = TOKENIZER_FOLDER, name: str = TOKENIZER) -> tiktoken.Encoding:
    with open(os.path.join(folder, name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pack(folder: str, name: str):
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(folder, name).encode_ordinary
        part, at, rest = TaskContext.get().partitionId(), 0, np.empty(0, np.uint16)

        def emit(ids: np.ndarray, used: int) -> pa.RecordBatch:
            nonlocal at
            n = len(ids) // SEQUENCE
            data = ids.astype("<u2").tobytes()
            rows = [data[k * 2 * SEQUENCE : (k + 1) * 2 * SEQUENCE] for k in range(n)]
            numbers = np.arange(at, at + n, dtype=np.int64)
            at += n
            counts = np.minimum(SEQUENCE, used - np.arange(n) * SEQUENCE).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(numbers), pa.array(counts), pa.array(rows, pa.binary())],
                ["part", "number", "n_tokens", "tokens"],
            )

        for frame in frames:
            texts = frame.column(0)
            for low in range(0, len(texts), 256):
                held = [rest]
                for text in texts.slice(low, 256).to_pylist():
                    if text is not None:
                        held.append(np.array([*encode(text), END], np.uint16))
                joined = np.concatenate(held)
                full = len(joined) - len(joined) % SEQUENCE
                rest = joined[full:]
                if full:
                    yield emit(joined[:full], full)
        if len(rest):
            filled = np.full(SEQUENCE, END, np.uint16)
            filled[: len(rest)] = rest
            yield emit(filled, len(rest))

    return batches


def _mix64(x: np.ndarray) -> np.ndarray:
    """A mixing function of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, size: int, key: int = KEY, *, back: bool = False) -> np.ndarray:
    """Slots of ``numbers`` (all below ``size``) under the keyed permutation of ``0 .. size - 1``.

    With ``back`` the numbers of slots.  A value that leaves the range is permuted again until
    it is inside; the domain is under four times the range, so a few rounds do.
    """
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out, open_ = numbers.astype(np.uint64).copy(), np.ones(len(numbers), bool)
    while open_.any():
        left, right = out[open_] >> half, out[open_] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix64(right + k) & mask)
        out[open_] = (left << half) | right
        open_ &= out >= np.uint64(size)
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, *, folder: str = TOKENIZER_FOLDER, name: str = TOKENIZER) -> DataFrame:
    """Write ``part, number, n_tokens, tokens`` to ``path`` and read it: packed sequences of every task.

    Every text that is not null, in the order of its task, is followed by ``END`` (an empty text is
    that alone); the last sequence of a task is filled with ``END``, which ``n_tokens`` does not count.
    """
    packed = docs.select(F.col("text").cast("string")).mapInArrow(
        _pack(folder, name), "part int, number bigint, n_tokens int, tokens binary"
    )
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("part int, number bigint, n_tokens int, tokens binary").parquet(path)


def _numbered(packed: DataFrame) -> tuple[DataFrame, int]:
    """Sequences with their ``slot``, and how many there are.  One row per task is summed up."""
    parts = packed.groupBy("part").agg((F.max("number") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Written, so that its small size is known when the join is planned and the sequences are not moved for it.
    parts = materialise(parts, "parts")
    size = parts.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("bigint")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), size))

    joined = packed.join(parts, F.col("part") == F.col("p"))
    return joined.select(slot(F.col("base") + F.col("number")).alias("slot"), "n_tokens", "tokens"), size


def _done(spark: SparkSession, path: str) -> set[int]:
    try:
        return {r["range"] for r in spark.read.schema("range int").json(f"{path}/manifest").collect()}
    except AnalysisException:
        return set()


def write_shards(docs: DataFrame, path: str, *, folder: str = TOKENIZER_FOLDER, name: str = TOKENIZER) -> str:
    """Tokenise ``docs`` and write all shards below ``path``; returns the folder of the shards.

    Called again with the path of a run that broke off, it keeps the sequences and the ranges that
    are complete.  Rows whose text is null have no tokens; no tokens at all give no shards.
    """
    spark = docs.sparkSession
    done, kept = _done(spark, path), f"{path}/sequences"
    try:
        packed = spark.read.parquet(kept)
    except AnalysisException:
        packed = sequences(docs, kept, folder=folder, name=name)
    numbered, size = _numbered(packed)
    shards = -(-size // SHARD)
    each = max(1, -(-shards // RANGES))
    # A range's shuffle is not needed once it is written; else all ranges' would lie on disk at the end.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        for k in range(-(-shards // each)):
            if k in done:
                continue
            own = numbered.where((F.col("slot") >= k * each * SHARD) & (F.col("slot") < (k + 1) * each * SHARD))
            own = own.select((F.col("slot") / SHARD).cast("bigint").alias("shard"), "slot", "tokens")
            own = own.repartition("shard").sortWithinPartitions("shard", "slot")
            records = own.select("shard", F.col("tokens").cast("string").alias("value"))
            records.write.mode("overwrite").partitionBy("shard").option("lineSep", "\n").text(f"{path}/shards/range={k}")
            spark.createDataFrame([(k,)], "range int").coalesce(1).write.mode("append").json(f"{path}/manifest")
    finally:
        spark.conf.set(clean, before)
    return f"{path}/shards"


def read_shards(spark: SparkSession, shards: str, *, first_slot: int = 0) -> DataFrame:
    """``shard, position, slot, tokens`` of the shards' files from ``first_slot`` on.

    Shards before that slot are not opened.  ``position`` counts records in the shard; the
    tokens are the record without its line feed.
    """
    files = spark.read.format("binaryFile").load(shards).where(F.col("shard") >= first_slot // SHARD)
    files = files.select(F.col("shard").cast("bigint").alias("shard"), "content")
    rows = files.where(F.length("content") > 0).select("shard", "content", F.explode(F.expr(f"sequence(0, cast(length(content) / {STRIDE} as int) - 1)")).alias("position"))
    rows = rows.select(
        "shard", "position", (F.col("shard") * SHARD + F.col("position")).alias("slot"),
        F.expr(f"substring(content, position * {STRIDE} + 1, {2 * SEQUENCE})").alias("tokens"),
    )
    return rows.where(F.col("slot") >= first_slot)


def training_order(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` (``text``) and list every record of the files.

    ``slot, shard, position, byte_offset, crc, first_token, last_token``: where each sequence lies, the
    CRC-32 of its bytes and its ends.  Only ``text`` is read: ids may be null or repeat, other columns may have
    any name.  Null texts give nothing, repeated rows are written each, long texts span sequences.
    An empty table, or one of null texts, gives an empty list.
    """
    spark = docs.sparkSession
    shards = write_shards(docs, path or shared_folder(spark, "training"))
    try:
        records = read_shards(spark, shards)
    except AnalysisException:
        return spark.createDataFrame([], "slot bigint, shard bigint, position int, byte_offset bigint, crc bigint, first_token int, last_token int")
    number = lambda at: F.expr(f"cast(conv(hex(substring(tokens, {at + 1}, 1)), 16, 10) as int) * 256 + cast(conv(hex(substring(tokens, {at}, 1)), 16, 10) as int)")
    return records.select(
        "slot", "shard", "position", (F.col("position").cast("bigint") * STRIDE).alias("byte_offset"), F.crc32("tokens").alias("crc"),
        number(1).alias("first_token"), number(2 * SEQUENCE - 1).alias("last_token"),
    )
