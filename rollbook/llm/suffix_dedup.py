"""Removal of passages that occur more than once, exactly, by suffix arrays of shards.

Every stretch of ``LENGTH`` bytes (a window) has an anchor: of the runs of ``GRAM`` bytes in it the one with
the smallest hash, the leftmost of these.  Equal windows have equal anchors at the same offset, so windows can repeat
only where an anchor does, at two places of the corpus.  Windows with one place as their anchor lie side by side and make
up a *segment*, of less than twice ``LENGTH`` bytes.  The job narrows the text down in three steps:

1. anchors are counted.  One that occurs once repeats nothing; where all segments of one have the same content,
   each of them is repeated throughout.  Of the others, equal segments are counted and a single one goes on;
2. these are dealt to shards by anchor.  A shard sorts the suffixes of its segments by inducing,
   and the permuted common prefixes tell which windows share ``LENGTH`` bytes with a neighbour;
3. an anchor with more segments than ``GROUP`` (a very common line in different surroundings) is cut into groups.
   Each group's suffix array leaves one row per different window that it holds, and these are counted over the groups.

No step gathers the documents that share a passage: copies are counted by partial sums, and groups are bounded.
Segments of one anchor with equal 64-bit hashes count as equal, windows of one anchor with equal 128-bit hashes too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm import induced
from rollbook.llm.common import settle

#: Strings of so many bytes that start twice are removed; bytes of an anchor.
LENGTH, GRAM = 200, 64
#: Segments of one anchor that a shard takes at most; bytes of a suffix array, after which the next group begins a new one.
GROUP, SHARD_BYTES = 2048, 1 << 19
#: Text is scanned in pieces of so many windows.
_PIECE_BITS = 20
_PIECE = 1 << _PIECE_BITS

_KEY = ("anchor", "content")


def _hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at every place."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.empty(len(text), np.uint64)
    for o in range(8):
        own = words[o::8]
        own[:] = padded[o : o + 8 * len(own)].view(np.uint64)
    n = len(text) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for at in range(0, GRAM, 8):
        out += words[at : at + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def segments(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, last windows and anchors of all segments in ``text``, where documents stop at ``ends``."""
    found = []
    place = np.uint64(_PIECE * 2 - 1)
    for low in range(0, max(0, len(text) - LENGTH + 1), _PIECE):
        piece = text[low : low + _PIECE + LENGTH - 1]
        hashes = _hashes(piece)
        # The place in the low bits: of equal hashes the leftmost is the smallest.
        keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
        anchors = (_least(keys, LENGTH - GRAM + 1) & place).astype(np.int64)
        starts = low + np.arange(len(anchors))
        stop = ends[np.searchsorted(ends, starts, side="right")]
        inside = np.flatnonzero(starts + LENGTH <= stop)
        if not len(inside):
            continue
        cut = np.flatnonzero((np.diff(inside) > 1) | (np.diff(anchors[inside]) != 0)) + 1
        first, last = inside[np.concatenate(([0], cut))], inside[np.concatenate((cut, [len(inside)])) - 1]
        found.append((low + first, low + last, hashes[anchors[first]].view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _binary(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all rows behind each other, and where each ends, preceded by the start of the first."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=8 * column.offset)
    return memoryview(data if data is not None else b"")[at[0] : at[-1]], at - at[0]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = _binary(batch.column("bytes"))
        text = np.frombuffer(data, np.uint8)
        first, last, anchors = segments(text, np.append(at[1:], len(text) + 1))
        content = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]
        of = np.searchsorted(at, first, side="right") - 1
        fields = [(first - at[of]).astype(np.int32), (last - first).astype(np.int32), anchors, np.array(content, np.uint64).view(np.int64)]
        struct = pa.StructArray.from_arrays([pa.array(f) for f in fields], ["first", "span", "anchor", "content"])
        counts = np.searchsorted(of, np.arange(len(batch) + 1))
        parts = pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), struct)
        whole = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        names = [*batch.schema.names, "n_bytes", "sha256", "segments"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(at)), pa.array(whole), parts], names=names)


def shared(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For different segments of one shard: the segment and offset of every window, in the order of suffixes, and its class.

    Windows are of the same class if they are equal.  Separators stand between segments, so no window spans two.
    """
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(int(lengths.sum()) + len(parts), np.int64)
    inside = np.ones(len(text), bool)
    inside[starts + lengths] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
    order = induced.suffix_array(text)
    classes = np.cumsum(induced.common_prefixes(text, order)[order] < LENGTH)
    of = np.searchsorted(starts, order, side="right") - 1
    offset = order - starts[of]
    window = offset + LENGTH <= lengths[of]
    return of[window], offset[window], classes[window]


def _runs(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring numbers as first and last."""
    cut = np.flatnonzero(np.diff(offsets) > 1) + 1
    low, high = np.concatenate(([0], cut)), np.concatenate((cut, [len(offsets)])) - 1
    return list(zip(offsets[low].tolist(), offsets[high].tolist(), strict=True))


def _judge(keys: list[tuple], parts: list[bytes]) -> pa.RecordBatch:
    """Rows of runs of windows that repeat within the shard, and of windows that other groups of an anchor may hold too.

    The first have ``low`` and ``high``; the others a hash of the window, and ``low`` if the group holds it once.
    """
    of, offset, classes = shared(parts)
    rows = []
    if len(of):
        begins = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
        sizes = np.diff(np.append(begins, len(classes)))
        again = np.repeat(sizes > 1, sizes)
        at = np.lexsort((offset[again], of[again]))
        seg, offs = of[again][at], offset[again][at]
        cut = np.flatnonzero(np.diff(seg)) + 1
        for own, run in zip(np.split(seg, cut), np.split(offs, cut), strict=True):
            if len(own):
                rows += [(*keys[own[0]][:2], low, high, None, None) for low, high in _runs(run)]
        grouped = np.array([k[2] for k in keys])
        chosen = grouped[of[begins]]
        for s, o, size in zip(of[begins][chosen].tolist(), offset[begins][chosen].tolist(), sizes[chosen].tolist(), strict=True):
            digest = np.frombuffer(xxhash.xxh3_128_digest(parts[s][o : o + LENGTH]), np.int64).tolist()
            rows.append((*keys[s][:2], o if size == 1 else None, None, *digest))
    names = (*_KEY, "low", "high", "w1", "w2")
    kinds = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and group; a suffix array begins with a new group once the last one is large enough."""
    keys, parts, size, group = [], [], 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_KEY, "groups", "group", "bytes")]
        for anchor, content, groups, own, text in zip(*columns, strict=True):
            if size >= SHARD_BYTES and (anchor, own) != group:
                yield _judge(keys, parts)
                keys, parts, size = [], [], 0
            group = (anchor, own)
            keys.append((anchor, content, groups > 1))
            parts.append(text)
            size += len(text)
    if keys:
        yield _judge(keys, parts)


def repeats(texts: DataFrame) -> DataFrame:
    """``rid, low, high``: runs of windows of a document, by their first bytes, that also start elsewhere.

    ``texts`` has ``rid``, ``bytes`` and ``segments`` (``_scan``).  Runs of a document do not overlap.
    """
    own = texts.select("rid", F.inline("segments"))
    repeated = own.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b"))
    repeated = settle(repeated.where("n > 1").select("anchor", F.expr("a = b").alias("throughout")), "anchors")
    key = [F.when(~F.col("throughout"), F.col(c)).alias(c) for c in _KEY]
    met = settle(own.join(repeated, "anchor").select("rid", "first", "span", "throughout", *key), "met")

    doubtful = met.where("not throughout")
    counted = doubtful.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("rid").alias("rid"), F.min_by("first", "rid").alias("first"), F.min("span").alias("span"))
    counted = settle(counted, "contents")
    # Written, so that both sides of the join are plain exchanges, of which Spark splits a large one.
    anchors = settle(counted.groupBy("anchor").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")), "groups")
    parts = counted.join(anchors, "anchor").withColumn("group", F.expr("cast(pmod(xxhash64(content), groups) as int)"))
    text = F.expr(f"substring(bytes, first + 1, span + {LENGTH})").alias("bytes")
    shards = parts.join(texts.select(F.col("rid").alias("of"), "bytes"), F.col("rid") == F.col("of")).select(*_KEY, "groups", "group", text)
    shards = shards.repartition("anchor", "group").sortWithinPartitions("anchor", "group")
    judged = settle(shards.mapInArrow(_shards, "anchor bigint, content bigint, low int, high int, w1 bigint, w2 bigint"), "judged")

    # Windows that one group holds are repeated if another holds them too.
    windows = judged.where("w1 is not null")
    twice = windows.groupBy("anchor", "w1", "w2").count().where("count > 1").drop("count")
    across = windows.where("low is not null").join(twice, ["anchor", "w1", "w2"]).select(*_KEY, "low", F.col("low").alias("high"))
    in_parts = judged.where("w1 is null").select(*_KEY, "low", "high").unionByName(across)
    in_parts = in_parts.join(counted.where("n = 1").select(*_KEY), list(_KEY), "left_semi")
    verdicts = settle(counted.where("n > 1").select(*_KEY, F.lit(0).alias("low"), F.col("span").alias("high")).unionByName(in_parts), "verdicts")
    found = doubtful.join(verdicts, list(_KEY)).select("rid", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    return found.unionByName(met.where("throughout").select("rid", F.col("first").alias("low"), (F.col("first") + F.col("span")).alias("high")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the runs of each document into removed stretches and hashes what is left."""
    for batch in batches:
        data, at = _binary(batch.column("bytes"))
        removed, spans, kept = [], [], []
        for a, b, runs in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("runs"), strict=True):
            low = runs.values.field("low").to_numpy()
            high = runs.values.field("high").to_numpy() + LENGTH
            by = np.argsort(low, kind="stable")
            low, high = low[by], np.maximum.accumulate(high[by])
            new = np.concatenate(([True], low[1:] > high[:-1]))
            begins, ends = low[new].tolist(), high[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)].tolist()
            digest, from_ = hashlib.sha256(), a
            for begin, end in zip(begins, ends, strict=True):
                digest.update(data[from_ : a + begin])
                from_ = a + end
            digest.update(data[from_:b])
            removed.append(sum(ends) - sum(begins))
            spans.append(len(begins))
            kept.append(digest.hexdigest())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept)], names=names)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (``doc_id``, ``text``).

    Texts are taken as UTF-8 bytes, null ones as empty.  A byte is removed if a string of ``LENGTH`` bytes around it
    starts anywhere else too, in the same document or another; no string spans two documents, and
    removals are judged on the whole input.  Shorter texts keep all.  Repeated rows, also with the same or a null
    ``doc_id``, are different places, so each removes the other's text.  Rows come back once each; an empty table gives
    none, and further columns are ignored.
    """
    bytes_ = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("bytes")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), bytes_)
    doc_id = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"
    segment = "first:int,span:int,anchor:bigint,content:bigint"
    # Written once, so that the number a row got stays its number.
    texts = settle(rows.mapInArrow(_scan, f"{doc_id}, rid bigint, bytes binary, n_bytes bigint, sha256 string, segments array<struct<{segment}>>"), "texts", compression="zstd")
    runs = repeats(texts).groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("runs"), F.sum(F.expr("high - low + 1")).alias("windows"))
    runs = settle(runs.select(F.col("rid").alias("of"), "windows", "runs"), "runs")

    # Only documents of which a part is removed need their bytes again.
    told = texts.join(runs.select("of", "windows"), F.col("rid") == F.col("of"), "left")
    gone = F.col("windows") == F.col("n_bytes") - (LENGTH - 1)
    removed, spans = F.when(gone, F.col("n_bytes")).otherwise(0), F.when(gone, 1).otherwise(0).cast("bigint")
    kept = F.when(gone, hashlib.sha256().hexdigest()).otherwise(F.col("sha256"))
    told = told.where(F.col("windows").isNull() | gone).select("doc_id", "n_bytes", removed.alias("n_removed"), spans.alias("n_spans"), kept.alias("kept_sha256"))
    cut = texts.select("doc_id", "rid", "n_bytes", "bytes").join(runs, (F.col("rid") == F.col("of")) & (F.col("windows") < F.col("n_bytes") - (LENGTH - 1)))
    cut = cut.select("doc_id", "bytes", "runs").mapInArrow(_cut, f"{doc_id}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return told.unionByName(cut)


SQL = f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
    pieces AS MATERIALIZED (
        SELECT r, b, substr(h, 2 * b + 1, 2 * (1000 + {LENGTH} - 1)) AS t
        FROM (SELECT r, h, unnest(range(0, length(h) // 2, 1000)) AS b FROM docs)),
    windows AS (
        SELECT r, b + o AS p, md5_number(substr(t, 2 * o + 1, {2 * LENGTH})) AS w
        FROM (SELECT r, b, t, unnest(range(0, least(1000, length(t) // 2 - {LENGTH} + 1))) AS o FROM pieces WHERE length(t) >= {2 * LENGTH})),
    hashed AS MATERIALIZED (SELECT * FROM windows),
    again AS (SELECT r, p FROM hashed WHERE w IN (SELECT w FROM hashed GROUP BY w HAVING count(*) > 1)),
    marked AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > {LENGTH}, true) AS new FROM again),
    numbered AS (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p) AS span FROM marked),
    spans AS (SELECT r, span, min(p) AS low, max(p) + {LENGTH} AS high FROM numbered GROUP BY r, span),
    kept AS (
        SELECT r, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS a, low AS b FROM spans
        UNION ALL SELECT r, max(high), NULL FROM spans GROUP BY r),
    texts AS (
        SELECT r, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a, b NULLS LAST) AS rest
        FROM kept JOIN docs USING (r) GROUP BY r),
    totals AS (SELECT r, sum(high - low) AS n, count(*) AS k FROM spans GROUP BY r)
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
        sha256(unhex(coalesce(rest, h))) AS kept_sha256
    FROM docs LEFT JOIN totals USING (r) LEFT JOIN texts USING (r)
    """
