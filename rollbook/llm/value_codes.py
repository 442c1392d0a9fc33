"""Vector code compression by product quantisation with dictionaries of values per dimension.

Vectors become integers and are cut into parts; a part is coded as the nearest entry of its codebook.
Distances are not computed per vector: every dimension of a batch has a dictionary of its distinct integers,
and the squared differences of these to all entries are tabulated once.  The distances of a
part are then gathers from these tables by dictionary code, added up over the part's dimensions.

All sums are whole numbers of any size, so results depend neither on the partitioning nor on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.vectors import matrix, of_usual_length, whole
from rollbook.session import materialise

#: Components are multiplied by this and rounded down; entries of a codebook; parts; rounds of learning.
SCALE, ENTRIES, PARTS, ROUNDS = 4096, 16, 8, 6
#: Sums travel in pieces of so many bits, each of which Spark adds up on its own.
_BITS = 60
_LONG = (1 << 63) - 1

Books = list[list[list[int]]]  # by part, entry, position


def cuts(width: int) -> list[int]:
    """Where parts begin, and the end: equal parts, as far as ``width`` allows."""
    return [width * p // PARTS for p in range(PARTS + 1)]


def nearest(x: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For every row of a part its nearest entry (ties to the lower index) and the squared distance."""
    entries = np.array(book, object).reshape(len(book), x.shape[1])
    if x.dtype != object and max((abs(c) for row in book for c in row), default=0) < 1 << 31:
        entries = entries.astype(np.int64)
    total = np.zeros((len(x), len(book)), entries.dtype if entries.dtype == object else x.dtype)
    for d in range(x.shape[1]):
        values, codes = np.unique(x[:, d], return_inverse=True)
        total = total + ((values[:, None] - entries[None, :, d]) ** 2)[codes.ravel()]
    at = total.argmin(axis=1)
    return at, total[np.arange(len(x)), at]


def pieces(value: int) -> Iterator[int]:
    """``value`` as digits to the base of 2^60: the last has the sign, all others are not negative."""
    while not -(1 << _BITS) <= value < 1 << _BITS:
        yield value & (1 << _BITS) - 1
        value >>= _BITS
    yield value


def _sums(books: Books, width: int):
    """Per task and entry the number of parts assigned to it (position -1) and their sums."""
    at = cuts(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            x = whole(matrix(batch.column("v"), width), SCALE)
            for p, book in enumerate(books):
                own = x[:, at[p] : at[p + 1]]
                chosen, _ = nearest(own, book)
                for e in np.unique(chosen).tolist():
                    mine = own[chosen == e]
                    for position, s in enumerate([len(mine), *mine.sum(axis=0).tolist()], -1):
                        sums[p, e, position] = sums.get((p, e, position), 0) + int(s)
        rows = [(*key, place, piece) for key, s in sums.items() for place, piece in enumerate(pieces(s))]
        names = ("part", "entry", "position", "place", "piece")
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=names)

    return run


def learn(rows: DataFrame, width: int, first: list[list[float]]) -> Books:
    """The codebooks after all rounds; ``rows`` has ``v``.  What comes to the driver is one sum per entry and position."""
    at = cuts(width)
    start = whole(np.array(first, float).reshape(-1, width), SCALE).tolist()
    books = [[[int(c) for c in row[at[p] : at[p + 1]]] for row in start] for p in range(PARTS)]
    kind = "part bigint, entry bigint, position bigint, place bigint, piece bigint"
    for _ in range(ROUNDS):
        summed = rows.select("v").mapInArrow(_sums(books, width), kind).groupBy("part", "entry", "position", "place")
        sums: dict[tuple[int, int, int], int] = {}
        for r in summed.agg(F.sum(F.col("piece").cast("decimal(38,0)")).alias("s")).collect():
            key = (r.part, r.entry, r.position)
            sums[key] = sums.get(key, 0) + (int(r.s) << _BITS * r.place)
        books = [
            [
                [sums[p, e, i] // sums[p, e, -1] for i in range(at[p + 1] - at[p])] if (p, e, -1) in sums else entry
                for e, entry in enumerate(book)
            ]
            for p, book in enumerate(books)
        ]
    return books


def _coder(books: Books, width: int, names: list[str]):
    at = cuts(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(matrix(batch.column("v"), width), SCALE)
            code, error = [""] * len(x), [0] * len(x)
            for p, book in enumerate(books):
                chosen, distance = nearest(x[:, at[p] : at[p + 1]], book)
                code = [c + f"{e:02x}" for c, e in zip(code, chosen.tolist(), strict=True)]
                error = [a + int(b) for a, b in zip(error, distance.tolist(), strict=True)]
            error = [e if e <= _LONG else None for e in error]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(code), pa.array(error, pa.int64())], names=[*names, "code", "error"])

    return run


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row of ``vectors`` (``vec_id, embedding, label``).

    Null vectors and those with a null or a component that is not finite are left out, as are empty ones and those
    of another length than most have.  Where the length is no multiple of ``PARTS``, parts differ by one.
    The codebooks start as the smallest ids (null ids last, ties by vector), fewer entries if there are fewer
    rows.  Rows that repeat are coded each; rows without a label share one ``label_error``.  An error beyond the
    largest long is null, and so is the sum of a label that holds one or passes it.  An empty table gives
    no rows; further columns are ignored.
    """
    rows, width = of_usual_length(vectors, "vec_id", "label")
    schema = rows.select("vec_id", "label").schema
    ends = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = materialise(rows, "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    books = learn(rows, width, [r.v for r in first]) if first else []
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    coded = materialise(rows.mapInArrow(_coder(books, width, ["vec_id", "label"]), f"{ends}, code string, error bigint"), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.when((F.count("error") == F.count("*")) & (total <= _LONG), total.cast("bigint")).alias("label_error"))
    coded = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql() -> str:
    """The same in SQL, for vectors whose length is a multiple of ``PARTS``."""
    steps = [
        f"""kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
            list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (
        SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p))""",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= {ENTRIES})",
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"""set{n} AS MATERIALIZED (
        SELECT r, p, any_value(x) AS x, min(row(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e)) AS best
        FROM parts JOIN book{n} USING (p) GROUP BY r, p)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""sum{n} AS MATERIALIZED (
        SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT p, best[2] AS e, unnest(x) AS c, unnest(range(len(x))) AS i FROM set{n}) GROUP BY p, e, i),
    mean{n} AS MATERIALIZED (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sum{n} GROUP BY p, e),
    book{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, y) AS y FROM book{n} LEFT JOIN mean{n} USING (p, e))"""
            )
    return f"""
    WITH {", ".join(steps)},
    coded AS (
        SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM set{ROUNDS} GROUP BY r),
    digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (r), digest
    """
