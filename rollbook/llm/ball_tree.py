"""Exact top-k inner products by branch and bound in ball trees, one per shard.

Vectors are dealt to shards by the nearest of some pivots, so that a shard is a ball; a task reads a shard, builds its ball tree in
numpy and runs queries down it as they stream in, largest bound first: a ball of centre c and radius r holds no inner product with
q above q.c + |q| r.  A branch whose bound is below the current kth score of a query is cut for it.

The same bound cuts whole shards.  Queries go in rounds to their one best shard, the next two, the next four and so on; the kth
score found so far goes with them, and shards whose bound is below it are not visited.  Vectors move once a round, never
as often as there are queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.llm.vectors import finite, whole
from rollbook.session import materialise

#: Vectors of a shard, on average, and of a leaf; most pivots, which go to all tasks; queries that meet one copy of a shard.
SHARD_ROWS, LEAF, MOST_SHARDS, BLOCK_QUERIES = 20_000, 128, 4096, 100_000
#: Components are multiplied by this and rounded down.
SCALE = 1024
#: Vectors whose largest component lies within as many powers of two share a tree, in doubles scaled down by these: squares stay finite, and
#: none that counts vanishes.  All but absurdly large vectors are of the first such class, which is not scaled.
_CLASS = 200
_LONG = (1 << 63) - 1


def class_of(x: np.ndarray) -> np.ndarray:
    """The class of every row by its largest component."""
    return np.maximum(0, np.frexp(np.abs(x).max(axis=-1, initial=0.0))[1] // _CLASS)


def scaled(x: np.ndarray, down: int) -> np.ndarray:
    """The whole components as doubles times 2^-down; exact below 2^53, else to the last bit."""
    return np.where(np.abs(x) < float(1 << 43), np.ldexp(np.floor(np.clip(x, -(2.0**43), 2.0**43) * SCALE), -down), np.ldexp(x, -down) * SCALE)


def upper(centres: np.ndarray, radii: np.ndarray, query: np.ndarray) -> np.ndarray:
    """What no inner product with ``query`` in these balls exceeds; doubles round by far less than what is added."""
    reach = float(np.linalg.norm(query))
    return centres @ query + reach * radii + 1e-9 * reach * (np.linalg.norm(centres, axis=1) + radii)


class BallTree:
    """Nodes as arrays: centre, radius, children or the rows of a leaf."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, down: int):
        self.vectors, self.ids, self.down = vectors, ids, down
        self.rows, self.order = scaled(vectors, down), np.arange(len(vectors))
        self.most = np.abs(self.rows).max(axis=1, initial=0.0)
        self.centres, self.radii, self.spans, self.kids = [], [], [], []
        todo = [(0, len(vectors), None)]
        while todo:
            low, high, parent = todo.pop()
            own = self.rows[self.order[low:high]]
            centre = own.mean(axis=0)
            node = len(self.radii)
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            self.spans.append((low, high))
            self.kids.append([])
            if parent is not None:
                self.kids[parent].append(node)
            if high - low > LEAF and self.radii[node] > 0:
                far = own[((own - centre) ** 2).sum(axis=1).argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                side = np.argsort(own @ (other - far), kind="stable")
                self.order[low:high] = self.order[low:high][side]
                middle = (low + high) // 2
                todo += [(low, middle, node), (middle, high, node)]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _best(self, at: np.ndarray, query: np.ndarray, exact: list[int], down: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The best ``k`` of some rows that are at least ``floor``: in doubles where these hold the products exactly, else in Python's integers."""
        ids = self.ids[at]
        if not down and float(np.abs(query).max(initial=0.0)) * float(self.most[at].max(initial=0.0)) * len(query) < float(1 << 52):
            scores = np.rint(self.rows[at] @ query).astype(np.int64)
            if floor is not None:
                keep = scores >= floor if abs(floor) <= _LONG else np.full(len(scores), floor < 0)
                scores, ids = scores[keep], ids[keep]
            if len(scores) > k:
                first = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[first], ids[first]
            return list(zip((-scores).tolist(), ids.tolist(), strict=True))
        scores = [sum(a * b for a, b in zip(row, exact, strict=True)) for row in whole(self.vectors[at], SCALE).tolist()]
        return [(-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if floor is None or s >= floor]

    def search(self, query: np.ndarray, own_id: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The best ``k`` ``(-score, id)`` that are at least ``floor``, ties to the smaller id; rows with the query's id are left out."""
        down = _CLASS * int(class_of(query))
        q, exact = scaled(query, down), whole(query[None, :], SCALE)[0].tolist()
        down += self.down
        bounds = upper(self.centres, self.radii, q)
        best: list[tuple[int, int]] = []
        least = _as_double(floor, down)
        todo = [0]
        while todo:
            node = todo.pop()
            if bounds[node] < least:
                continue
            if self.kids[node]:
                todo += sorted(self.kids[node], key=lambda n: bounds[n])
                continue
            low, high = self.spans[node]
            at = self.order[low:high]
            at = at[self.ids[at] != own_id]
            if found := self._best(at, q, exact, down, k, floor):
                best = sorted([*best, *found])[:k]
                if len(best) == k and (floor is None or -best[-1][0] > floor):
                    floor = -best[-1][0]
                    least = _as_double(floor, down)
        return best


def _as_double(score: int | None, down: int) -> float:
    """A score in the units of the bounds, rounded down by a hair."""
    if score is None:
        return -np.inf
    x = float(score) if not down else float(Fraction(score, 1 << down))
    return x - 1e-12 * abs(x)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _deal(pivots: np.ndarray, width: int):
    """``pivot`` and distance to it of every vector; -1 for those of another length or class than the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (pivots**2).sum(axis=1)
        for batch in batches:
            pivot, far = np.full(len(batch), -1), np.zeros(len(batch))
            fits = np.flatnonzero(batch.column("v").value_lengths().to_numpy() == width)
            own = _vectors(batch.column("v"))
            fits = np.array([i for i in fits if not class_of(own[i])], np.int64)
            for at in np.array_split(fits, max(1, len(fits) // 512)):
                if len(at):
                    x = scaled(np.array([own[i] for i in at]), 0)
                    pivot[at] = (squares - 2 * (x @ pivots.T)).argmin(axis=1)
                    far[at] = np.sqrt(((x - pivots[pivot[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far)], names=[*batch.schema.names, "pivot", "far"])

    return run


def _route(pivots: np.ndarray, radii: np.ndarray, used: np.ndarray, width: int, others: bool, low: int, high: int):
    """The pivots that a query visits in this round: from ``low`` to ``high`` in the order of bounds, if the bound reaches its floor.

    The first round also goes to what is near no pivot, if there are such ``others``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, to = [], []
            floors = batch.column("floor").to_pylist()
            for i, v in enumerate(_vectors(batch.column("v"))):
                order = [-1] if others and not low else []
                if len(v) == width:
                    down = _CLASS * int(class_of(v))
                    bounds = upper(pivots[used], radii[used], scaled(v, down))
                    at = np.argsort(-bounds, kind="stable")[low:high]
                    order += used[at[bounds[at] >= _as_double(None if floors[i] is None else int(floors[i]), down)]].tolist()
                rows += [i] * len(order)
                to += order
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to, pa.int64())], names=[*batch.schema.names, "pivot"])

    return run


def _searcher(k: int):
    """Rows come by shard, its vectors before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, [], None
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("pivot", "part", "block", "asks", "vec_id", "row", "floor")]
            for own, v in zip(zip(*columns, strict=True), _vectors(batch.column("v")), strict=True):
                if own[:3] != shard:
                    shard, held, trees = own[:3], [], None
                if not own[3]:
                    held.append((own[4], v))
                    continue
                if trees is None:
                    alike: dict[tuple[int, int], list] = {}
                    for i, x in held:
                        alike.setdefault((len(x), int(class_of(x))), []).append((i, x))
                    trees = [(w, BallTree(np.array([x for _, x in r]), np.array([i for i, _ in r]), _CLASS * c)) for (w, c), r in alike.items()]
                    held = []
                floor = None if own[6] is None else int(own[6])
                for width, tree in trees:
                    if width == len(v):
                        found += [(own[5], own[4], i, -s) for s, i in tree.search(v, own[4], k, floor)]
            kept = [s if -_LONG - 1 <= s <= _LONG else None for _, _, _, s in found]
            arrays = [pa.array([f[n] for f in found], pa.int64()) for n in range(3)]
            exact = pa.array([str(f[3]) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.int64()), exact], names=["row", "query_id", "vec_id", "score", "exact"])

    return run


_FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint, exact string"


def _rank(found: DataFrame, k: int) -> DataFrame:
    """Best first.  Scores that no long holds are ordered by their sign, length and digits."""
    minus, digits = F.startswith("exact", F.lit("-")), F.length("exact")
    beyond = F.when(F.col("score").isNotNull(), 0).when(minus, -1).otherwise(1)
    order = [
        beyond.desc(), F.col("score").desc(), (beyond * digits).desc(),
        F.when(beyond > 0, F.col("exact")).desc(), F.when(beyond < 0, F.col("exact")).asc(), F.col("vec_id"),
    ]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``vectors`` that ``is_query`` holds for, the best others.

    ``vectors`` has ``vec_id`` and ``embedding``.  The score is the inner product of the rounded
    components, exact whatever their size, and null where no long holds it; ties go to the smaller ``vec_id``.  Rows with the query's id
    are no candidates for it.  Rows that repeat an id are candidates each, and asked each.  Rows with
    a null id, a null vector or one with a null or no finite number, or without any, take no part; vectors of another length than the
    query's are no candidates.  Fewer candidates than ``k`` give all of them.
    """
    spark = vectors.sparkSession
    rows = vectors.where(finite(F.col("embedding")) & (F.size("embedding") > 0) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("v"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    usual = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "width")).alias("usual")).first().usual
    if usual is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = usual.width

    # Any rows will do as pivots; these are the same on every run and spread over the table.
    number = min(MOST_SHARDS, -(-usual.n // SHARD_ROWS))
    plain = F.array_max(F.transform("v", F.abs)) < float(2 ** (_CLASS - 1))
    drawn = rows.where((F.size("v") == width) & plain).orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(number)
    pivots = scaled(np.array([r.v for r in drawn.select("v").collect()], float).reshape(-1, width), 0)
    kind = "vec_id bigint, row bigint, v array<double>"
    dealt = materialise(rows.select("vec_id", "row", "v").mapInArrow(_deal(pivots, width), f"{kind}, pivot bigint, far double"), "dealt")
    balls = {r.pivot: r for r in dealt.groupBy("pivot").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # MOST_SHARDS + 1 rows at most
    used, radii = np.array(sorted(p for p in balls if p >= 0), np.int64), np.zeros(len(pivots))
    for p in used:
        radii[p] = balls[p].far * (1 + 1e-9)
    # A ball with many more vectors than others is cut into parts, which queries visit together.
    parts = F.create_map(*[F.lit(x) for p, b in balls.items() for x in (p, max(1, round(b.n / (2 * SHARD_ROWS))))])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("row"), parts[F.col("pivot")]))

    asked = rows.where("asks").select("vec_id", "row", "v")
    best = spark.createDataFrame([], f"{_FOUND}, rank int")
    low, high = 0, 1
    while low < max(1, len(used)):
        kth = best.where(F.col("rank") == k).select(F.col("row").alias("of"), F.col("exact").alias("floor"))
        queries = asked.join(kth, F.col("row") == F.col("of"), "left").drop("of")
        routed = queries.mapInArrow(_route(pivots, radii, used, width, -1 in balls, low, high), f"{kind}, floor string, pivot bigint")
        routed = materialise(routed, "routed")
        loads = {r.pivot: r.n for r in routed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
        if loads:
            blocks = F.create_map(*[F.lit(x) for p, n in loads.items() for x in (p, -(-n // BLOCK_QUERIES))])
            of = routed.withColumn("blocks", blocks[F.col("pivot")]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
            of = of.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts[F.col("pivot")].cast("bigint") - 1)))
            held = dealt.where(F.col("pivot").isin(list(loads))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks[F.col("pivot")].cast("bigint") - 1)))
            columns = ("pivot", "part", "block", "asks", "vec_id", "row", "floor", "v")
            held = held.withColumn("asks", F.lit(False)).withColumn("floor", F.lit(None).cast("string")).select(*columns)
            both = held.unionByName(of.withColumn("asks", F.lit(True)).select(*columns))
            both = both.repartition("pivot", "part", "block").sortWithinPartitions("pivot", "part", "block", "asks")
            found = both.mapInArrow(_searcher(k), _FOUND)
            best = materialise(_rank(found.unionByName(best.drop("rank")), k), "best")
        low, high = high, 2 * high + 1
    return best.select("query_id", "rank", "vec_id", "score")
