"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule is a row of slots, a power of two of them.  The van der Corput point of slot ``j``, its bits in reverse, is mapped
through the cumulative targets to a source, so any stretch of slots holds every source in proportion, and all of them hold it to
within one slot.  Every source's documents, shuffled by a keyed hash, form one stream of words, repeated up to
``MOST_REPEATS`` times; up to its target it is cut into as many equal blocks as the source has slots.  Slots are
ranked per source by their points, and the ``r``-th slot reads the ``r``-th block: what the mix takes is what joins.

Sums over sources, documents and copies run in ranges, so neither sources nor the documents of one pass through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.llm.common import WORD
from rollbook.session import materialise

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
MOST_REPEATS = 3
BLOCK_WORDS = 512
#: Hash ranges into which a source is split for running sums.
_RANGES = 1024
#: Copies of a row that are told apart in one step.
_COPIES = 1024
SEED = 20240601


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with running sums in ``order``, own row included: over ranges of rows first, then within each.

    Rows that are equal in ``order`` share a range.  The sums of ranges are as many as there are partitions.
    """
    dealt = rows.repartitionByRange(*order).withColumn("r_part", F.spark_partition_id())
    dealt = materialise(dealt.withColumns({f"r_{name}": value for name, value in sums.items()}), "ranges")
    ahead = Window.orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("r_part").agg(*[F.sum(f"r_{n}").alias(f"r_{n}") for n in sums])
    parts = parts.select(F.col("r_part").alias("r_of"), *[F.coalesce(F.sum(f"r_{n}").over(ahead), F.lit(0)).alias(f"a_{n}") for n in sums])
    inside = Window.partitionBy("r_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumns({n: F.sum(f"r_{n}").over(inside) for n in sums}).join(F.broadcast(parts), F.col("r_part") == F.col("r_of"))
    summed = dealt.withColumns({n: F.col(n) + F.col(f"a_{n}") for n in sums})
    return summed.drop("r_part", "r_of", *[f"{p}_{n}" for n in sums for p in "ra"])


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target, low, slots`` from rows of ``source, size``.

    Sources share the total by weight; none gets over ``MOST_REPEATS`` times its size, and the
    excess goes to the others by weight until none is above.  In closed form: ordered by limit
    per weight, the level at which the first so many are at their limit and the rest share
    what is left.  The source has the ``slots`` points from ``low`` on, of a power of two that holds the total in
    blocks of ``BLOCK_WORDS`` at most.  A source too small for a point of its own has none; ``low`` is the one it falls into.

    All sums are of whole numbers, so the result does not depend on how rows are dealt.
    """
    order = [F.col("source").asc_nulls_last()]
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = _running(sources, order, place=F.lit(1).cast("bigint"))
    weights = F.array(*[F.lit(w).cast("bigint") for w in WEIGHTS])
    sources = sources.withColumn("weight", F.get(weights, ((F.col("place") - 1) % len(WEIGHTS)).cast("int"))).drop("place")
    sources = materialise(sources.withColumn("limit", F.col("source_size") * MOST_REPEATS), "sources")
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    by_ratio = [(F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last()]
    filled = _running(sources, by_ratio, limits=F.col("limit"), heavy=F.col("weight"))
    # If this source and all after it share what those before leave.
    level = (F.lit(total) - (F.col("limits") - F.col("limit"))) / (F.lit(weight) - (F.col("heavy") - F.col("weight")))
    first = filled.withColumn("level", level).where(F.col("level") <= F.col("limit") / F.col("weight"))
    first = first.agg(F.min(F.struct(F.col("limit") / F.col("weight"), "level")).alias("least")).first().least
    share = F.lit(first.level if first else None).cast("double") * F.col("weight")
    free = F.coalesce(share < F.col("limit"), F.lit(False))
    sources = sources.withColumn("target", F.coalesce(F.least("limit", share), F.col("limit").cast("double")))
    sources = _running(sources, order, fixed=F.when(free, 0).otherwise(F.col("limit")), shared=F.when(free, F.col("weight")).otherwise(0))
    reach = sources.agg(F.max(F.struct("fixed", "shared")).alias("m")).first().m
    whole = (reach.fixed + (first.level if first else 0.0) * reach.shared) if reach else 0.0
    power = slot_power(whole)

    def point(fixed: Column, shared: Column) -> Column:
        at = (fixed + F.lit(first.level if first else 0.0) * shared) / F.lit(whole or 1.0) * float(1 << power)
        return F.least(F.floor(at), F.lit(1 << power)).cast("bigint")

    ends = point(F.col("fixed"), F.col("shared"))
    low = point(F.col("fixed") - F.when(free, 0).otherwise(F.col("limit")), F.col("shared") - F.when(free, F.col("weight")).otherwise(0))
    ends = F.when((F.col("fixed") == reach.fixed) & (F.col("shared") == reach.shared), F.lit(1 << power)).otherwise(ends) if reach else ends
    return sources.select("source", "source_size", "target", F.least(low, F.lit((1 << power) - 1)).alias("low"), F.greatest(ends - low, F.lit(0)).alias("slots"))


def slot_power(words: float) -> int:
    """Slots are 2 to this power."""
    return max(0, int(-(-words // BLOCK_WORDS) - 1).bit_length())


def _reversed(slot: Column, power: int) -> Column:
    """The van der Corput point of a slot in units of 2^-power: its bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), power, "0")), 2, 10).cast("bigint") if power else F.lit(0).cast("bigint")


def schedule(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """``source, rank, slot`` for every slot: the points mapped through the cumulative targets, ranked by point.

    A point's source is found by a join on ranges of points, of which a source touches as many as it is long.
    Sources too small for a point share that of a neighbour.
    """
    held = targets.where("target > 0")
    told = held.agg(F.max(F.col("low") + F.col("slots")), F.count("*")).first()
    power = max(0, int((told[0] or 1) - 1).bit_length())
    # Twice as many ranges as sources, or a thousand, if there are so many points.
    shift = max(0, power - max(10, (2 * told[1]).bit_length()))
    points = spark.range(0, 1 << power).select(F.col("id").alias("slot"), _reversed(F.col("id"), power).alias("point"))
    points = points.withColumn("range", F.shiftright("point", shift))
    last = F.col("low") + F.greatest(F.col("slots"), F.lit(1)) - 1
    ranges = F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(last, shift)))
    spans = held.select("source", "low", last.alias("last"), ranges.alias("range"))
    own = points.join(spans, "range").where("point between low and last")
    return own.select("source", (F.col("point") - F.col("low")).alias("rank"), "slot")


def _streams(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row with its source's target and the place ``start`` of its first word in the shuffled stream.

    Rows alike in source, id and size are counted first, so any number of copies is one row up to
    the end, where ``copy`` tells them apart again.
    """
    rows = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(SEED), "doc_id", "size")).withColumn("range", F.pmod(F.col("key"), F.lit(_RANGES)))
    ranges = rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("source").alias("s"), F.col("range").alias("g"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("g")))
    rows = rows.withColumn("start", F.col("start") + F.col("ahead")).drop("s", "g", "ahead", "range", "key")
    rows = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = _unfolded(rows.withColumnRenamed("copies", "times"), "copy")
    return rows.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))


def _unfolded(rows: DataFrame, name: str) -> DataFrame:
    """Every row ``times`` times, numbered from 0 as ``name``; rows that come very often are spread over tasks in parts."""
    few = rows.where(F.col("times") <= _COPIES).withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)))
    many = rows.where(F.col("times") > _COPIES)
    many = many.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / _COPIES)))).repartition("part")
    ends = F.least((F.col("part") + 1) * _COPIES, F.col("times")) - 1
    many = many.withColumn(name, F.explode(F.sequence(F.col("part") * _COPIES, ends))).drop("part")
    return few.unionByName(many).drop("times")


def _pieces(streams: DataFrame) -> DataFrame:
    """The parts of documents in the blocks of the repeated stream: ``source, doc_id, size, copy, rank, words``.

    The whole words of a target are cut into ``slots`` blocks, equal to within a word; block ``r`` ends at ``(r + 1) * target / slots``.
    """
    streams = streams.withColumn("end", F.expr("cast(floor(target) as bigint)")).withColumn("blocks", F.expr("cast(greatest(slots, 1) as decimal(38,0))"))
    rounds = streams.where("size > 0").withColumn("low", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)), lambda e: F.col("start") + e * F.col("source_size"))))
    rounds = rounds.withColumn("high", F.expr("least(low + size, end)")).where("low < high")
    # The block of word w is the largest r with r * end div blocks <= w.
    block = lambda w: f"cast(((({w}) + 1) * blocks - 1) div end as bigint)"
    blocks = rounds.withColumn("rank", F.explode(F.expr(f"sequence({block('low')}, {block('high - 1')})")))
    words = F.expr("least(high, cast((rank + 1) * cast(end as decimal(20,0)) div blocks as bigint)) - greatest(low, cast(rank * cast(end as decimal(20,0)) div blocks as bigint))")
    return blocks.select("source", "doc_id", "size", "copy", "rank", words.alias("words"))


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copy, first_slot`` for every row of ``docs``.

    ``docs`` has ``doc_id``, ``text`` and ``source``.  ``taken`` is the words of the row that the mix
    takes, repeats counted: the whole parts of its source's targets add up exactly, and no row is
    taken over ``MOST_REPEATS`` times.  ``first_slot`` is where the schedule first reads it, null if
    it is not taken.
    A null text has size 0 and is never taken, nor is an empty one.  Repeated rows are told apart by
    ``copy``.  Null sources are a source of their own.  A run over the same rows gives the same
    mix, whatever their order.  No rows give no rows.
    """
    sizes = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")
    )
    sizes = materialise(sizes, "sizes")
    targets = materialise(source_targets(sizes), "targets")
    streams = materialise(_streams(sizes, targets), "streams")
    slots = schedule(docs.sparkSession, targets).select(F.col("source").alias("s"), F.col("rank").alias("r"), "slot")
    pieces = _pieces(streams).join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")))
    taken = pieces.groupBy("source", "doc_id", "size", "copy").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    taken = taken.select(*[F.col(c).alias(f"t_{c}") for c in ("source", "doc_id", "size", "copy")], "taken", "first_slot")
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in ("source", "doc_id", "size", "copy")]
    joined = streams.join(taken, same[0] & same[1] & same[2] & same[3], "left")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "copy", "first_slot"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, rounded to whole documents.

    A row of which the mix takes ``t`` of ``n`` words comes ``t / n`` times, rounded.  Rows alike in id, source and size
    share what is taken of them: equal rows are counted, and a hash of their columns rounds their share up or down, so the result
    does not depend on how rows are dealt.  Documents without words are never taken.  Columns are those of ``docs``.
    """
    plan = mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("m_taken"), F.count("*").alias("m_rows"))
    plan = plan.where("m_taken > 0").select(
        F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "m_taken", "m_rows"
    )
    plan = materialise(plan, "plan")
    # Written on its own, so that Spark knows how little it is where ids do not repeat, and does not move the documents for it.
    shared = materialise(plan.where("m_rows > 1"), "plan-alike")
    names = docs.columns
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").cast("string").eqNullSafe(F.col("m_source")) & (F.col("m_words") == F.col("m_size"))
    each = F.col("m_taken") / (F.col("m_size") * F.col("m_rows"))

    def planned(rows: DataFrame, told: DataFrame) -> DataFrame:
        return rows.withColumn("m_words", word_count(F.col("text"))).join(told, same)

    # The plan has a row per document taken, so it is never one to send to all tasks.
    alone = planned(docs, plan.where("m_rows = 1").hint("merge")).withColumn("m_times", F.floor(each + 0.5)).where("m_times > 0")
    alone = alone.withColumn("m_round", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m_times")))).select(*names)
    ids = shared.select(F.col("m_id").alias("m_any")).distinct()
    alike = planned(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("m_any")), "left_semi"), shared)
    alike = alike.withColumn("m_digest", F.sha2(F.to_json(F.struct(*names)), 256))
    alike = alike.groupBy("m_digest").agg(F.first(F.struct(*names)).alias("row"), F.count("*").alias("m_equal"), F.first(each).alias("m_each"))
    up = F.conv(F.substring("m_digest", 1, 8), 16, 10).cast("double") / float(1 << 32)
    alike = alike.select("row.*", F.floor(F.col("m_equal") * F.col("m_each") + up).alias("times"))
    return alone.unionByName(_unfolded(alike.where("times > 0"), "m_round").select(*names))
