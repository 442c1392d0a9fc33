"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

A seed is a hash of the words at fixed offsets of a span; words at the other offsets may
differ.  Seeds of the benchmark fill a Bloom filter of fixed size, and documents are scanned
once with it: a position whose seed passes goes on with the words around it.  These few rows
join the benchmark's seeds by hash, which aligns document and item, and the alignment is
verified by counting equal words in the windows around the seed.

Words are carried as 64-bit hashes.  Positions are unfolded by ``explode`` within one
generated stage, which costs a tenth of the same look-ups inside a lambda.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.session import materialise

#: Word offsets that each seed reads.  Of every window of nine to sixteen words in which ``EQUAL_SHARE``
#: are equal, some span has all five words of a mask equal: no leak is without a seed.
MASKS = (
    (0, 1, 2, 3, 6), (0, 1, 3, 4, 7), (0, 2, 4, 6, 7), (0, 2, 5, 7, 8),
    (0, 4, 5, 6, 8), (1, 2, 3, 4, 5), (1, 2, 6, 7, 8), (3, 5, 6, 7, 8),
)
SPAN = 9
#: Seeds of items too short for a span: runs of one to three words.  By the length of the item, where runs
#: start and how long they are; there is one more of them than words that may differ, and none overlap.
RUNS = ((0,), (0, 1), (0, 1, 2))
SHORT = {1: ((0, 1),), 2: ((0, 2),), 3: ((0, 3),), 4: ((0, 2), (2, 2)), 5: ((0, 3), (3, 2)), 6: ((0, 3), (3, 3)),
         7: ((0, 3), (3, 3)), 8: ((0, 3), (3, 3), (6, 2))}
#: A leak has a window of this many aligned words (the whole item if it is shorter) with this share equal.
VERIFY_WORDS, EQUAL_SHARE = 16, 0.75
#: The Bloom filter has so many bits per seed of the benchmark, and 2 to the first power (8 kB) at least and to the
#: second (16 MB) at most.  A benchmark of millions of words makes it pass more; results stay the same.
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 64, 16, 27
_PROBES = (0, 21, 42)

#: Words before and behind the start of a seed that its windows can reach.
_BEFORE, _AROUND = VERIFY_WORDS - 1, 2 * VERIFY_WORDS + SPAN

#: Words of a text as hashes: lower-cased runs of letters and digits.
_HASHES = r"transform(split(lower(cast(text as string)), '[^\\p{L}\\p{N}]+'), w -> xxhash64(w))"
_NO_WORD = "xxhash64('')"


def _words(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the words ``h`` of ``text``; the empty words that a split leaves at the ends are taken off."""
    ends = f"int(element_at(h, 1) = {_NO_WORD}), int(element_at(h, -1) = {_NO_WORD})"
    cut = rows.select(*keep, F.expr(_HASHES).alias("h")).select(*keep, "h", F.expr(f"struct({ends})").alias("cut"))
    return cut.select(*keep, F.expr("slice(h, 1 + cut.col1, greatest(0, size(h) - cut.col1 - cut.col2))").alias("h"))


def _positions(rows: DataFrame, span: int, *keep: str) -> DataFrame:
    """A row per place ``at`` at which ``span`` words fit into ``h``."""
    return rows.select(*keep, "h", F.explode(F.expr(f"case when size(h) >= {span} then sequence(0, size(h) - {span}) end")).alias("at"))


def _seeds(positions: DataFrame, masks: tuple[tuple[int, ...], ...], *keep: str) -> DataFrame:
    """A row per mask with its ``seed``, a hash of the mask's number and the words it reads.

    Words behind the end are left out of the hash, which no seed of an item's span equals.
    """
    seeds = [f"xxhash64({m}, {', '.join(f'get(h, at + {k})' for k in mask)})" for m, mask in enumerate(masks)]
    return positions.select(*keep, "h", "at", F.explode(F.expr(f"array({', '.join(seeds)})")).alias("seed"))


def _short_seeds(items: DataFrame) -> DataFrame:
    """The seeds of items of fewer than ``SPAN`` words."""
    by_length = []
    for n, runs in SHORT.items():
        seeds = [f"struct({at} as at, xxhash64({len(MASKS) + k - 1}, {', '.join(f'get(h, {at + i})' for i in range(k))}) as seed)" for at, k in runs]
        by_length.append(f"when {n} then array({', '.join(seeds)})")
    return items.select("item_id", "h", F.inline(F.expr(f"case size(h) {' '.join(by_length)} end")))


def _around() -> Column:
    """The words a window over the seed can hold, and how many of them stand before it."""
    return F.expr(f"struct(slice(h, greatest(0, at - {_BEFORE}) + 1, {_AROUND}) as words, least(at, {_BEFORE}) as before)")


def _filter_bits(seeds: int) -> int:
    return min(max((BITS_PER_SEED * seeds - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _bloom(seeds: DataFrame, power: int) -> DataFrame:
    """One row, one column: the filter as an array of 64-bit words."""
    places = F.array(*[F.expr(f"shiftrightunsigned(seed, {p}) & {(1 << power) - 1}") for p in _PROBES])
    bits = F.expr("bit_or(shiftleft(1L, int(place % 64)))").alias("bits")
    filled = seeds.select(F.explode(places).alias("place")).groupBy(F.expr("place div 64").alias("slot")).agg(bits)
    slots = seeds.sparkSession.range(0, 1 << (power - 6), 1, 1).withColumnRenamed("id", "slot")
    whole = slots.join(filled, "slot", "left").select("slot", F.coalesce("bits", F.lit(0)).alias("bits"))
    return whole.agg(F.expr("transform(sort_array(collect_list(struct(slot, bits))), x -> x.bits)").alias("bloom"))


def _passes(bloom: DataFrame, power: int) -> Column:
    held, found = bloom.scalar(), F.lit(True)
    for probe in _PROBES:
        slot = F.expr(f"cast(shiftrightunsigned(seed, {probe + 6}) & {(1 << (power - 6)) - 1} as int)")
        bit = F.expr(f"cast(shiftrightunsigned(seed, {probe}) & 63 as int)")
        found = found & (F.call_function("shiftrightunsigned", F.get(held, slot), bit).bitwiseAND(F.lit(1)) == 1)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, short_items: bool = False) -> DataFrame:
    """``doc_id, item_id, equal_words, window_words, position`` of every leak.

    A text of ``docs`` (``doc_id``, ``text``) leaks an item of ``benchmark`` (``item_id``,
    ``text``) if at some alignment a window has ``EQUAL_SHARE`` equal words.  A window is
    ``VERIFY_WORDS`` words of the item, the whole item if it is shorter, all of which the text covers.
    The best window of an id and item is reported, ties to the earliest ``position`` (of the
    window's first word in the text).

    Items of fewer than ``SPAN`` words take part with ``short_items`` only: an item of one word leaks
    into every text that has it.  Null and empty texts have no leaks, and
    what is no word has no place: the first word of a text is at 0.  Repeated rows
    are reported once per ``doc_id``, null ids as one.  Other columns are ignored; empty tables
    give no rows.
    """
    items = _words(benchmark.select("item_id", "text").where("text is not null").distinct(), "item_id")
    seeds = _seeds(_positions(items, SPAN, "item_id"), MASKS, "item_id").withColumn("span", F.lit(SPAN))
    masks, least = MASKS, SPAN
    if short_items and items.where(F.size("h").between(1, SPAN - 1)).head(1):
        seeds = seeds.unionByName(_short_seeds(items).withColumn("span", F.lit(1)))
        masks, least = MASKS + RUNS, 1
    seeds = seeds.select("item_id", "seed", "at", "span", F.expr(f"least({VERIFY_WORDS}, size(h))").alias("width"), _around().alias("item"))
    items = materialise(seeds, "seeds")
    power = _filter_bits(items.count())
    bloom = materialise(_bloom(items, power), "bloom")

    hits = _seeds(_positions(_words(docs, "doc_id"), least, "doc_id"), masks, "doc_id").where(_passes(bloom, power))
    hits = hits.select("doc_id", "seed", F.col("at").alias("doc_at"), _around().alias("doc"))
    pairs = hits.join(items, "seed")
    # One passage is met by several seeds at every place, so a pair has to be cheap to verify: equal words are bits of one
    # number, bit k for the word k - _BEFORE behind the seed, and the windows over the seed are counts of its bits.
    bit = f"shiftleft(cast(coalesce(get(doc.words, doc.before + k - {_BEFORE}) = get(item.words, item.before + k - {_BEFORE}), false) as bigint), k)"
    equal = f"aggregate(sequence(0, {2 * VERIFY_WORDS - 2}), 0L, (bits, k) -> bits | {bit})"
    pairs = pairs.select("doc_id", "item_id", "width", "doc_at", F.expr(equal).alias("equal"), F.expr("greatest(span - width, -least(doc.before, item.before))").alias("first"),
                         F.expr("least(0, least(size(doc.words) - doc.before, size(item.words) - item.before) - width)").alias("last"))
    windows = [f"case when {-back} between first and last then 64 * bit_count(equal & shiftleft(shiftleft(1L, width) - 1, {_BEFORE - back})) + {back} end" for back in range(VERIFY_WORDS)]
    pairs = pairs.select("doc_id", "item_id", "width", "doc_at", F.expr(f"greatest({', '.join(windows)})").alias("best"))
    pairs = pairs.where(F.expr("best div 64") >= EQUAL_SHARE * F.col("width"))
    # Most equal words, then the earliest place; as one number, so that it is reduced before the exchange.
    rank = F.expr("shiftleft(best div 64, 48) + shiftleft((1L << 40) - (doc_at - best % 64), 6) + width")
    return (
        pairs.groupBy("doc_id", "item_id")
        .agg(F.max(rank).alias("best"))
        .select("doc_id", "item_id", F.expr("int(shiftright(best, 48))").alias("equal_words"), F.expr("int(best & 63)").alias("window_words"),
                F.expr("int((1L << 40) - (shiftright(best, 6) & ((1L << 42) - 1)))").alias("position"))
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, short_items: bool = False) -> DataFrame:
    """The rows of ``docs`` whose id leaks nothing, unchanged; rows with a null id are judged together."""
    leaks = materialise(find_leaks(docs, benchmark, short_items=short_items).select(F.col("doc_id").alias("leaking")).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leaking")), "left_anti")
