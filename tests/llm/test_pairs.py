"""Decontamination, SimHash and ball trees against brute force on small fixtures."""

import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from rollbook.llm import ball_tree, components, decontamination, simhash

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 1)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    least = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(100):
        for u, v in edges:
            if u in least and v in least:
                least[u] = least[v] = min(least[u], least[v])
    assert got == least
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_fingerprint(t):
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", (t or "")) if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("t", [None, "", " \t\n", "One", "one TWO", "É Ü\x0bx y\x1cz", text(1, 200), "a " * 70_000])
def test_fingerprint(t):
    assert simhash.fingerprint(t) == plain_fingerprint(t)


def linked(prints):
    """Smallest id reachable over at most three bits, by comparing all with all."""
    least = {i: i for i, _ in prints}
    for _ in prints:
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 3 and least[j] < least[i]:
                    least[i] = least[j]
    return least


def test_near_duplicates(spark, monkeypatch):
    base = text(5, 300).split()
    docs = [(100 + i, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for i, k in enumerate(range(0, 300, 12))]
    docs += [(i, text(i, 40)) for i in range(12)] + [(50, None), (51, ""), (52, "a b"), (53, "A  B"), (53, "A  B")]
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, print int, component_id string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect())
    least = linked([(i, plain_fingerprint(t)) for i, t in docs])
    assert got == sorted((i, f"{plain_fingerprint(t):016x}", least[i]) for i, t in docs)


def test_links_at_every_distance(spark):
    rng = random.Random(11)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:30]:
        for bits in (1, 2, 3, 4):
            q = p
            for b in rng.sample(range(64), bits):
                q ^= 1 << b
            prints.append(q)
    signed = [(p - (1 << 64) if p >> 63 else p) for p in dict.fromkeys(prints)]
    marks = spark.createDataFrame(list(enumerate(signed)), "doc_id bigint, print bigint")
    got = {r.print: r.component_id for r in simhash._classes(marks).collect()}
    least = linked([(i, p & (1 << 64) - 1) for i, p in enumerate(signed)])
    assert got == {p: least[i] for i, p in enumerate(signed)}


def test_one_of_each(spark):
    docs = [(1, text(1, 50), "a"), (2, text(1, 50), "b"), (3, text(2, 50), "c"), (3, text(2, 50), "c"), (4, None, "d"), (5, "", "e"), (None, text(2, 50), "f"), (None, text(9, 50), "g"), (None, text(9, 50), "g")]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, class string")
    got = simhash.one_of_each(rows)
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([docs[0], docs[2], docs[4], docs[7]], key=str)
    assert simhash.one_of_each(rows.limit(0)).count() == 0 and simhash.near_duplicates(rows.limit(0)).count() == 0


def words_of(t):
    return regex.findall(r"[\p{L}\p{N}]+", t.lower()) if t else []


def plain_leaks(docs, items):
    """Every seed of every item at every place of every document, verified window by window."""
    seeds, best = {}, {}
    for item, t in items:
        w = words_of(t)
        for q in range(len(w) - decontamination.SPAN + 1):
            for m, mask in enumerate(decontamination.MASKS):
                seeds.setdefault((m, *(w[q + k] for k in mask)), []).append((item, q, w))
    for doc, t in docs:
        w = words_of(t)
        for p in range(len(w) - decontamination.SPAN + 1):
            for m, mask in enumerate(decontamination.MASKS):
                for item, q, other in seeds.get((m, *(w[p + k] for k in mask)), ()):
                    width = min(decontamination.VERIFY_WORDS, len(other))
                    for s in range(max(0, q + decontamination.SPAN - width), min(q, len(other) - width) + 1):
                        at = s + p - q
                        if at >= 0 and at + width <= len(w):
                            n = sum(other[s + k] == w[at + k] for k in range(width))
                            if n >= decontamination.EQUAL_SHARE * width:
                                best[doc, item] = max(best.get((doc, item), (0,)), (n, -at, width))
    return {(d, i, n, width, -at) for (d, i), (n, at, width) in best.items()}


def test_leaks(spark):
    items = [(i, text(100 + i, n)) for i, n in enumerate([40, 20, 12, 9, 8, 3, 200])] + [(7, None), (8, "")]
    docs = [(i, text(i, 150)) for i in range(8)]
    rng = random.Random(2)
    for i, (item, t) in enumerate(items[:7]):
        for share in (0, 0.1, 0.2, 0.5):
            w = ["other" if rng.random() < share else x.upper() for x in t.split()]
            docs.append((1000 * item + int(100 * share), f"«{text(i, 30)} {', '.join(w)} {text(i + 50, 30)}."))
            docs.append((1000 * item + int(100 * share) + 1, " ".join(w)))
    docs += [(90, None), (91, ""), (92, items[1][1]), (92, items[1][1]), (93, " ".join([items[0][1]] * 300))]
    rows = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(i, t, "h") for i, t in [*items, items[0]]], "item_id bigint, text string, h string")
    got = {tuple(r) for r in decontamination.find_leaks(rows, bench).collect()}
    assert got == plain_leaks(docs, items)
    assert {(d, i) for d, i, *_ in got} >= {(1000 * i + s, i) for i in (0, 1, 2, 3, 6) for s in (0, 1)}
    kept = decontamination.without_leaks(rows, bench)
    leaking = {d for d, *_ in got}
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in leaking)
    assert decontamination.find_leaks(rows.limit(0), bench).count() == 0
    assert decontamination.without_leaks(rows, bench.limit(0)).count() == len(docs)


def test_filter_grows_with_the_benchmark():
    sizes = [decontamination._filter_bits(n) for n in (0, 1, 1 << 10, (1 << 10) + 1, 1 << 16, 1 << 40)]
    assert sizes == [16, 16, 16, 17, 22, 27]


@pytest.mark.parametrize("n", range(9, 17))
def test_every_leak_has_a_seed(n):
    for changed in itertools.combinations(range(n), n // 4):
        places = range(n - decontamination.SPAN + 1)
        assert any(not {at + k for k in mask} & set(changed) for at in places for mask in decontamination.MASKS), changed


def test_every_short_leak_has_a_seed():
    for n, runs in decontamination.SHORT.items():
        for changed in itertools.combinations(range(n), n // 4):
            assert any(not set(range(at, at + k)) & set(changed) for at, k in runs), (n, changed)


def all_leaks(docs, items):
    """Every window of every item at every place of every document, without seeds."""
    best = {}
    for doc, t in docs:
        w = words_of(t)
        for item, other in ((i, words_of(x)) for i, x in items):
            width = min(decontamination.VERIFY_WORDS, len(other))
            for s in range(len(other) - width + 1) if width else ():
                for at in range(len(w) - width + 1):
                    n = sum(a == b for a, b in zip(other[s : s + width], w[at : at + width], strict=True))
                    if n >= decontamination.EQUAL_SHARE * width:
                        best[doc, item] = max(best.get((doc, item), (0,)), (n, -at, width))
    return {(d, i, n, width, -at) for (d, i), (n, at, width) in best.items()}


def test_leaks_with_all_words_allowed_to_differ(spark):
    rng = random.Random(8)
    items = [(n, text(200 + n, n)) for n in [*range(1, 17), 40]] + [(0, ""), (50, None)]
    docs = [(0, None), (1, ""), (2, items[0][1]), (3, "w1 " + items[2][1]), (4, "\"" + items[15][1]), (5, " — " + items[16][1] + "!?"), (6, "...")]
    docs += [(7, "(" + " ".join(items[16][1].split()[1:15])), (8, "«" + " ".join(items[14][1].split()[:13]) + "»"), (9, items[15][1]), (9, items[16][1])]
    for n, t in items[:17]:
        w = t.split()
        for r in range(4):
            changed = [*rng.sample(range(n), n // 4), *rng.sample(range(n), 1 if r == 3 else 0)] if n < 17 else range(r, n, 4)
            passage = ["x" if k in changed else x for k, x in enumerate(w)]
            docs.append((100 * n + r, " ".join(passage)))
            docs.append((100 * n + 10 + r, f"{text(n, 20)} {' '.join(passage)} {text(n + 60, 5)}"))
    rows, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = all_leaks(docs, items)
    got = {tuple(r) for r in decontamination.find_leaks(rows, bench, short_items=True).collect()}
    assert got == want and len({i for _, i, *_ in got}) == 17
    assert {tuple(r) for r in decontamination.find_leaks(rows, bench).collect()} == {x for x in want if x[1] >= decontamination.SPAN}
    kept = {r.doc_id for r in decontamination.without_leaks(rows, bench, short_items=True).collect()}
    assert kept == {d for d, _ in docs} - {d for d, *_ in want}


def plain_top(vectors, k):
    """Every query row against every row of another id, in Python's integers."""
    rows = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for own, q in rows:
        if own % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != own and len(v) == len(q))
            found += [(own, n + 1, i, -s if abs(s) < 1 << 63 else None) for n, (s, i) in enumerate(best[:k])]
    return Counter(found)


@pytest.mark.parametrize("shard_rows, blocks", [(20_000, 100_000), (40, 100_000), (7, 3)])
@pytest.mark.parametrize("case", ["near", "wide"])
def test_top_k(spark, monkeypatch, shard_rows, blocks, case):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(ball_tree, "BLOCK_QUERIES", blocks)
    monkeypatch.setattr(ball_tree, "LEAF", 8)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 8))
    vectors = [(i, [float(x) for x in centres[i % 6] + 0.3 * rng.standard_normal(8)]) for i in range(200)]
    vectors += [(300 + i, vectors[10][1]) for i in range(25)]
    vectors += [(400, None), (410, []), (420, [1.0, None]), (430, [float("nan")] * 8), (440, [float("inf")] * 8), (None, [1.0] * 8)]
    vectors += [(450, [1.0, 2.0]), (451, [2.0, 1.0]), (460, [1.0]), (10, vectors[10][1]), (10, vectors[11][1]), (51, vectors[10][1]), (51, vectors[12][1])]
    if case == "wide":
        vectors += [(500, [2.0**41] * 8), (501, [-(2.0**41)] + [0.5] * 7), (502, [2.0**60] * 4 + [-(2.0**60)] * 4), (503, [1e300] + [0.0] * 7), (510, [-1e308] * 8), (511, [1e308] * 8)]
    rows = spark.createDataFrame([(i, v, 5, "x") for i, v in vectors], "vec_id bigint, embedding array<double>, score int, row string").repartition(3)
    got = Counter(tuple(r) for r in ball_tree.top_k(rows, F.col("vec_id") % 10 == 0).collect())
    assert got == plain_top(vectors, 10)


def test_far_shards_are_cut():
    """A query's route ends where bounds fall below its floor."""
    pivots, radii, used = np.array([[100.0, 0.0], [0.0, 1.0], [-100.0, 0.0]]), np.array([5.0, 5.0, 5.0]), np.arange(3)
    batch = pa.RecordBatch.from_pydict({"vec_id": [1, 2], "row": [1, 2], "v": [[1.0, 0.0], [1.0, 0.0]], "floor": [None, "50000"]})
    (out,) = ball_tree._route(pivots, radii, used, 2, True, 1, 3)([batch])
    assert out.column("row").to_pylist() == [1, 1] and out.column("pivot").to_pylist() == [1, 2]


def test_top_k_of_nothing(spark):
    rows = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert ball_tree.top_k(rows, F.col("vec_id") % 10 == 0).count() == 0
