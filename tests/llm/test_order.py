"""Mixture and training order: exact counts, round trips, edge cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import mixture, training_order


def plain_targets(sizes):
    """Weights shared out again and again until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixture.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        level = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if level[s] > 3 * sizes[s]]
        if not above:
            return fixed | level
        fixed |= {s: 3 * sizes[s] for s in above}


def mixed(rows):
    return [r.asDict() for r in mixture.mix(rows).collect()]


def docs(spark, items):
    return spark.createDataFrame([(i, t, s, 9) for i, t, s in items], "doc_id bigint, text string, source string, taken int")


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK_WORDS", 16)
    items = [(i, "a b\tc " * (i % 40), ["z", "b", None, "é", "tiny"][i % 5 if i % 25 else 1]) for i in range(400)]
    items += [(900, None, "b"), (901, "", "b"), (902, "x " * 5000, "b"), (7, "again and again", "b"), (7, "again and again", "b"), (None, "no id here", "z")]
    got = mixed(docs(spark, items))
    sizes, taken, target = Counter(), Counter(), {}
    for _, t, s in items:
        sizes[s] += len((t or "").split())
    assert len(got) == len(items) and Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in items)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert (r["first_slot"] is None) == (r["taken"] == 0)
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = plain_targets(dict(sizes))
    assert all(abs(target[s] - want[s]) < 1e-6 for s in want) and all(taken[s] == int(target[s] + 1e-9) for s in want)
    again = mixed(docs(spark, items[::-1]).repartition(7))
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["copy"])
    assert sorted(got, key=key) == sorted(again, key=key)


def test_slots_are_low_discrepancy(spark):
    edges = [("a", 0.5e6, 0, 512), ("b", 0.2e6, 512, 205), ("tiny", 9.0, 717, 0), ("none", 0.0, 717, 0), ("c", 0.3e6, 717, 307)]
    targets = spark.createDataFrame(edges, "source string, target double, low bigint, slots bigint")
    slots = sorted(((r.slot, r.source, r["rank"]) for r in mixture.schedule(spark, targets).collect()), key=lambda r: r[0])
    assert [s for s, source, _ in slots if source != "tiny"] == list(range(1024))
    for source, _, _, n in edges:
        assert sorted(r for _, s, r in slots if s == source) == list(range(max(n, int(source == "tiny"))))
    seen = Counter()
    for n, (_, source, _) in enumerate(slots, 1):
        seen[source] += 1
        assert all(abs(seen[s] - share * n) <= 4 for s, share in (("a", 0.5), ("b", 0.2), ("c", 0.3)))


def test_blocks_of_a_source_are_equal(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK_WORDS", 16)
    sizes = spark.createDataFrame([("ab"[i % 2], i, 7 + i % 90) for i in range(300)], "source string, doc_id bigint, size bigint")
    targets = mixture.source_targets(sizes)
    pieces = mixture._pieces(mixture._streams(sizes, targets)).groupBy("source", "rank").agg(F.sum("words").alias("words")).collect()
    for t in targets.collect():
        words = [r.words for r in pieces if r.source == t.source]
        assert len(words) == t.slots and max(words) - min(words) <= 1 and sum(words) == int(t.target) and 8 <= max(words) <= 17


def test_many_sources_under_two_partitionings(spark):
    """Five thousand sources: targets and shares do not depend on how rows are dealt."""
    rng = random.Random(5)
    items = [(i, f"s{rng.randrange(5000):04d}", rng.randrange(1, 400)) for i in range(9000)]
    sizes = spark.createDataFrame(items, "doc_id bigint, source string, size bigint")
    got = [{r.source: tuple(r) for r in mixture.source_targets(sizes.repartition(n)).collect()} for n in (2, 7)]
    assert got[0] == got[1]
    total = Counter()
    for _, s, n in items:
        total[s] += n
    want = plain_targets(dict(total))
    assert all(abs(got[0][s][2] - want[s]) < 1e-6 for s in want) and len(got[0]) == len(want) > 4000
    assert sum(t[4] for t in got[0].values()) == 1 << mixture.slot_power(sum(total.values()))


@pytest.mark.parametrize("copies", [3, 1024])
def test_mix_of_repeated_rows_does_not_depend_on_partitions(spark, monkeypatch, copies):
    monkeypatch.setattr(mixture, "_COPIES", copies)
    items = [(i % 40, "a b c d e f g " * (1 + i % 3), "abc"[i % 3]) for i in range(400)] + [(3, "one two three", "a")] * 30
    got = [Counter(map(tuple, mixture.mixed_documents(docs(spark, items).repartition(n)).collect())) for n in (3, 7)]
    assert got[0] == got[1] and sum(got[0].values()) > 300


def test_mixed_documents(spark):
    items = [(i, "a b c d e f g", "abc"[i % 3]) for i in range(300)] + [(900, None, "a"), (901, "", None)]
    rows = docs(spark, items)
    got = mixture.mixed_documents(rows)
    assert got.columns == rows.columns
    count = Counter(r.source for r in got.collect())
    want = plain_targets({"a": 700, "b": 700, "c": 700, None: 0})
    assert all(abs(count[s] - want[s] / 7) <= 1 for s in "abc") and max(Counter(r.doc_id for r in got.collect()).values()) <= 3
    assert mixture.mixed_documents(rows.limit(0)).count() == 0 and mixture.mix(rows.limit(0)).count() == 0
    assert mixture.mixed_documents(docs(spark, [(1, None, "a"), (2, "", "b")])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    slots = training_order.permute(np.arange(n), n)
    assert sorted(slots) == list(range(n)) and (training_order.permute(slots, n, back=True) == np.arange(n)).all()
    if n > 1000:
        assert (slots != training_order.permute(np.arange(n), n, 99)).mean() > 0.9


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SEQUENCE": 16, "SHARD": 8, "STRIDE": 33}.items():
        monkeypatch.setattr(training_order, name, value)


def stream(spark, shards):
    """Token streams of all tasks, in the order before the permutation."""
    rows = training_order.read_shards(spark, shards).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    number = training_order.permute(np.array([r.slot for r in rows]), len(rows), back=True)
    return np.concatenate([np.frombuffer(rows[i].tokens, "<u2") for i in np.argsort(number)])


def test_round_trip(spark, small, tmp_path):
    texts = ["Hello world", "", None, "x\ny\r\n\n ü ß 漢字", "again", "again", "<|endoftext|>", "long text " * 4000, "a" * 30_000]
    rows = spark.createDataFrame([(None, t, 1) for t in texts], "doc_id bigint, text string, slot int").repartition(3)
    shards = training_order.write_shards(rows, str(tmp_path / "run"))
    ids, found, held = stream(spark, shards), Counter(), []
    for token in ids:
        if token == training_order.END:
            found[tuple(held)] += 1
            held = []
        else:
            held.append(int(token))
    encode = training_order.tokenizer().encode_ordinary
    want = Counter(tuple(encode(t)) for t in texts if t)
    assert not held and {k: v for k, v in found.items() if k} == dict(want)


def test_listing_matches_files(spark, small, tmp_path):
    rows = spark.createDataFrame([(i, f"document {i} " * (i % 9 + 1)) for i in range(120)], "doc_id bigint, text string")
    got = training_order.training_order(rows, str(tmp_path / "run")).collect()
    files = {int(p.parent.name.split("=")[1]): p.read_bytes() for p in (tmp_path / "run" / "shards").rglob("part-*")}
    assert {r.shard for r in got} == set(files) and sum(map(len, files.values())) == 33 * len(got)
    for r in got:
        assert r.slot == 8 * r.shard + r.position and r.byte_offset == 33 * r.position
        record = np.frombuffer(files[r.shard][r.byte_offset : r.byte_offset + 32], "<u2")
        assert (r.first_token, r.last_token) == (record[0], record[-1]) and files[r.shard][r.byte_offset + 32 : r.byte_offset + 33] == b"\n"
    late = training_order.read_shards(spark, str(tmp_path / "run" / "shards"), first_slot=21)
    assert sorted(r.slot for r in late.select("slot").collect()) == list(range(21, len(got)))


def test_goes_on_after_a_break(spark, small, tmp_path):
    rows = spark.createDataFrame([(i, f"document {i} " * 5) for i in range(100)], "doc_id bigint, text string")
    whole = training_order.training_order(rows, str(tmp_path / "a")).select("slot", "crc").collect()
    path = tmp_path / "b"
    training_order.write_shards(rows, str(path))
    kept = spark.read.schema("range int").json(str(path / "manifest")).where("range < 2").collect()
    spark.createDataFrame([(r.range,) for r in kept], "range int").write.mode("overwrite").json(str(path / "manifest"))
    for p in (path / "shards" / "range=2").rglob("part-*"):
        p.write_bytes(b"broken")
    again = training_order.training_order(rows.where("false"), str(path)).select("slot", "crc").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, whole))


def test_nothing_to_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    for k, df in enumerate((rows, rows.limit(0))):
        assert training_order.training_order(df, str(tmp_path / str(k))).count() == 0
