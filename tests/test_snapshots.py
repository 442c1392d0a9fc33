import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from rollbook.functions import keys
from rollbook.operators import snapshots as sn

OLD = [{"UID": "1", "Name": "Alpha", "t": "x"}, {"UID": "2", "Name": "Beta"}, {"UID": "3", "Name": "Gamma"}]


def key_of(rows, item, columns):
    return rows([item]).select(keys.row_key(F.col("fields"), columns).alias("k")).first()["k"]


def events(df):
    return [(r["kind"], r["row_key"], tuple(r["columns"])) for r in sn.ordered_changes(df).collect()]


def diff(rows, old, new, columns=("UID",)):
    return sn.diff_snapshots(sn.with_keys(rows(old), columns), sn.with_keys(rows(new), columns))


def test_keys_cannot_be_forged(rows):
    left = key_of(rows, {"a": "x\x1fy", "b": "z"}, ["a", "b"])
    right = key_of(rows, {"a": "x", "b": "y\x1fz"}, ["a", "b"])
    assert left != right and left == "x\\x1fy\x1fz"
    assert key_of(rows, {"a": " CHE-1 ", "b": None}, ["a", "b"]) == "CHE-1\x1f"


def test_rows_without_key_are_known_by_content(rows):
    item = {"a": " ", "name": 'Al"ph,a: ß', "timestamp": "now"}
    text = json.dumps({"a": " ", "name": 'Al"ph,a: ß'}, ensure_ascii=False, sort_keys=True)
    expected = "sha256:" + hashlib.sha256(text.encode()).hexdigest()[:32]
    assert key_of(rows, item, ["a"]) == expected == key_of(rows, item, [])
    assert key_of(rows, {"a": None, "name": "x"}, ["a"]) != key_of(rows, {"a": None, "name": "y"}, ["a"])


def test_column_level_events(rows):
    new = [{"UID": "1", "Name": "Alpha2", "t": ""}, {"UID": "2", "Name": "Beta", "timestamp": "1"}, {"UID": "4"}]
    out = diff(rows, OLD, new)
    assert events(out) == [("added", "4", ()), ("changed", "1", ("Name", "t")), ("removed", "3", ())]
    assert diff(rows, OLD, OLD).count() == 0


def test_absent_equals_blank_and_volatile_is_ignored(rows):
    assert diff(rows, [{"UID": "1", "a": ""}], [{"UID": "1", "b": "", "_vintage": "2"}]).count() == 0


def test_different_registers_are_refused(rows):
    with pytest.raises(ValueError, match="different registers"):
        sn.diff_snapshots(rows([]), rows([]), sources=("a", "b"))


def test_change_rows_carry_former_values(rows, dicts):
    new = [{"UID": "1", "Name": "A2", "t": "x"}, {"UID": "2", "Name": "Beta"}]
    out = {r["kind"]: r["fields"] for r in sn.change_rows(diff(rows, OLD, new)).collect()}
    assert out["changed"] == {
        "_change": "changed", "_key": "1", "_changed_columns": "Name", "UID": "1", "Name": "A2", "t": "x",
        "Name__was": "Alpha",
    }
    assert out["removed"]["Name"] == "Gamma" and out["removed"]["_changed_columns"] == ""


def test_first_row_of_a_key_counts(rows):
    new = [*OLD, {"UID": "1", "Name": "Impostor"}]
    assert diff(rows, OLD, new).count() == 0
    assert sn.duplicate_keys(sn.with_keys(rows(new), ["UID"])).first()["duplicate_keys"] == 1


def test_digest_ignores_order_and_partitioning(rows, spark):
    hashed = sn.with_keys(rows(OLD + OLD[:1]), ["UID"])
    first = sn.body_digest(hashed).first()
    again = sn.body_digest(sn.with_keys(rows(OLD[:1] + OLD[::-1]).repartition(3), ["UID"])).first()
    assert first == again and first["row_count"] == 4
    assert sn.body_digest(sn.with_keys(rows(OLD), ["UID"])).first()["body_digest"] != first["body_digest"]
    assert sn.body_digest(sn.with_keys(rows([]), ["UID"])).first() == (sn.EMPTY_DIGEST, None)


def _random_rows(rng, n):
    out = []
    for _ in range(n):
        uid = "hot" if rng.random() < 0.34 else str(rng.randrange(n))
        row = {"UID": uid if rng.random() < 0.95 else ""}
        for c in rng.sample("abc", rng.randrange(4)):
            row[c] = rng.choice(["", "1", "2"])
        out.append(row)
    return out


def test_against_brute_force_and_inverses(rows):
    rng = random.Random(3)
    old, new = _random_rows(rng, 120), _random_rows(rng, 120)

    def index(items):
        out = {}
        for r in items:
            key = r["UID"] or "sha256:" + hashlib.sha256(json.dumps(r, sort_keys=True).encode()).hexdigest()[:32]
            out.setdefault(key, r)
        return out

    before, after = index(old), index(new)
    expected = []
    for k in before.keys() | after.keys():
        o, n = before.get(k), after.get(k)
        if o is None:
            expected.append(("added", k, ()))
        elif n is None:
            expected.append(("removed", k, ()))
        elif moved := tuple(sorted(c for c in o.keys() | n.keys() if o.get(c, "") != n.get(c, ""))):
            expected.append(("changed", k, moved))
    expected.sort()
    forward = diff(rows, old, new)
    assert events(forward) == expected
    swap = {"added": "removed", "removed": "added", "changed": "changed"}
    assert events(diff(rows, new, old)) == sorted((swap[k], key, c) for k, key, c in expected)
    base = sn.first_copies(sn.with_keys(rows(old), ["UID"]))
    restored = {r["row_key"]: r["fields"] for r in sn.apply_changes(base, forward).collect()}
    filled = lambda d: {k: v for k, v in d.items() if v}
    assert {k: filled(v) for k, v in restored.items()} == {k: filled(v) for k, v in after.items()}


def test_summary_notes(rows, spark):
    from rollbook.model import SNAPSHOT_CATALOG

    def meta(keys_, dup):
        row = ("finma", "s", "2026", 3, dup, "d", keys_, "", "", [], [], "", "", "", "", 1.0, "")
        return spark.createDataFrame([row], SNAPSHOT_CATALOG)

    out = sn.summarise(diff(rows, OLD, OLD[:2]), meta(["UID"], 0), meta(["UID"], 2)).first()
    assert (out["removed"], out["old_rows"], len(out["notes"])) == (1, 3, 1) and "UID" in out["notes"][0]


def test_export_order_is_the_same_for_equal_snapshots(rows):
    one = sn.export_order(sn.with_keys(rows(OLD), ["UID"])).select("row_key", "row_hash").collect()
    two = sn.export_order(sn.with_keys(rows(OLD[::-1]).repartition(3), ["UID"])).select("row_key", "row_hash").collect()
    assert one == two and [r["row_key"] for r in one] == ["1", "2", "3"]


def test_exports_compare_by_digest(rows):
    items = [{"k": f"{i % 37:02d}", "v": str(i % 90)} for i in range(500)]
    keyed = [sn.with_keys(rows(part).repartition(n), ["k"]) for part, n in ((items, 3), (items[::-1], 7), (items[:-1] + [{"k": "01", "v": "other"}], 3))]
    digests = [sn.export_digest(k, page=20).first() for k in keyed]
    assert digests[0] == digests[1] and digests[0]["rows"] == digests[2]["rows"] == 500 and digests[0]["digest"] != digests[2]["digest"]
    placed = [sorted((r["position"], r["row_key"], r["row_hash"]) for r in sn.export_positions(k).collect()) for k in keyed[:2]]
    assert placed[0] == placed[1] and [p[0] for p in placed[0]] == list(range(500)) and [p[1:] for p in placed[0]] == sorted(p[1:] for p in placed[0])
    assert sn.export_digest(sn.with_keys(rows([]), ["k"])).first()["rows"] == 0
    assert sn.export_digest(sn.with_keys(rows(items[:1]), ["k"])).first()["rows"] == 1


def test_digest_is_the_tree_whatever_meets_in_a_node(spark):
    draw = random.Random(5)
    heads = ["".join(draw.choice("0123456789abcdef") for _ in range(8)) for _ in range(40)] + ["0000000" + c for c in "0123"]
    hashes = [draw.choice(heads) + hashlib.sha256(str(draw.random()).encode()).hexdigest()[8:] for _ in range(400)]
    hashes += draw.choices(hashes, k=100)

    def node(members):
        return hashlib.sha256("\n".join(sorted(members)).encode()).hexdigest()

    def tree(given):
        leaves, branches = {}, {}
        for h in set(given):
            leaves.setdefault(h[:8], []).append(f"{h}:{given.count(h)}")
        for head, members in leaves.items():
            branches.setdefault(head[:4], []).append(f"{head[4:]}:{node(members)}")
        return node([f"{b}:{node(members)}" for b, members in branches.items()])

    df = spark.createDataFrame([(h, i % 2) for i, h in enumerate(hashes)], "row_hash string, part int").repartition(3)
    assert sn.body_digest(df).first() == (tree(hashes), len(hashes))
    assert {tuple(r) for r in sn.body_digest(df, "part").collect()} == {(p, tree(hashes[p::2]), len(hashes[p::2])) for p in (0, 1)}
    # Lists of the lower levels are not packed and sorted by aggregates; only the root is one.
    plan = sn.body_digest(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_cells_of_change_rows_are_their_values(spark):
    kind = "kind string, row_key string, columns array<string>, row map<string,string>, previous map<string,string>"
    told = [
        ("added", "1", [], {"a": "x", "b": None}, None),
        ("removed", "2\x1f3", [], None, {"a": "x"}),
        ("changed", "3", ["a", "b"], {"a": "y", "b": "z"}, {"a": "x"}),
        ("changed", "4", ["a"], {"a": "y", "a__was": "own", "_key": "own"}, {"a": "x"}),
        ("changed", "5", ["a", "a__was"], {"a": "y", "a__was": "now"}, {"a": "x", "a__was": "then"}),
    ]
    events = spark.createDataFrame(told, kind)
    rows_ = {r["row_key"]: r["fields"] for r in sn.change_rows(events).collect()}
    assert rows_["4"] == {"_change": "changed", "_key": "own", "_changed_columns": "a", "a": "y", "a__was": "x"}
    assert rows_["5"]["a__was"] == "x" and rows_["5"]["a__was__was"] == "then"
    cells = {r["row_key"]: r["cells"] for r in sn.change_cells(events, keep=("row_key",)).collect()}
    assert {k: sorted(map(str, v)) for k, v in cells.items()} == {k: sorted(map(str, v.values())) for k, v in rows_.items()}


def test_json_of_plain_rows_is_that_of_the_pattern(spark):
    from rollbook.functions.text import sorted_map_json, spaced_json

    odd = [chr(c) for c in range(1, 0x180)] + [":", ",", "},{", "[{", "}]", "]", '"', "\\", '","value":"', '"},{"key":"', "null", "key", "value", "", "日本", "😀", "[]", "{}"]
    maps = [{}, {"a": None}, {"a": None, "b": "x"}]
    maps += [{o: p, "k": o, f"z{o}": f"{p}{o}"} for o in odd for p in ("", "x", o, "}]", ":", None)]
    df = spark.createDataFrame([(m,) for m in maps], "fields map<string,string>")
    whole = lambda f: spaced_json(F.to_json(F.map_from_entries(F.sort_array(F.map_entries(f)))))
    blank = F.transform_values("fields", lambda _, v: F.coalesce(v, F.lit("")))
    told = df.select(sorted_map_json(F.col("fields")).alias("a"), whole(F.col("fields")).alias("b"), sorted_map_json(F.col("fields"), filled=True).alias("c"), whole(blank).alias("d"))
    assert [r for r in told.collect() if r["a"] != r["b"] or r["c"] != r["d"]] == []
