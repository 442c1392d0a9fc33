import random

import pytest

from rollbook.operators import flatten
from rollbook.operators.flatten import (
    BlockLayout,
    column_names,
    flatten_auto,
    flatten_blocks,
    from_wide,
    passthrough,
    to_wide,
    union_rows,
)

FIRM = {"id": "p1", "type_s": "parent", "entity_type": "ae", "_root_": "p1", "name": "Alder Bank", "_version_": "9"}
ADVICE = {"id": "c1", "type_s": "child", "entity_type": "act", "_root_": "p1", "service": "advice", "status": "on"}
CUSTODY = {"id": "c2", "type_s": "child", "entity_type": "act", "_root_": "p1", "service": "custody", "note": "n"}
PAST = {"id": "h1", "type_s": "child", "entity_type": "hist", "_root_": "p1", "service": "dealing"}


def test_children_are_joined_in_order_with_blanks_kept(rows, dicts):
    (row,) = dicts(flatten_blocks(rows([FIRM, ADVICE, CUSTODY, PAST])))
    assert row["name"] == "Alder Bank" and "_version_" not in row
    assert row["act_count"] == "2" and row["hist_count"] == "1"
    assert row["act_service"] == "advice | custody"
    assert row["act_status"] == "on | " and row["act_note"] == " | n"
    assert "act__root_" not in row and "act_entity_type" not in row
    assert row["act_type_s"] == "child | child"


def test_order_of_arrival_decides(rows, dicts):
    (row,) = dicts(flatten_blocks(rows([CUSTODY, ADVICE, FIRM])))
    assert row["act_service"] == "custody | advice" and row["name"] == "Alder Bank"


def test_orphans_are_kept_and_marked(rows, dicts):
    (row,) = dicts(flatten_blocks(rows([ADVICE])))
    assert row["_orphan"] == "true" and row["_root_"] == "p1" and row["act_count"] == "1"


def test_second_parent_becomes_a_bucket(rows, dicts, monkeypatch):
    twin = {**FIRM, "id": "p1b", "name": "Twin"}
    third = {**FIRM, "id": "p1c", "name": "Third", "extra": "x"}
    for span in (1, 2, 1 << 16):
        if span == 2:
            monkeypatch.setattr(flatten, "SMALL_BYTES", 0)
            monkeypatch.setattr(flatten, "HEAVY", 1)
        (row,) = dicts(flatten_blocks(rows([FIRM, ADVICE, twin, third]), span=span))
        assert row["name"] == "Alder Bank"
        assert row["duplicateParent_count"] == "2"
        assert row["duplicateParent_name"] == "Twin | Third"
        assert row["duplicateParent_extra"] == " | x"


def test_a_bucket_named_like_the_one_for_later_parents_loses_nothing(rows, dicts):
    named = {**ADVICE, "entity_type": "duplicateParent"}
    (row,) = dicts(flatten_blocks(rows([FIRM, {**FIRM, "name": "Twin"}, named])))
    assert row["name"] == "Alder Bank" and row["duplicateParent_count"] == "2"
    assert sorted(row["duplicateParent_service"].split(" | ")) == ["", "advice"]
    assert sorted(row["duplicateParent_name"].split(" | ")) == ["", "Twin"]
    (row,) = dicts(flatten_blocks(rows([FIRM, named])))
    assert row["name"] == "Alder Bank" and row["duplicateParent_count"] == "1"


def test_documents_without_root_fall_back_to_id(rows, dicts):
    out = dicts(flatten_blocks(rows([{"id": "x", "type_s": "parent", "a": "1"}, {"a": "2"}, {"a": "3", "_root_": ""}])))
    assert out[0] == {"id": "x", "type_s": "parent", "a": "1"}
    assert out[1] == {"_orphan": "true", "_root_": "", "child_count": "2", "child_a": "2 | 3"}


def test_a_field_called_count_wins_over_the_bucket_count(rows, dicts):
    (row,) = dicts(flatten_blocks(rows([FIRM, {**ADVICE, "count": "many"}])))
    assert row["act_count"] == "many"


def test_bucket_column_wins_over_parent_column(rows, dicts):
    (row,) = dicts(flatten_blocks(rows([{**FIRM, "act_service": "own"}, ADVICE])))
    assert row["act_service"] == "advice"


def test_entities_keep_first_seen_order(rows, dicts):
    out = dicts(flatten_blocks(rows([{**FIRM, "_root_": "z"}, FIRM, ADVICE])))
    assert [r["_root_"] for r in out] == ["z", "p1"]


def test_separator_and_counts_are_configurable(rows, dicts):
    (row,) = dicts(flatten_blocks(rows([FIRM, ADVICE, CUSTODY]), BlockLayout(separator=";", counts=False)))
    assert row["act_service"] == "advice;custody" and "act_count" not in row


def _brute_force(docs):
    blocks = {}
    for d in docs:
        blocks.setdefault(d.get("_root_") or d.get("id") or "", []).append(d)
    out = []
    for key, members in blocks.items():
        parents = [d for d in members if d.get("type_s") == "parent"]
        row = {k: v or "" for k, v in parents[0].items()} if parents else {"_orphan": "true", "_root_": key}
        groups = {}
        for d in members:
            if d.get("type_s") == "parent":
                if d is not parents[0]:
                    groups.setdefault("duplicateParent", []).append(d)
            else:
                groups.setdefault(d.get("entity_type") or "child", []).append(d)
        for g, kids in groups.items():
            row[f"{g}_count"] = str(len(kids))
            for name in {n for k in kids for n in k} - {"_root_", "entity_type"}:
                row[f"{g}_{name}"] = " | ".join(k.get(name) or "" for k in kids)
        out.append(row)
    return out


@pytest.mark.parametrize("heavy", [None, 5, 150])
def test_one_entity_with_a_third_of_all_documents(rows, dicts, monkeypatch, heavy):
    """All entities in one task each; those of five documents or more in pieces; the hot one only."""
    if heavy:
        monkeypatch.setattr(flatten, "SMALL_BYTES", 0)
        monkeypatch.setattr(flatten, "HEAVY", heavy)
    rng = random.Random(7)
    docs = []
    for i in range(600):
        root = "hot" if rng.random() < 0.34 else f"r{rng.randrange(60)}"
        doc = {"id": f"d{i}", "_root_": root, "type_s": "parent" if rng.random() < 0.2 else "child"}
        doc["entity_type"] = rng.choice(["act", "hist", "", "x"])
        for name in rng.sample("abcdef", rng.randrange(4)):
            doc[name] = rng.choice(["", "v", f"w{i}", None])
        docs.append(doc)
    expected = _brute_force(docs)
    for span in (7, 64, 1 << 16) if heavy else (7,):
        assert dicts(flatten_blocks(rows(docs), span=span)) == expected
    found = flatten.heavy_entities(rows(docs), BlockLayout())
    assert (found is None) == (heavy is None) and (heavy != 150 or [r["entity"] for r in found.collect()] == ["hot"])


def test_documents_are_exchanged_once(rows):
    plan = flatten_blocks(rows([FIRM, ADVICE, CUSTODY] * 3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_heavy_entities_of_several_registers(rows, dicts, monkeypatch):
    docs = rows([FIRM, ADVICE, CUSTODY], source="a").union(rows([FIRM, PAST], source="b"))
    expected = sorted(map(str, dicts(flatten_blocks(docs, scope=["source"]))))
    monkeypatch.setattr(flatten, "SMALL_BYTES", 0)
    monkeypatch.setattr(flatten, "HEAVY", 3)
    assert [tuple(r) for r in flatten.heavy_entities(docs, BlockLayout(), scope=["source"]).collect()] == [("a", "p1")]
    assert sorted(map(str, dicts(flatten_blocks(docs, scope=["source"])))) == expected


def test_auto_detects_blocks_and_can_be_forced(rows, dicts):
    assert dicts(flatten_auto(rows([{"a": "1", "_version_": "2"}, {"b": None}]))) == [{"a": "1"}, {"b": ""}]
    assert dicts(flatten_auto(rows([FIRM, ADVICE])))[0]["act_count"] == "1"
    assert dicts(flatten_auto(rows([ADVICE]), block_structured=True))[0]["_orphan"] == "true"


def test_scope_separates_registers(rows, dicts):
    docs = rows([FIRM, ADVICE], source="a").union(rows([FIRM], source="b"))
    assert flatten_blocks(docs, scope=("source",)).groupBy("source").count().count() == 2


def test_wide_and_back(rows, dicts):
    table = rows([{"b": "1"}, {"b": "2", "a": ""}])
    assert column_names(table) == ["b", "a"]
    wide = to_wide(table)
    assert [tuple(r) for r in wide.orderBy("ordinal").collect()] == [(0, "1", None), (1, "2", "")]
    assert dicts(from_wide(wide, ["b", "a"], keep=["ordinal"])) == [{"b": "1"}, {"b": "2", "a": ""}]
    assert union_rows(wide, wide.select("ordinal", "b")).columns == ["ordinal", "b", "a"]


def test_passthrough_drops_internal_fields(rows, dicts):
    assert dicts(passthrough(rows([FIRM])))[0].get("_version_") is None
