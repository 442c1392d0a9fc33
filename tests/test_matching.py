import json

import pytest
from pyspark.sql import functions as F

from rollbook.functions import keys
from rollbook.model import WATCHLIST, register
from rollbook.operators import matching as mt
from rollbook.sources.watchlists import load_watchlist, read_watchlist

FIRMS = [
    {"UID": "CHE-555.012.347", "uid_digits": "555012347", "Name": "Fichtenbank AG", "City": "Lindau"},
    {"UID": "CHE-555.870.026", "uid_digits": "555870026", "Name": "Kiesel Treuhand AG"},
    {"UID": "", "Name": "Nordwind Handelsplatz AG | Börse"},
]


@pytest.fixture
def watch(spark):
    def make(*entities):
        rows = [
            (e["id"], e.get("label", ""), e.get("identifiers", []), e.get("names", []), e.get("sources", []), "")
            for e in entities
        ]
        return spark.createDataFrame(rows, WATCHLIST)

    return make


@pytest.fixture
def columns(spark):
    return mt.register_columns(spark)


def test_identifier_spellings(spark):
    values = ["CHE-555.012.347", "che555012347", "555 012 347", "CH", "12345", "---.---", "straße1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = [r[0] for r in df.select(keys.identifier_forms(F.col("v"))).collect()]
    assert out == [["CHE555012347", "555012347"], ["CHE555012347", "555012347"], ["555012347"], [], [], [], ["STRASSE1"]]


@pytest.mark.parametrize(
    "name, key",
    [
        ("Kiesel Treuhand AG", "kiesel treuhand"),
        ("MÖRIKER Talsparkasse", "moriker talsparkasse"),
        ("Alpha S.p.A.", "alpha"),
        ("Alpha G.m.b.H.", "alpha"),
        ("Alpha Sagl, Ltd.", "alpha"),
        ("Alpha Holding AG", "alpha holding"),
        ("İstanbul AG", "istanbul"),
        ("Straße 5", "strasse 5"),
        ("Søren ApS", "søren"),
        ("S.A.S.A.", "s"),
        ("...", ""),
        (None, ""),
    ],
)
def test_name_keys(name, key):
    assert keys.plain_name_key(name) == key


def test_strongest_claim_wins(rows, watch, columns):
    w = watch({"id": "fichte", "label": "Fichtenbank AG", "identifiers": ["che555012347"]}, {"id": "nordwind", "label": "Nordwind Handelsplatz"})
    out = {r["ordinal"]: r for r in mt.match_rows(rows(FIRMS, source="finma"), w, columns).collect()}
    assert set(out) == {0, 2}
    assert (out[0]["match"], out[0]["match_column"], out[0]["match_value"]) == ("identifier", "UID", "CHE-555.012.347")
    assert (out[2]["match"], out[2]["match_value"]) == ("name", "Nordwind Handelsplatz AG")


def test_entities_can_be_limited_to_sources(rows, watch, columns):
    w = watch({"id": "fichte", "label": "Fichtenbank", "identifiers": ["CHE-555.012.347"], "sources": ["ch-uid"]})
    assert mt.match_rows(rows(FIRMS, source="finma"), w, columns).count() == 0
    uid = rows([{"uid": "CHE-555.012.347"}], source="ch-uid")
    assert mt.match_rows(uid, w, columns).count() == 1


def test_contested_keys_match_nobody(rows, watch, columns):
    shared = {"identifiers": ["CHE-555.012.347"]}
    w = watch({"id": "a", "label": "A1", **shared}, {"id": "b", "label": "B1", **shared}, {"id": "c", "label": "C1", **shared})
    assert {r["key"] for r in mt.collisions(w).collect()} == {"CHE555012347", "555012347"}
    assert mt.match_rows(rows(FIRMS, source="finma"), w, columns).count() == 0


def test_scope_and_coverage(rows, watch, columns):
    w = watch(
        {"id": "fichte", "label": "Fichtenbank AG", "identifiers": ["CHE-555.012.347"]},
        {"id": "nordwind", "label": "Nordwind Handelsplatz AG"},
        {"id": "ghost", "label": "Nobody AG"},
        {"id": "far", "label": "Far AG", "sources": ["gleif"]},
    )
    table = rows(FIRMS, source="finma")
    scoped = {r["fields"]["_entity_id"]: r["fields"] for r in mt.scope(table, w, columns).collect()}
    assert scoped["fichte"]["City"] == "Lindau" and scoped["fichte"]["_match"] == "identifier"
    detail = mt.coverage_detail(table, w, columns, ["finma"])
    c = mt.coverage(detail).first()
    assert (c["watched"], c["matched"], c["by_identifier"], c["by_name"]) == (3, 2, 1, 1)
    assert [r["entity_id"] for r in mt.unmatched(detail).collect()] == ["ghost"]


def test_a_large_watchlist_matches_the_same_without_broadcast(rows, watch, columns, monkeypatch):
    items = [{"UID": f"CHE-{i:09d}" if i % 3 else "", "Name": "Hot AG" if i % 3 == 0 else f"Firm {i} GmbH"} for i in range(300)]
    w = watch({"id": "hot", "label": "Hot"}, *[{"id": f"e{i}", "label": "", "identifiers": [f"{i:09d}"]} for i in range(0, 300, 7)])
    table = rows(items, source="finma")
    small = {(r["ordinal"], r["entity_id"]) for r in mt.match_rows(table, w, columns).collect()}
    monkeypatch.setattr(mt, "watch_index", lambda w, index=mt.watch_index: index(w).hint("merge"))
    large = {(r["ordinal"], r["entity_id"]) for r in mt.match_rows(table, w, columns).collect()}
    expected = {(i, "hot") for i in range(0, 300, 3)} | {(i, f"e{i}") for i in range(0, 300, 7) if i % 3}
    assert small == large == expected


def test_one_lei_across_three_registers(rows, watch, columns):
    lei = "969500E07BR6468F5910"
    table = (
        rows([{"ae_lei": lei}], source="upreg")
        .union(rows([{"ae_lei": lei}], source="mica-casp"))
        .union(rows([{"lei": lei, "x": "1"}], source="gleif"))
        .union(rows([{"a": lei}], source="gisa"))
    )
    w = watch({"id": "oney", "label": "Oney", "identifiers": [lei]})
    assert mt.match_rows(table, w, columns).filter("match = 'identifier'").count() == 3
    keyed = mt.match_keys(table.withColumn("row_key", F.lit("k")), columns, keep=("source", "row_key"))
    x = mt.entity_xref(keyed, ["upreg", "mica-casp", "gleif"]).filter(F.col("key") == lei).first()
    assert x["registers"] == 3 and x["gleif_rows"] == 1
    assert mt.shared_rows(keyed).filter(F.col("key") == lei).count() == 3


def test_subject_by_identifier_then_by_name(rows):
    finma = register("finma")
    hit, how = mt.find_subject(rows(FIRMS), "555012347", finma)
    assert how == "identifier" and hit.count() == 1
    hit, how = mt.find_subject(rows(FIRMS), "borse", finma)
    assert how == "name" and hit.first()["ordinal"] == 2
    assert mt.find_subject(rows(FIRMS), "nobody", finma)[1] == ""


def test_watching_changes(rows, watch, columns, spark):
    from rollbook.model import CHANGES

    events = spark.createDataFrame(
        [
            ("s0", "removed", "k", [], None, FIRMS[0], "finma", "s1"),
            ("s0", "added", "z", [], {"Name": "Other"}, None, "finma", "s1"),
            ("s0", "added", "z", [], {"Name": "Fichtenbank AG"}, None, "gisa", "s1"),
        ],
        CHANGES,
    )
    w = watch({"id": "fichte", "label": "Fichtenbank AG"})
    (hit,) = mt.watch_changes(events, w, columns).collect()
    assert hit["fields"]["_change"] == "removed" and hit["fields"]["_snapshot"] == "s1" and hit["entity_id"] == "fichte"


def test_watchlist_files(spark, tmp_path):
    a, b, c = tmp_path / "a.json", tmp_path / "b.csv", tmp_path / "c.json"
    a.write_text(json.dumps({"name": "x", "entities": [
        {"id": "fichte", "label": "Fichtenbank AG", "identifiers": ["CHE-1", " "], "names": "Fichtenbank | Fichtenbank Switzerland"},
        {"label": "Kiesel Treuhand AG"},
    ]}))
    b.write_text("id,label,identifiers,names,sources\nfichte,Other,1,,\nnordwind,Nordwind,CHE-2|CHE-3,Nordwind|Börse,finma|ch-uid\n")
    c.write_text(json.dumps(["Jonas Weidenkamp"]))
    out = {r["id"]: r for r in load_watchlist(spark, str(a), str(b), str(c)).collect()}
    assert set(out) == {"fichte", "kiesel-treuhand", "nordwind", "Jonas Weidenkamp"}
    assert out["fichte"]["names"] == ["Fichtenbank AG", "Fichtenbank", "Fichtenbank Switzerland"] and out["fichte"]["identifiers"] == ["CHE-1"]
    assert out["nordwind"]["sources"] == ["finma", "ch-uid"] and out["nordwind"]["names"] == ["Nordwind", "Börse"]
    assert out["kiesel-treuhand"]["names"] == ["Kiesel Treuhand AG"]
    c.write_text(json.dumps([{"id": "x", "note": "tbd"}, {"id": "y", "label": "Y"}, {"id": "y", "label": "Z"}]))
    assert [r["problem"] for r in read_watchlist(spark, str(c)).orderBy("position").collect()] == [
        "neither an identifier nor a name", None, "id is used twice in this file",
    ]
    with pytest.raises(ValueError, match="neither"):
        load_watchlist(spark, str(c))


def test_rows_of_a_register_do_not_meet_in_one_task_to_get_their_keys(spark, rows):
    found = mt.match_keys(rows([{"UID": "CHE-100.000.001", "Name": "Alpha"}], source="finma"), mt.register_columns(spark))
    assert "hashpartitioning(source" not in found._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_a_spread_table_do_not_grow_with_it(spark, monkeypatch, tmp_path):
    from rollbook import sizing

    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(sizing, "PIECE_BYTES", 8 << 10, raising=False)
    spread = sizing.spread(table)
    assert spread.rdd.getNumPartitions() > 20 and spread.distinct().count() == 100_000


def test_cells_are_trimmed_and_spelled_once(spark, rows, columns):
    import re

    from rollbook.functions.text import strip

    edges = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"{e} a{e}b {e}{e}",) for e in edges], "v string")
    spaces = F.regexp_replace("v", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    assert df.filter(~strip(F.col("v")).eqNullSafe(spaces)).count() == 0

    claims = mt.match_keys(rows([{"UID": " CHE-1.234.567 "}], source="finma"), columns)
    assert sorted((r["value"], r["key"]) for r in claims.collect()) == [("CHE-1.234.567", "CHE1234567")]
    # One pattern for letters, one for digits; before, cells were trimmed by one too, again for each use.
    assert len(re.findall(r"regexp_replace", claims._jdf.queryExecution().optimizedPlan().toString())) <= 2


def test_name_keys_end_like_the_pattern():
    import itertools
    import re

    forms = "|".join([*keys.LEGAL_FORMS, *(" ".join(f) for f in keys.LEGAL_FORMS if len(f) <= keys.INITIALS)])
    ends = re.compile(rf"(?:^| )(?:{forms})$")

    def by_pattern(key):
        longer = None
        while key != longer:
            key, longer = ends.sub("", key), key
        return key

    words = ["a", "s", "b", "v", "o", "y", "x", "ag", "sa", "co", "asa", "z"]
    for n in range(5):
        for name in itertools.product(words, repeat=n):
            assert keys.plain_name_key(" ".join(name)) == by_pattern(" ".join(name)), name
