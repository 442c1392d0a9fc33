"""Rows keep an identity of their own however many files they come in."""

import json

import pytest
from pyspark.sql import functions as F

from rollbook.functions.text import variant_cell
from rollbook.model import WATCHLIST
from rollbook.operators import matching, snapshots
from rollbook.operators.filters import served_page
from rollbook.plans.archive import Archive
from rollbook.sources.csv_files import read_csv_rows
from rollbook.sources.json_pages import collapse_nested
from rollbook.sources.landing import page_documents, read_bodies
from rollbook.sources.payment_institutions import label_codes, read_eba_golden_copy
from rollbook.sources.uid_xml import organisation_fields, read_uid_xml
from rollbook.sources.watchlists import load_watchlist


def firms(spark, n=400):
    return spark.range(n).select(F.col("id").cast("string").alias("code"), F.format_string("Firm %04d AG", "id").alias("name"))


def test_csv_parts(spark, tmp_path):
    path = str(tmp_path / "csv")
    firms(spark).repartition(4).write.option("header", True).csv(path)
    for multiline in (True, False):
        rows, header = read_csv_rows(spark, path, multiline=multiline)
        assert header == ["code", "name"] and rows.count() == 400 and rows.select("ordinal").distinct().count() == 400
    watch = spark.createDataFrame([("all", "", [], [f"Firm {i:04d}" for i in range(400)], [], "")], WATCHLIST)
    columns = spark.createDataFrame([("x", ["code"], ["name"])], "source string, identifiers array<string>, names array<string>")
    columns = columns.toDF(*matching.register_columns(spark).columns[: len(columns.columns)])
    matched = matching.match_rows(rows.select("ordinal", "fields", F.lit("x").alias("source")), watch, columns)
    assert matched.count() == 400


def test_csv_files_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,name\n1,One\n")
    (tmp_path / "b.csv").write_text("name,code,city\nTwo,2,Lindau\n")
    (tmp_path / "c.csv").write_text("")
    rows, header = read_csv_rows(spark, str(tmp_path))
    assert header == ["code", "name", "city"]
    got = {r.fields["code"]: r for r in rows.collect()}
    assert got["1"].fields == {"code": "1", "name": "One"} and got["2"].fields == {"code": "2", "name": "Two", "city": "Lindau"}
    assert got["1"].ordinal < got["2"].ordinal


def test_long_lines_in_splits(spark, tmp_path):
    firms(spark, 3000).coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, _ = read_csv_rows(spark, str(tmp_path / "csv"), multiline=False)
        got = [r.fields["code"] for r in rows.orderBy("ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [str(i) for i in range(3000)]


def test_json_pages_of_two_landings(spark, tmp_path):
    for folder in ("20260816", "20260817"):
        (tmp_path / folder).mkdir()
        for page in (1, 2, 10):
            body = {"data": [{"n": f"{folder}-{page}-{i}"} for i in range(3)]}
            (tmp_path / folder / f"{page:05d}.json").write_text(json.dumps(body))
        (tmp_path / folder / "manifest.jsonl").write_text('{"seq": 1}\n')
    docs = page_documents(read_bodies(spark, [str(tmp_path / f) for f in ("20260816", "20260817")]), "data")
    got = [r.ordinal for r in docs.collect()]
    assert len(got) == len(set(got)) == 18
    in_order = [r.n for r in docs.orderBy("ordinal").select(F.try_variant_get("doc", "$.n", "string").alias("n")).collect()]
    assert in_order[:6] == [f"{f}-1-{i}" for f in ("20260816", "20260817") for i in range(3)] and in_order[-1] == "20260817-10-2"


def test_names_that_start_with_a_time(spark, tmp_path):
    for second in range(20):
        (tmp_path / f"202608161248{second:02d}.json").write_text(json.dumps({"data": [{"a": 1}, {"a": 2}]}))
    docs = page_documents(read_bodies(spark, str(tmp_path)), "data")
    assert docs.select("ordinal").distinct().count() == 40


def test_lines_and_xml_parts(spark, tmp_path):
    lines = firms(spark).select(F.to_json(F.struct(F.lit("PSD_PI").alias("EntityType"), F.col("code").alias("EntityCode"))).alias("value"))
    lines.repartition(4).write.text(str(tmp_path / "lines"))
    rows = read_eba_golden_copy(spark, str(tmp_path / "lines"), lines=True)
    assert rows.count() == rows.select("ordinal").distinct().count() == 400
    for part in range(4):
        items = "".join(f"<organisationType><organisation><name>{part}-{i}</name></organisation></organisationType>" for i in range(100))
        folder = tmp_path / "xml" / f"part={part}"
        folder.mkdir(parents=True)
        (folder / "part-00000.xml").write_text(f"<r>{items}</r>")
    rows = read_uid_xml(spark, str(tmp_path / "xml"))
    assert rows.count() == rows.select("ordinal").distinct().count() == 400


def test_labels_of_rows_that_share_an_ordinal(spark):
    rows = spark.createDataFrame([(1, {"c": "a |  | b"}), (1, {"c": "b | x"}), (1, {"c": " | "}), (2, {})], "ordinal bigint, fields map<string,string>")
    lists = spark.createDataFrame([("L", "a", "A"), ("L", "b", "B"), ("M", "a", "other")], "code_list string, code string, label string")
    got = [r.fields for r in label_codes(rows, lists, [("c", "t", "L", True), ("d", "u", "L", False)], optional=("d",)).collect()]
    assert sorted(f["t"] for f in got) == ["", "", "A | B", "B | x"] and all("u" not in f for f in got)


def test_a_key_of_two_rows_gives_one_event(spark, tmp_path):
    archive = Archive(spark, str(tmp_path))
    old = [(1, {"id": "k", "v": "1"}), (1, {"id": "k", "v": "2"}), (1, {"id": "m", "v": "1"})]
    new = [(1, {"id": "k", "v": "3"}), (1, {"id": "k", "v": "4"}), (1, {"id": "m", "v": "1"})]
    for stamp, items in (("20260101T000000Z", old), ("20260102T000000Z", new)):
        rows = spark.createDataFrame(items, "ordinal bigint, fields map<string,string>")
        archive.write_snapshot("finma", rows, stamp=stamp, key_columns=["id"])
    assert [r.kind for r in archive.diff("finma", "20260101T000000Z", "20260102T000000Z").collect()] == ["changed"]


def test_no_column_is_left_out(spark, tmp_path):
    archive = Archive(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, {f"c{i:03d}": "x" for i in range(300)})], "ordinal bigint, fields map<string,string>")
    assert len(archive.write_snapshot("finma", rows, stamp="20260101T000000Z")["columns"]) == 300


def test_deep_values(spark):
    deep, xml = {"leaf": "x"}, {"leaf": "x"}
    for i in range(20):
        deep, xml = {f"k{i}": deep}, {f"k{i}": [xml, xml] if i == 3 else xml}
    table = spark.createDataFrame([(1, json.dumps(deep), json.dumps(xml))], "ordinal bigint, a string, b string")
    table = table.select("ordinal", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    path = ".".join([*(f"k{i}" for i in reversed(range(20))), "leaf"])
    assert collapse_nested(table, F.col("a")).first().fields == {path: "x"}
    assert organisation_fields(table, F.col("b")).first().fields[path] == "x | x"
    cells = {'[[["a","b"]],"c"]': "a | b | c", '[[[[[["x, y"]]]], 1], null]': "x, y | 1 | ", "[]": "", '[{"a":1}]': '{"a": 1}', '["[", ["\\"q\\""]]': '[ | "q"'}
    rows = spark.createDataFrame([(k,) for k in cells], "t string").select("t", variant_cell(F.parse_json("t")).alias("cell"))
    assert {r.t: r.cell for r in rows.collect()} == cells


def plain_cell(value, skip_blank):
    """The rendering of lists as a plain recursion."""
    if isinstance(value, list):
        cells = [plain_cell(v, skip_blank) for v in value]
        return " | ".join(c for c in cells if c or not skip_blank)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)


@pytest.mark.parametrize("skip_blank", [False, True])
def test_lists_of_any_depth(spark, skip_blank):
    deep = ["x"]
    for i in range(30):
        deep = [i, deep] if i % 2 else [deep, {"k": [[i]]}]
    values = [
        ["a", ["b", ["c"]]], [[["a {x}"]], "b"], [[[{"a": [[1]]}]], {"b": {"c": [[2]]}}], ["a", [], [[]], [None, ["", "b"]]], [], [[]], [[[]]],
        ["]", ["[[", ['\\"[', ["q\"["]]]], ["[1, [2]]", ["{", ["}"]]], {"a": ["b", ["c"]]}, "[[", 1, None, [1.5, [True, [None]]], deep,
        ["a\nb [", ["c", ["d"]]],
    ]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    got = {r.i: r.cell for r in rows.select("i", variant_cell(F.parse_json("t"), skip_blank=skip_blank).alias("cell")).collect()}
    assert got == {i: plain_cell(v, skip_blank) for i, v in enumerate(values)}
    mapped = rows.select("i", F.transform(F.array(F.parse_json("t")), lambda v: variant_cell(v, skip_blank=skip_blank))[0].alias("cell"))
    assert {r.i: r.cell for r in mapped.collect()} == got


def test_watchlist_names_alike_in_their_beginning(spark, tmp_path):
    start = "Gesellschaft für die Verwaltung langer Namen und noch längerer Titel "
    (tmp_path / "w.json").write_text(json.dumps([{"label": start + "Nord"}, {"label": start + "Süd"}]))
    assert load_watchlist(spark, str(tmp_path / "w.json")).select("id").distinct().count() == 2


def test_served_page_refuses_more_than_its_ceiling(rows):
    table = rows([{"a": str(i)} for i in range(30)])
    assert served_page(table, 20, ceiling=20).count() == 20
    try:
        served_page(table, 21, ceiling=20)
    except ValueError:
        return
    raise AssertionError


def test_intermediates_need_a_shared_folder(spark, monkeypatch):
    from rollbook import session

    monkeypatch.setattr(session, "_one_process", lambda spark: False)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    try:
        session.shared_folder(spark, "x")
    except ValueError:
        return
    raise AssertionError


def test_events_of_a_run_that_broke_off(spark, tmp_path):
    from rollbook.plans.ingest import ingest_register

    archive = Archive(spark, str(tmp_path))
    make = lambda v: spark.createDataFrame([(1, {"Name": "a", "UID": "u1", "City": v})], "ordinal bigint, fields map<string,string>")
    for stamp, city in (("20260101T000000Z", "x"), ("20260102T000000Z", "y")):
        archive.write_snapshot("finma", make(city), stamp=stamp)
    outcome = ingest_register(archive, "finma", lambda: make("z"), stamp="20260103T000000Z")
    assert outcome.ok and outcome.changed == 1
    events = archive.read_changes("finma").select("_snapshot", "kind").collect()
    assert sorted(map(tuple, events)) == [("20260102T000000Z", "changed"), ("20260103T000000Z", "changed")]
