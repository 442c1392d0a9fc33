import hashlib

import pytest

from rollbook.operators import quality, sinks
from rollbook.sources.landing import read_bodies


def test_personal_data_gate(rows):
    t = rows([{"EntityType": "PSD_AG"}, {"EntityType": "PSD_PI"}, {}])
    assert quality.personal_data_gate(t, "eba-psd") is t and quality.personal_data_gate(t, "finma") is t
    for source, select in (("eba-psd", "ALL"), ("eba-psd", "ag"), ("ch-uid", None)):
        with pytest.raises(quality.PersonalDataRefused):
            quality.personal_data_gate(t, source, select)
    assert quality.personal_data_gate(t, "ch-uid", allow=True) is t
    assert quality.without_dependents(t).count() == 2


def test_completeness(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"pagination": {"totalRecords": 5}, "data": [{}, {}]}')
    (tmp_path / "2.json").write_text('{"pagination": {"totalRecords": 5}, "data": [{}]}')
    pages = quality.page_totals(read_bodies(spark, str(tmp_path)), "$.pagination.totalRecords", "data")
    r = quality.completeness(pages).first()
    assert (r["collected"], r["reported"], r["missing"], r["warning"]) == (3, 5, 2, "fewer records than reported")
    capped = spark.createDataFrame([(None, 30, 30)], "total long, records long, window long")
    assert quality.completeness(capped).first()["warning"] == "as many records as the interface hands out"


def test_schema_drift(rows):
    def state(items, header=()):
        r = quality.schema_drift(rows(items), ["a", "b"], header).first()
        return r["state"], r["missing"]

    assert state([{"a": "1"}, {"b": ""}]) == ("ok", [])
    assert state([{"a": "1"}]) == ("missing fields", ["b"])
    assert state([], ["a", "b", "c"]) == ("empty", [])
    assert state([], ["a"]) == ("missing fields", ["b"])
    assert state([]) == ("no evidence", [])


def test_file_integrity(spark, tmp_path):
    for name in "abcd":
        (tmp_path / name).write_text(name)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    table = spark.createDataFrame(
        [("a", digest("a").upper()), ("b", f" {digest('b')}  b.zip\n"), ("c", digest("x"))], "file string, digest string"
    )
    assert {r["file"]: r["ok"] for r in quality.file_integrity(spark, str(tmp_path), table).collect()} == {
        "a": True, "b": True, "c": False, "d": True,
    }


def test_sinks(spark, rows, tmp_path):
    t = rows([{"a": "x", "b": 'q"1,\n'}, {"c": ""}])
    assert sinks.write_csv(t, str(tmp_path / "csv")) == ["a", "b", "c"]
    back = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"').na.fill("").collect()
    assert sorted(map(tuple, back)) == [("", "", ""), ("x", 'q"1,\n', "")]
    sinks.write_jsonl(t, str(tmp_path / "jsonl"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "jsonl")).collect()) == ['{"a":"x","b":"q\\"1,\\n"}', '{"c":""}']
