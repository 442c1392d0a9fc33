"""Lookup over an archive by file signatures, against a scan of everything."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollbook.operators import history, quality
from rollbook.plans.archive import Archive
from rollbook.plans.ingest import ingest
from rollbook.plans.search_index import CHANGES, SNAPSHOTS, SearchIndex


def at(day):
    return dt.datetime(2026, 8, day, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    archive = Archive(spark, str(tmp_path_factory.mktemp("search") / "archive"))

    def table(names):
        items = [(i, {"UID": f"CHE-{i:09d}", "Name": n, "City": "Bern"}) for i, n in enumerate(names)]
        return spark.createDataFrame(items, "ordinal bigint, fields map<string,string>").repartitionByRange(8, "ordinal")

    names = [f"Firm {'abcdefghijklmnopqrstuvwxyz'[i % 26] * 3} {i}" for i in range(400)]
    names[7], names[200], names[399] = "Zürcher Käse", "STRASSE & Co", "Straße"
    assert ingest(archive, {"finma": lambda: table(names)}, now=at(1))[0].ok
    newer = [*names[:390], "Quux Holding"]
    other = spark.createDataFrame([(0, {"publication-number": "1", "winner-name": "Quux"})], "ordinal bigint, fields map<string,string>")
    assert all(o.ok for o in ingest(archive, {"finma": lambda: table(newer), "ted": lambda: other}, now=at(3)))
    return archive


@pytest.mark.parametrize("term", ["zürcher", "ZÜRCHER KÄSE", "strasse", "Quux", "Firm aaa", "Straße", "not there at all", "qu", "", "Bern", "removed"])
def test_lookup_finds_what_a_scan_finds(archive, term):
    newest = archive.snapshots().join(history.nth_newest(archive.catalog()).select("source", "stamp"), ["source", "stamp"], "left_semi")
    rows, events = SearchIndex(archive).lookup(term)
    plain = lambda df, *names: sorted(tuple(r[n] for n in names) for r in df.collect())
    assert plain(rows, "source", "ordinal", "rank") == plain(quality.lookup(newest, term), "source", "ordinal", "rank")
    assert plain(events, "source", "stamp", "kind", "row_key") == plain(quality.lookup_changes(archive.changes(), term), "source", "stamp", "kind", "row_key")


def test_few_files_are_read(archive):
    index = SearchIndex(archive)
    newest = [(r["source"], r["stamp"]) for r in history.nth_newest(archive.catalog()).collect()]
    every = sum(len([f for f in archive.spark.read.parquet(index._data(SNAPSHOTS, *p)).inputFiles()]) for p in newest)
    assert every >= 8
    assert len(index.files("Zürcher", SNAPSHOTS, newest)) == 1 and len(index.files("Quux", SNAPSHOTS, newest)) == 2
    assert index.files("not there at all", SNAPSHOTS, newest) == [] and len(index.files("qu", SNAPSHOTS, newest)) == 2  # whole folders
    told = [(r["source"], r["stamp"]) for r in archive.change_runs().where("added > 0").collect()]
    assert len(index.files("Quux", CHANGES, told)) == 1
    index.retire("ted", newest[0][1] if newest[0][0] == "ted" else newest[1][1])
    assert len(index.files("Quux", SNAPSHOTS, newest)) == 2  # without a signature the folder is read
    index.write("ted", [s for r, s in newest if r == "ted"][0])


def test_signature_is_complete(spark):
    rows = spark.createDataFrame([("f", {"a": "Äbc", "b": None, "c": "x"}), ("g", {"a": ""})], "file string, fields map<string,string>")
    from rollbook.plans import search_index

    got = search_index.signatures(rows).collect()
    bit = spark.range(1).select(search_index._bit(F.lit("äbc"))).first()[0]
    assert [(r.file, r.word, r.bits) for r in got] == [("f", bit // 64, (1 << bit % 64) - (1 << 64 if bit % 64 == 63 else 0))]
