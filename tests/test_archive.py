import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rollbook.model import register_catalog
from rollbook.operators import history, quality
from rollbook.operators.stats import run_report
from rollbook.plans import records
from rollbook.plans.archive import Archive, DigestMismatch, SnapshotExists
from rollbook.plans.ingest import ingest

UTC = dt.timezone.utc
DAY1 = [{"UID": "1", "Name": "Alpha"}, {"UID": "2", "Name": "Beta"}, {"UID": "2", "Name": "Twin"}]
DAY2 = [{"UID": "1", "Name": "Alpha2"}, {"UID": "3", "Name": "Gamma"}]


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, str(tmp_path / "archive"))


def at(day, hour=0):
    return dt.datetime(2026, 8, day, hour, tzinfo=UTC)


def test_snapshots_are_verified_and_never_overwritten(archive, rows, spark):
    header = archive.write_snapshot("gisa-codes", rows([{"gewerbeschluessel": "1", "x": ""}]), stamp="20260801T000000Z")
    assert header["row_count"] == 1 and header["columns"] == ["gewerbeschluessel", "x"]
    with pytest.raises(SnapshotExists):
        archive.write_snapshot("gisa-codes", rows([]), stamp="20260801T000000Z")
    assert archive.read_snapshot("gisa-codes", "20260801T000000Z").first()["fields"] == {"gewerbeschluessel": "1", "x": ""}
    empty = archive.write_snapshot("finma", rows([]), stamp="20260801T000000Z")
    assert empty["row_count"] == 0 and empty["body_digest"]
    assert {(r["source"], r["ok"]) for r in archive.verify().collect()} == {("gisa-codes", True), ("finma", True)}
    extra = archive.read_snapshot("gisa-codes", "20260801T000000Z").drop("source", "stamp")
    extra.write.mode("append").parquet(archive._partition("snapshots", "gisa-codes", "20260801T000000Z"))
    with pytest.raises(DigestMismatch):
        archive.read_snapshot("gisa-codes", "20260801T000000Z")
    extra.write.parquet(archive._partition("snapshots", "gisa", "20260801T000000Z"))
    assert {r["source"]: r["reason"] for r in archive.verify().collect()} == {
        "gisa-codes": "digest differs", "finma": "ok", "gisa": "no catalogue entry",
    }


def test_ingest_turns_state_into_events(archive, rows, spark):
    def boom():
        raise KeyError("shape changed")

    first = ingest(archive, {"finma": lambda: rows(DAY1), "gisa": boom, "vies": boom}, now=at(1))
    assert [(o.source, o.ok, o.skipped) for o in first] == [("finma", True, ""), ("gisa", False, ""), ("vies", False, "answers lookups only")]
    assert first[0].rows == 3 and not first[0].unchanged and "shape changed" in first[1].error
    (skipped,) = ingest(archive, {"finma": lambda: rows(DAY2)}, now=at(1, 11))
    assert skipped.skipped == "archived 11.0 h ago" and skipped.rows == 3
    (second,) = ingest(archive, {"finma": lambda: rows(DAY2)}, now=at(2))
    # The key is UID and name, so the rename is a removal and an addition.
    assert (second.added, second.changed, second.removed) == (2, 0, 3)
    (third,) = ingest(archive, {"finma": lambda: rows(DAY2)}, now=at(3))
    assert third.unchanged and third.ok
    runs = archive.change_runs().orderBy("stamp").collect()
    assert [(r["against"], r["added"]) for r in runs] == [("", 0), ("20260801T000000Z", 2), ("20260802T000000Z", 0)]
    events = archive.read_changes("finma", since="20260802").collect()
    assert [r["kind"] for r in events] == ["added", "added", "removed", "removed", "removed"]
    assert events[0]["_snapshot"] == "20260802T000000Z" and archive.read_changes("finma", since="20260803").count() == 0
    assert [r["row_key"] for r in archive.read_changes(last=1).collect()] == [events[-1]["row_key"]]
    assert archive.summarise("finma", "20260801T000000Z", "20260802T000000Z").first()["removed"] == 3
    report = run_report(archive.run_log()).orderBy("run_id").first()
    assert (report["ok"], report["failed"], report["skipped"], report["rows"]) == (1, 1, 1, 3)


def test_archived_diff_with_changed_rows_and_duplicates(archive, rows):
    for day, items in ((1, DAY1), (2, [{"UID": "1", "Name": "Alpha2"}, {"UID": "2", "Name": "Beta"}, {"UID": "1", "Name": "Late"}])):
        archive.write_snapshot("eba-psd", rows(items), stamp=f"2026080{day}T000000Z", key_columns=["UID"])
    out = archive.diff("eba-psd", "20260801T000000Z", "20260802T000000Z").collect()
    assert [(r["kind"], r["row_key"], r["columns"], r["previous"]["Name"]) for r in out] == [("changed", "1", ["Name"], "Alpha")]


def test_windows_of_rows_do_not_report_removals(archive, rows):
    ingest(archive, {"ted": lambda: rows([{"publication-number": "1"}])}, now=at(1))
    (o,) = ingest(archive, {"ted": lambda: rows([{"publication-number": "2"}])}, now=at(2))
    assert (o.added, o.removed) == (1, 0)


def test_freshness_due_and_retention(archive, rows, spark):
    for day in (1, 5, 9):
        archive.write_snapshot("finma", rows(DAY2), stamp=f"2026080{day}T000000Z", meta={"select": "bank"})
    archive.write_snapshot("upreg", rows([{"id": "1"}]), stamp="not-a-stamp")
    registers, now = register_catalog(spark), F.lit(at(11, 1))
    fresh = {r["source"]: r for r in history.freshness(archive.catalog(), registers, now).collect()}
    assert (fresh["finma"]["snapshots"], fresh["finma"]["age_hours"], fresh["finma"]["stale"]) == (3, 49.0, True)
    assert fresh["upreg"]["age_hours"] is None and not fresh["upreg"]["stale"]
    due = {r["source"]: r["status"] for r in history.due_registers(archive.catalog(), registers, F.lit(at(9, 11))).collect()}
    assert (due["finma"], due["upreg"], due["vies"], due["gisa"]) == ("fresh", "due", "not listable", "due")
    assert archive.latest("finma", 2)["stamp"] == "20260805T000000Z"
    assert history.archive_answer(archive.catalog(), "finma", select="bank").first()["stamp"] == "20260809T000000Z"
    assert history.archive_answer(archive.catalog(), "finma").first() is None
    with pytest.raises(ValueError):
        history.plan_retention(archive.catalog(), now, keep_days=-1)
    assert history.plan_retention(archive.catalog(), now, keep_days=None).count() == 0
    plan = history.plan_retention(archive.catalog(), now, keep_days=1, keep_last=0)
    assert archive.retire(plan, dry_run=True) == archive.retire(plan) == [("finma", "20260801T000000Z"), ("finma", "20260805T000000Z")]
    assert archive.catalog().filter("source = 'finma'").count() == 1 and archive.snapshots().filter("source='finma'").count() == 2
    assert all(r["ok"] for r in archive.verify().collect())


def test_evidence_and_lookup(archive, rows, spark):
    archive.write_snapshot("finma", rows(DAY2), stamp="20260801T000000Z")
    hit = archive.read_snapshot("finma", "20260801T000000Z").filter("row_key like '1%'")
    e = quality.evidence_table(hit, archive.catalog(), register_catalog(spark), subject="1", matched_on="identifier").first()
    assert e["snapshot_rows"] == 2 and e["body_digest"] and e["data_licence"] == "not stated by the publisher" and e["row_hash"]
    assert quality.lookup(archive.snapshots(), "ALPHA").count() == 1


def test_of_two_writers_one_is_refused(spark, archive, rows):
    items = rows([{"UID": str(i), "Name": "x"} for i in range(200)])

    def write(_):
        try:
            return archive.write_snapshot("finma", items, stamp="20260801T000000Z")["row_count"]
        except SnapshotExists:
            return "refused"

    with ThreadPoolExecutor(3) as pool:
        assert sorted(map(str, pool.map(write, range(3)))) == ["200", "refused", "refused"]
    assert archive.catalog().count() == 1 and archive.read_snapshot("finma", "20260801T000000Z").count() == 200

    with pytest.raises(KeyError):
        archive.write_snapshot("finma", _Broken(), stamp="20260802T000000Z")
    assert archive.write_snapshot("finma", items, stamp="20260802T000000Z")["row_count"] == 200
    archive.records("snapshot_catalog").claim(archive._claim("finma", "20260803T000000Z"))  # as a killed run leaves it
    with pytest.raises(SnapshotExists, match="released"):
        archive.write_snapshot("finma", items, stamp="20260803T000000Z")
    archive.release("finma", "20260803T000000Z")
    assert archive.write_snapshot("finma", items, stamp="20260803T000000Z")["row_count"] == 200


class _Broken:
    def select(self, *_):
        raise KeyError("shape changed")


def test_records_stay_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "GRACE_SECONDS", 0)
    monkeypatch.setattr(records, "FILES", 16)
    log = records.Records(spark, str(tmp_path / "log"), "a int, b array<string>, c struct<d:double>")
    assert log.read().count() == 0
    for n in range(100):
        log.append([(n, ["x", None], (0.5,)), (n, None, None)])
    assert len(list((tmp_path / "log").glob("[!.]*"))) < 40
    got = log.read().collect()
    assert sorted((r.a, r.b is None) for r in got) == sorted((n, e) for n in range(100) for e in (False, True))
    assert all(r.c.d == 0.5 and r.b == ["x", None] for r in got if r.b)


def test_replaced_records_count_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILES", 4)
    log = records.Records(spark, str(tmp_path / "log"), "a int")
    for n in range(9):
        log.append([(n % 2,)])
    assert len(list((tmp_path / "log").glob("*.replaced"))) >= 2  # kept for readers that have listed them
    assert sorted(r.a for r in log.read().collect()) == [0] * 5 + [1] * 4


def test_rows_of_a_snapshot_do_not_meet_in_one_task_to_be_verified(archive, rows):
    archive.write_snapshot("finma", rows(DAY1), stamp="20260801T000000Z")
    plan = archive.verify()._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


def test_snapshots_without_repeated_keys_need_no_grouping(archive, spark):
    def table(items):
        return spark.createDataFrame([(i, m) for i, m in enumerate(items)], "ordinal bigint, fields map<string,string>")

    old = [{"UID": str(i), "Name": "n", "City": "a"} for i in range(20)]
    new = [{"UID": str(i), "Name": "n", "City": "b" if i % 2 else "a"} for i in range(5, 25)]
    archive.write_snapshot("finma", table(old), stamp="20260801T000000Z")
    archive.write_snapshot("finma", table(new), stamp="20260802T000000Z")
    archive.write_snapshot("finma", table([*new, *new[:3], {"UID": "5", "Name": "n", "City": "later"}]), stamp="20260803T000000Z")

    def told(a, b):
        return sorted((r["row_key"].split("\x1f")[0], r["kind"], (r["previous"] or {}).get("City"), (r["row"] or {}).get("City")) for r in archive.diff("finma", a, b).collect())

    expected = [(str(i), "removed", "a", None) for i in range(5)] + [(str(i), "added", None, "b" if i % 2 else "a") for i in range(20, 25)]
    expected += [(str(i), "changed", "a", "b") for i in range(5, 20) if i % 2]
    for stamp in ("20260802T000000Z", "20260803T000000Z"):
        assert told("20260801T000000Z", stamp) == sorted(expected)
    assert told("20260802T000000Z", "20260803T000000Z") == []
    plan = archive.diff("finma", "20260801T000000Z", "20260802T000000Z")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
