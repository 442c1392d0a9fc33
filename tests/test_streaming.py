import os
import shutil

import pytest
from pyspark.sql import functions as F

from rollbook.plans.archive import Archive
from rollbook.streaming import changes
from rollbook.streaming.changes import follow_catalog, follow_rows, read_row_changes, read_row_state
from rollbook.streaming.state import STATE, KeyedState, Run

OLD = [{"UID": "1", "Name": "Alpha"}, {"UID": "2", "Name": "Beta"}]
NEW = [{"UID": "1", "Name": "Alpha2", "timestamp": "x"}, {"UID": "3", "Name": "Gamma"}, {"UID": "3", "Name": "Late"}]


def test_events_follow_the_catalogue(spark, rows, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"))
    archive.write_snapshot("eba-psd", rows(OLD), stamp="20260801T000000Z", key_columns=["UID"])
    archive.write_snapshot("eba-psd", rows(NEW), stamp="20260802T000000Z", key_columns=["UID"])
    for _ in range(2):
        follow_catalog(archive, str(tmp_path / "ckpt")).awaitTermination(120)
    assert sorted((r["kind"], r["row_key"]) for r in archive.changes().collect()) == [
        ("added", "3"), ("changed", "1"), ("removed", "2"),
    ]
    assert archive.change_runs().count() == 2


def test_rows_are_compared_with_the_last_state(spark, rows, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))

    def land(stamp, items):
        table = rows(items, source="x", stamp=stamp).withColumn("row_key", F.col("fields")["UID"])
        table.coalesce(1).write.mode("append").parquet(source)

    def follow():
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        follow_rows(stream, out, marks).awaitTermination(120)
        return sorted((r["stamp"], r["kind"], r["row_key"], r["columns"]) for r in read_row_changes(spark, out).collect())

    for stamp, items in (("s1", OLD), ("s2", NEW), ("s3", NEW)):
        land(stamp, items)
    first = [("s1", "added", "1", []), ("s1", "added", "2", []), ("s2", "added", "3", []), ("s2", "changed", "1", ["Name"])]
    assert follow() == first
    land("s0", [{"UID": "1", "Name": "too late"}])
    land("s4", [{"UID": "2", "Name": "Beta2"}, {"UID": "1", "Name": "Alpha2"}])
    assert follow() == first + [("s4", "changed", "2", ["Name"])]
    assert {(r["row_key"], r["stamp"]) for r in read_row_state(spark, out).collect()} == {("1", "s4"), ("2", "s4"), ("3", "s3")}
    fresh = changes._fresh(spark.read.parquet(source).limit(0), spark.createDataFrame([], STATE))
    assert changes._events(fresh).count() == changes._after(fresh).count() == 0


@pytest.mark.parametrize("source, kinds", [("ted", {"changed"}), ("eba-psd", {"changed", "removed"})])
def test_rows_that_leave_a_window_are_not_removed(spark, rows, tmp_path, source, kinds):
    archive = Archive(spark, str(tmp_path / "a"))
    archive.write_snapshot(source, rows(OLD), stamp="20260801T000000Z", key_columns=["UID"])
    archive.write_snapshot(source, rows(NEW[:1]), stamp="20260802T000000Z", key_columns=["UID"])
    follow_catalog(archive, str(tmp_path / "ckpt")).awaitTermination(120)
    assert {r["kind"] for r in archive.changes().collect()} == kinds
    assert archive.change_runs().agg(F.sum("removed")).first()[0] == len(kinds) - 1


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_state_is_a_log_of_runs(spark, tmp_path):
    """Fifty small batches over a large state: what a batch writes and what stays on disk are bounded."""
    path = str(tmp_path / "state")
    state = KeyedState(spark, path)

    def batch(keys, stamp):
        kept = F.map_from_arrays(F.array(F.lit("v")), F.array(F.sha2(F.concat(F.lit(stamp), F.col("id").cast("string")), 512)))
        return spark.range(keys).select(F.lit("x").alias("source"), F.col("id").cast("string").alias("row_key"), F.lit(stamp).alias("stamp"), kept.alias("fields"))

    state.write(batch(20_000, "s000"), 0)
    whole, written, on_disk = _size(path), [], []
    for number in range(1, 51):
        state.merge(number)
        rows = batch(10, f"s{number:03d}")
        assert state.read_for(rows, number).count() == 10
        state.write(rows, number)
        written.append(_size(f"{path}/run-0-{number}-{number}"))
        on_disk.append(_size(path))
    assert max(written) < whole / 10 and max(on_disk) < 1.5 * whole
    assert len(state.runs()) < 4 * 4
    got = {(r["row_key"], r["stamp"]) for r in state.read().collect()}
    assert got == {(str(i), "s050" if i < 10 else "s000") for i in range(20_000)}


def test_a_batch_may_be_repeated_and_a_merge_broken_off(spark, tmp_path):
    path = str(tmp_path / "state")
    state = KeyedState(spark, path)

    def rows(*items):
        return spark.createDataFrame([("x", k, s, {"v": v}) for k, s, v in items], STATE)

    def seen(before=None):
        return sorted((r["row_key"], r["stamp"], r["fields"]["v"]) for r in state.read(before).collect())

    for n in range(5):
        state.write(rows(("a", f"s{n}", str(n)), (f"k{n}", f"s{n}", "")), n)
    four = seen(4)
    shutil.copytree(path, str(tmp_path / "copy"))
    state.merge(4)
    assert seen(4) == four and state.runs(4) == [Run(1, 0, 3)] and state.runs()[-1] == Run(0, 4, 4)
    # The runs that were merged are there again, as if removing them had failed, and a half-written one beside them.
    for name in os.listdir(tmp_path / "copy"):
        shutil.copytree(str(tmp_path / "copy" / name), f"{path}/{name}", dirs_exist_ok=True)
    os.makedirs(f"{path}/run-2-0-3/bucket=1")
    assert seen(4) == four and seen() == sorted([*((k, s, v) for k, s, v in four if k != "a"), ("a", "s4", "4"), ("k4", "s4", "")])
    state.merge(4)
    state.write(rows(("a", "s4", "4"), ("k4", "s4", "")), 4)
    assert sorted(os.listdir(path)) == ["run-0-4-4", "run-1-0-3"] and seen(4) == four
    assert state.read_for(rows(("k1", "", "")), 5).collect()[0]["stamp"] == "s1"
    assert KeyedState(spark, str(tmp_path / "none")).read().count() == 0


def test_a_year_of_lines_lands_in_as_many_files_as_tasks_write_it(spark, monkeypatch, tmp_path):
    from rollbook import session
    from rollbook.plans.queries.streams import stream_row_changes

    monkeypatch.setattr(session, "shared_folder", lambda *_: str(tmp_path / "stream"))
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    monkeypatch.setattr("rollbook.plans.queries.streams.table", lambda *_: lines.repartition(8))
    assert not stream_row_changes(spark, "").isEmpty()
    years = lines.select(F.year("l_shipdate")).distinct().count()
    assert len([n for n in os.listdir(tmp_path / "stream" / "landed") if n.endswith(".parquet")]) == 8 * years
    # A batch has a whole year.
    assert len([n for n in os.listdir(tmp_path / "stream" / "out" / "events") if n.startswith("batch=")]) == years
