"""Stored match keys, a watchlist over the archive, identity over registers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rollbook import model
from rollbook.operators import identity, matching
from rollbook.plans import match_store
from rollbook.plans.archive import Archive
from rollbook.plans.ingest import ingest
from rollbook.plans.match_store import MatchKeys
from rollbook.plans.watch import watch

DAYS = {
    1: [("CHE-100.000.001", "Alpha AG", "x"), ("CHE-100.000.002", "Beta GmbH", "x"), ("CHE-100.000.003", "Gämma | Delta SA", "x"), ("CHE-100.000.002", "Beta GmbH", "twin")],
    2: [("CHE-100.000.001", "Alpha AG", "y"), ("CHE-100.000.003", "Gämma | Delta SA", "x"), ("CHE-100.000.004", "Other", "x")],
    3: [("CHE-100.000.003", "Gämma | Delta SA", "z"), ("CHE-100.000.004", "Other", "x"), ("CHE-100.000.005", "beta gmbh", "x")],
}
TED = {2: [{"publication-number": "1", "winner-name": "ALPHA"}], 3: [{"publication-number": "2", "winner-name": "Nobody | Gamma"}]}
WATCHED = [
    ("a", "Alpha", ["100 000 001"], [], [], ""), ("b", "", [], ["Beta"], ["finma"], ""), ("g", "Gamma", [], [], [], ""), ("t", "", [], ["Other"], ["ted"], ""),
    ("u", "", ["CHE100000009"], [], [], ""), ("v", "", [], ["Twice"], [], ""), ("w", "", [], ["Twice AG"], [], ""),
]


def at(day):
    return dt.datetime(2026, 8, day, tzinfo=dt.timezone.utc)


@pytest.fixture
def archive(spark, rows, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"))
    for day, items in DAYS.items():
        table = rows([{"UID": u, "Name": n, "City": c} for u, n, c in items])
        readers = {"finma": lambda table=table: table}
        if day in TED:
            readers["ted"] = lambda day=day: rows(TED[day])
        assert all(o.ok for o in ingest(archive, readers, now=at(day)))
    return archive


@pytest.fixture
def watchlist(spark):
    return spark.createDataFrame(WATCHED, model.WATCHLIST)


def events_of(seen):
    return sorted((r.source, r.stamp[:8], r.change, r.entity_id, r.match, r.match_column, r.match_value) for r in seen.events.collect())


def plain_events(archive, watchlist, since):
    """The same by matching the rows of the events themselves."""
    found = matching.watch_changes(archive.changes().where(F.col("stamp") >= since), watchlist, matching.register_columns(archive.spark))
    columns = ("entity_id", "match", "match_column", "match_value")
    return sorted((r.source, r.stamp[:8], r.change, *(r[c] for c in columns)) for r in found.collect()), found


@pytest.mark.parametrize("hot_rows", [100_000, 0])
def test_watch(archive, watchlist, rows, monkeypatch, hot_rows):
    monkeypatch.setattr(match_store, "HOT_ROWS", hot_rows)
    if not hot_rows:  # every key is a hot one
        for source, stamp in (("finma", "20260803T000000Z"), ("finma", "20260802T000000Z"), ("ted", "20260803T000000Z")):
            MatchKeys(archive).write(source, stamp)
            assert MatchKeys(archive).read(source, stamp).count() == 0
    for since in ("", "20260803"):
        seen = watch(archive, watchlist, since)
        want, found = plain_events(archive, watchlist, since)
        assert events_of(seen) == want and len(want) > 2
        by_key = lambda df: sorted((r.row_key, r.stamp, r.change, tuple(sorted(r.fields.items()))) for r in df.collect())
        assert by_key(seen.events) == by_key(found)
    assert {(r.source, r.entity_id): r.match for r in seen.detail.collect() if r.match} == {
        ("finma", "g"): "name", ("finma", "b"): "name", ("ted", "g"): "name",
    }
    assert {r.source: (r.watched, r.matched) for r in seen.coverage.collect()} == {"finma": (6, 2), "ted": (6, 1)}
    assert [(r.kind, r.key) for r in seen.collisions.collect()] == [("name", "twice")]
    assert {r.source for r in watch(archive, watchlist, sources=["ted"]).events.collect()} == {"ted"}


def test_events_of_retired_snapshots_are_matched_by_their_rows(archive, watchlist):
    want, _ = plain_events(archive, watchlist, "")
    for source, stamp in (("finma", "20260801T000000Z"), ("ted", "20260802T000000Z")):
        archive.retire(archive.catalog().where((F.col("source") == source) & (F.col("stamp") == stamp)))
        MatchKeys(archive).retire(source, stamp)
        assert not MatchKeys(archive).has(source, stamp)
    assert events_of(watch(archive, watchlist)) == want


def test_stored_keys_are_not_exchanged(spark, archive, watchlist):
    """Only the index moves to meet the keys; another session finds the buckets again."""
    store = MatchKeys(archive)
    store._forget("finma", "20260803T000000Z")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = matching.watch_index(watchlist)
        plan = store.read("finma", "20260803T000000Z").join(index, ["kind", "key"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # From the join up to the scan of the keys nothing is exchanged; the index behind it is.
    scan = plan.index("FileScan parquet")
    assert "Bucketed: true" in plan and "SelectedBucketsCount" in plan
    assert "Exchange" not in plan[plan.rindex("SortMergeJoin", 0, scan) : scan] and "Exchange" in plan[scan:]


def test_ingest_stores_shortfalls_and_request_counters(spark, rows, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"))
    pages = lambda: spark.createDataFrame([(1, 9, 4), (2, 9, 2)], "file int, total bigint, records bigint")
    log = [("https://a.org/1", 200, 10, "ok", 1.0, 0.5), ("https://a.org/2", 503, 0, "retry", 2.0, 3.0), ("https://a.org/3", None, None, None, None, None)]
    requests = lambda: spark.createDataFrame(log, "url string, status int, bytes bigint, outcome string, seconds double, waited double")
    fine = lambda: rows([{"UID": "1", "Name": "A"}])

    def broken():
        raise ValueError("no such file")

    out = ingest(archive, {"finma": fine, "gleif": broken, "gisa-codes": lambda: rows([])}, now=at(1), pages={"finma": pages}, requests={"finma": requests})
    assert [(o.source, o.ok) for o in out] == [("finma", True), ("gleif", False), ("gisa-codes", True)]
    assert out[0].warnings == ["fewer records than reported: 6 collected, 9 reported"] == archive.header("finma", out[0].stamp)["warnings"]
    (logged,) = archive.run_log().where("source = 'finma'").collect()
    assert tuple(logged.http) == (3, 1, 1, 10, 3.0, 3.5)
    assert MatchKeys(archive).has("finma", out[0].stamp) and not MatchKeys(archive).has("gisa-codes", out[0].stamp)


def plain_entities(rows, keyed):
    parent = {r: r for r in rows}

    def find(r):
        while parent[r] != r:
            r = parent[r]
        return r

    first = {}
    for source, row, kind, key in keyed:
        if kind == "identifier":
            a, b = find((source, row)), find(first.setdefault(key, (source, row)))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for r in rows:
        groups.setdefault(find(r), []).append(r)
    return {r: (*min(g), len(g)) for g in groups.values() for r in g}


@pytest.mark.parametrize("case", ["random", "hub", "chain", "none"])
def test_identity(spark, case):
    rng = random.Random(case)
    rows = [(s, f"{i:03d}") for s in ("a", "b", "c") for i in range(100)]
    keyed = []
    if case == "random":
        keyed = [(*rng.choice(rows), rng.choice(["identifier", "identifier", "name"]), f"k{rng.randrange(200)}") for _ in range(260)]
    if case == "hub":
        keyed = [(*r, "identifier", "hub") for r in rows if rng.random() < 0.4] + [(*r, "identifier", f"own{r}") for r in rows]
    if case == "chain":
        order = rng.sample(rows, len(rows))
        keyed = [(*r, "identifier", f"link{n + d}") for n, r in enumerate(order) for d in (0, 1)]
    table = spark.createDataFrame(keyed, "source string, row_key string, kind string, key string")
    got = identity.resolve(spark.createDataFrame(rows + rows[:3], "source string, row_key string"), table).collect()
    assert len(got) == len(rows)
    assert {(r.source, r.row_key): (r.entity_source, r.entity_key, r.entity_rows) for r in got} == plain_entities(rows, keyed)


def test_registered_as_is_a_bridge(spark):
    rows = spark.createDataFrame(
        [("gleif", "L1", {"lei": "L1", "entity.registeredAs": "CHE-106.842.854"}), ("finma", "F1", {"UID": "CHE 106 842 854"}), ("gleif", "L2", {"lei": "L2"})],
        "source string, row_key string, fields map<string,string>",
    )
    keys = {(r.source, r.row_key, r.key) for r in identity.bridge_keys(rows).collect()}
    assert keys == {("gleif", "L1", "CHE106842854"), ("gleif", "L1", "106842854")}
