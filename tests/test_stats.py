import random
from collections import Counter

from pyspark.sql import functions as F

from rollbook.operators import stats


def pairs(df):
    return [(r["value"], r["n"]) for r in stats.ordered_counts(df).collect()]


def test_counts_trim_skip_blanks_and_split(rows):
    t = rows([{"c": "a|b"}, {"c": " b "}, {"c": ""}, {}, {"c": "c.|b|"}])
    assert pairs(stats.count_values(t, "c", split="|")) == [("b", 3), ("a", 1), ("c.", 1)]
    assert pairs(stats.count_values(t, "c")) == [("a|b", 1), ("b", 1), ("c.|b|", 1)]
    assert pairs(stats.merge_counts(stats.count_values(t, "c"), stats.count_values(t, "c")))[0] == ("a|b", 2)


def test_facet_lower_cases(rows):
    assert pairs(stats.facet(rows([{"t": "MIF"}, {"t": "mif"}, {}]), "t")) == [("mif", 2)]


def test_enums_in_one_pass(rows):
    out = stats.list_enums(rows([{"a": "x", "b": "p | q"}, {"a": "x"}]), {"a": None, "b": " | "})
    assert {(r["field"], r["value"], r["n"]) for r in out.collect()} == {("a", "x", 2), ("b", "p", 1), ("b", "q", 1)}


def test_declared_enums_of_a_register(rows):
    out = stats.list_register_enums(rows([{"sponsorType": "x", "trialCountries": "DE:1 | AT:2"}, {"trialCountries": "DE:1"}]), "ctis")
    assert {(r["field"], r["value"]): r["n"] for r in out.collect()} == {
        ("sponsorType", "x"): 1, ("trialCountries", "DE:1"): 2, ("trialCountries", "AT:2"): 1,
    }


def test_document_counts_accept_either_spelling(rows):
    docs = rows([{"City": "Bern"}, {"Type": "bank"}, {"Type": "bank"}])
    assert pairs(stats.count_document_values(docs, "City")) == [("Bern", 1)]
    assert pairs(stats.count_document_values(docs, "authorisation_Type")) == [("bank", 2)]


def test_profile(rows):
    t = rows([{"a": "x", "b": ""}, {"a": "  long   " + "y" * 80}, {"a": "x"}, {"a": "z"}, {"a": "w", "c": None}])
    out = {r["field"]: r for r in stats.profile(t).collect()}
    a = out["a"]
    assert (a["present"], a["non_empty"], a["distinct_values"], a["coverage"]) == (5, 5, 4, 100.0)
    assert a["samples"][0] == "x" and a["samples"][2] == "z"
    assert len(a["samples"][1]) == 60 and a["samples"][1].endswith("…") and a["samples"][1].startswith("long y")
    assert (out["b"]["present"], out["b"]["non_empty"], out["b"]["samples"]) == (1, 0, [])
    assert [r["field"] for r in stats.profile(t).collect()] == ["a", "b", "c"]


def test_inspect_profiles_before_and_after(rows):
    docs = [{"id": "p", "type_s": "parent", "_root_": "p"}, {"id": "c", "entity_type": "act", "_root_": "p"}]
    raw, flat = stats.inspect(rows(docs), n=10)
    assert {r["field"] for r in raw.collect()} == {"id", "type_s", "_root_", "entity_type"}
    assert "act_id" in {r["field"] for r in flat.collect()}


def test_fetch_rollup_and_hosts(spark):
    log = spark.createDataFrame(
        [("https://a.org:8/x", 200, 5), ("https://a.org:8/y", 500, 1), ("junk", None, 0)], "url string, status int, bytes long"
    )
    out = {(r["level"], r["host"], r["status"]): r["requests"] for r in stats.fetch_log_rollup(log).collect()}
    assert out[("all", None, None)] == 3 and out[("host", "a.org:8", None)] == 2
    assert out[("status", None, "none")] == 1 and out[("host+status", "?", "none")] == 1


def test_run_log_reports(spark):
    schema = """run_id string, source string, ok boolean, skipped string, rows long, added long, changed long,
        removed long, seconds double, phases map<string,double>"""
    log = spark.createDataFrame(
        [
            ("r1", "a", True, "", 10, 1, 2, 3, 1.26, {"fetch": 1.0, "diff": 0.2}),
            ("r1", "b", False, "", 0, 0, 0, 0, 0.5, {"fetch": 0.5}),
            ("r1", "c", False, "too fresh", 7, 0, 0, 0, 0.0, {}),
            ("r2", "a", True, "", 9, 0, 0, 1, 1.0, {"fetch": 1.0}),
        ],
        schema,
    )
    r = stats.run_report(log).filter("run_id='r1'").first()
    assert (r["sources"], r["ok"], r["failed"], r["skipped"], r["rows"], r["removed"], r["seconds"]) == (3, 1, 1, 1, 17, 3, 1.8)
    assert {(p["run_id"], p["phase"]): p["seconds"] for p in stats.run_phases(log).collect()}[("r1", "fetch")] == 1.5
    assert [x["run_id"] for x in stats.last_runs(stats.run_report(log), 1).collect()] == ["r2"]
    texts = spark.createDataFrame([("a", '{"ok": 1}'), ("b", '{"ok": ')], "run_id string, body string")
    out = {x["run_id"]: x for x in stats.readable_runs(texts, "ok int").collect()}
    assert out["a"]["record"]["ok"] == 1 and out["b"]["unreadable"] and out["b"]["record"] is None


def test_manifests_and_run_records_from_disk(spark, tmp_path):
    from rollbook.sources.landing import read_manifest, read_run_records

    manifest = tmp_path / "manifest.jsonl"
    manifest.write_text('{"seq": 1, "url": "https://a.org/x", "status": 200, "content_length": 7}\n{"seq": 2, "url": "https://a.org/y", "status": 200, "content_length": 3}\n')
    out = {(r["level"], r["host"]): r["bytes_in"] for r in stats.fetch_log_rollup(read_manifest(spark, str(manifest))).collect()}
    assert out[("host", "a.org")] == 10
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "r1.json").write_text('{"ok": 2, "http": {"by_host": {"a.org": 3}, "slowest": [{"seconds": 1.5, "url": "u"}]}}')
    (runs / "r2.json").write_text('{"ok": ')
    read = {r["run_id"]: r for r in read_run_records(spark, str(runs)).collect()}
    assert read["r1"]["record"]["http"]["by_host"] == {"a.org": 3} and read["r2"]["unreadable"]


def test_whole_blocks_are_sampled(rows):
    """Parents first and their children far behind: every sampled block is complete."""
    docs = [{"id": f"p{i}", "type_s": "parent"} for i in range(300)] + [{"_root_": f"p{i % 300}", "entity_type": "act", "v": str(i)} for i in range(900)]
    sample = stats.whole_blocks(rows(docs), n=200).collect()
    found = Counter(r["fields"].get("_root_") or r["fields"]["id"] for r in sample)
    assert set(found.values()) == {4} and 100 < len(sample) < 350
    _, flat = stats.inspect(rows(docs), n=5)
    got = {r["field"]: r["present"] for r in flat.collect()}
    assert got["act_count"] == got["act_v"] == got["id"] == 5
    one = [{"id": "p", "type_s": "parent"}] + [{"_root_": "p", "entity_type": "act"} for _ in range(2000)]
    assert stats.whole_blocks(rows(one), n=10).count() == 2001 and stats.whole_blocks(rows(one[:5]), n=10).count() == 5


def test_facet_sketches_keep_their_error(spark, rows):
    """A long tail and a few frequent values, sketched in parts with little room."""
    rng = random.Random(1)
    values = [f"V{min(int(rng.paretovariate(0.7)), 5000)}" for _ in range(20_000)]
    table = rows([{"f": v, "g": "One"} for v in values])
    exact = {r["value"]: r["n"] for r in stats.facet(table, "f").collect()}
    parts = [stats.facet_sketches(table.where(F.col("ordinal") % 4 == k), ["f", "g"], tracked=256) for k in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = [r for r in stats.approximate_facet(stats.merge_facets(whole, tracked=256), 20, tracked=256).collect()]
    (bound,) = {r["error"] for r in got if r["field"] == "f"}
    assert bound == -(-3.5 * len(values) // 256) and all(abs(r["n"] - exact[r["value"]]) <= bound for r in got if r["field"] == "f")
    assert {v for v, n in exact.items() if n > bound} <= {r["value"] for r in got}
    assert [(r["value"], r["n"], r["error"]) for r in got if r["field"] == "g"] == [("one", 20_000, 0)]
    few = stats.approximate_facet(stats.facet_sketches(table, ["f"]), 10_000)
    assert {r["value"]: r["n"] for r in few.collect()} == exact and {r["error"] for r in few.collect()} == {0}
    assert stats.approximate_facet(stats.facet_sketches(table.limit(0), ["f"])).count() == 0
