import pytest

from rollbook.operators import filters as ft

ROWS = [
    {"Name": "Zürcher Bank", "City": "Zürich"},
    {"Name": "Straßenbau AG", "City": " Wien ", "lei": ""},
    {"Name": "Zuger Firma", "City": "zürich", "lei": "X=1"},
]


def names(df):
    return [r["fields"]["Name"] for r in df.orderBy("ordinal").collect()]


def test_contains_folds_case_but_not_accents(rows):
    t = rows(ROWS)
    assert names(ft.contains_any(t, ["ZÜRICH"])) == ["Zürcher Bank", "Zuger Firma"]
    assert names(ft.contains_any(t, ["zurich"])) == []
    assert names(ft.contains_any(t, ["STRASSE", ""])) == ["Straßenbau AG"]
    assert names(ft.contains_any(t, ["zürich", "bank"])) == ["Zürcher Bank"]


def test_field_tests(rows):
    t = rows(ROWS)
    assert names(ft.field_equals(t, {"City": "WIEN"})) == ["Straßenbau AG"]
    assert names(ft.field_equals(t, [ft.parse_field_test("lei=")])) == ["Zürcher Bank", "Straßenbau AG"]
    assert names(ft.field_equals(t, [ft.parse_field_test("lei = x=1")])) == ["Zuger Firma"]
    for bad in ("lei", "=x", "  =x"):
        with pytest.raises(ValueError):
            ft.parse_field_test(bad)


def test_limit_keeps_arrival_order(rows):
    t = rows(ROWS)
    assert names(ft.apply_filters(t, limit=2)) == ["Zürcher Bank", "Straßenbau AG"]
    assert len(names(ft.apply_filters(t, limit=0))) == 3


def test_report_tells_the_two_empty_results_apart(rows):
    t = rows(ROWS)
    gone = ft.filter_report(t, fields={"nope": "1", "City": "x"}).first()
    assert gone["missing_fields"] == ["nope"] and gone["reason"] == "a tested field exists in no row"
    none = ft.filter_report(t, contains=["qqq"]).first()
    assert (none["input_rows"], none["output_rows"], none["reason"]) == (3, 0, "every row was filtered out")
    some = ft.filter_report(t, contains=["zürich"]).first()
    assert some["output_rows"] == 2 and some["reason"] is None


def test_served_page_reports_truncation(rows):
    page = ft.served_page(rows(ROWS), 2).collect()
    assert len(page) == 2 and page[0]["truncated"] and page[0]["total_rows"] == 3
    assert not ft.served_page(rows(ROWS), 100, ceiling=100).first()["truncated"]


def test_observed_filter_counts_what_it_scanned(rows):
    kept, seen = ft.observed_filter(rows(ROWS), ft.field_condition({"City": "wien"}), "t")
    assert kept.count() == 1 and seen.get == {"scanned": 3, "kept": 1}
