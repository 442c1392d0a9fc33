import json

import pytest

from rollbook.sources import csv_files, documents, json_pages, landing, payment_institutions, selection, uid_xml


def land(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, body in files.items():
        path = folder / name.replace("__", ".")
        path.write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), encoding="utf-8")
    return str(folder)


def test_document_pages(spark, tmp_path, dicts):
    def page(*docs):
        return {"response": {"docs": list(docs)}}

    firm = {"id": "p1", "_root_": "p1", "type_s": "parent", "entity_type": "ae", "ae_entityTypeCode": "MIF",
            "_version_": 1861996368975888384, "collectorParent": ["x"], "n": "[WITHOUT] y"}
    act = {"id": "c1", "_root_": "p1", "type_s": "child", "entity_type": "aeActivity", "s": ["a", None, {"k": 1}]}
    late = {"id": "c2", "_root_": "p1", "type_s": "child", "entity_type": "aeActivity", "s": True}
    past = {"id": "h", "_root_": "p1", "type_s": "child", "entity_type": "aeActivityHistory", "s": "old"}
    other = {"id": "p2", "_root_": "p2", "type_s": "parent", "entity_type": "ae", "ae_entityTypeCode": "CSP"}
    path = land(tmp_path / "d", **{"00002_b__json": page(late, other), "00001_a__json": page(firm, act, past), "00010_c__json": page()})
    docs = documents.read_solr_pages(spark, path)
    assert [d["id"] for d in dicts(docs)] == ["p1", "c1", "h", "c2", "p2"]
    assert dicts(docs)[0]["n"] == "[WITHOUT] y"
    (row,) = dicts(documents.read_upreg(spark, path, select="mif"))
    assert row["aeActivity_s"] == 'a |  | {"k": 1} | true' and "collectorParent" not in row
    assert "aeActivityHistory_count" not in row and row["aeActivity_count"] == "2"
    assert dicts(documents.read_upreg(spark, path, include_history=True))[0]["aeActivityHistory_s"] == "old"
    assert len(dicts(documents.read_generic_docs(spark, path))) == 2
    assert documents.select_solr(docs, "csp", blocks=False).count() == 1
    flat = land(tmp_path / "f", **{"p1__json": page({"id": 1, "a": None})})
    assert dicts(documents.read_generic_docs(spark, flat)) == [{"id": "1", "a": ""}]


def test_crypto_asset_csv(spark, tmp_path, dicts):
    body = '﻿ae_lei_name,ac_serviceCode,\n"Alder\nBank "," a. custody | zzz",\n,,\nBeta,c. exchange,,x1,,x2\n"Q ""q""\x00",,\n'
    path = land(tmp_path / "m", **{"CASPS__csv": body})
    rows, header = csv_files.read_mica_csv(spark, path)
    assert header == ["ae_lei_name", "ac_serviceCode"]
    assert dicts(rows) == [
        {"ae_lei_name": "Alder\nBank", "ac_serviceCode": "a. custody | zzz", "ac_serviceCode_normalised": "a|?"},
        {"ae_lei_name": "Beta", "ac_serviceCode": "c. exchange", "_extra_columns": "x1 | x2", "ac_serviceCode_normalised": "c"},
        {"ae_lei_name": 'Q "q"', "ac_serviceCode": "", "ac_serviceCode_normalised": ""},
    ]
    plain, _ = csv_files.read_mica_csv(spark, path, derived=False)
    assert "ac_serviceCode_normalised" not in dicts(plain)[0]
    wide, _ = csv_files.read_mica_csv(spark, land(tmp_path / "w", **{"w__csv": "a\n" + ",".join(map(str, range(40))) + "\n"}))
    assert dicts(wide)[0]["_extra_columns"] == " | ".join(map(str, range(1, 40)))
    empty, header = csv_files.read_mica_csv(spark, land(tmp_path / "e", **{"e__csv": "a,b,\n"}))
    assert header == ["a", "b"] and empty.count() == 0
    nothing, header = csv_files.read_mica_csv(spark, land(tmp_path / "n", **{"n__csv": ""}))
    assert header == [] and nothing.count() == 0


def test_authorisation_csv(spark, tmp_path, dicts):
    body = (
        '﻿"Name";"City";"AuthorisationTypeDE";"AuthorisationTypeEN";"UID"\n'
        '"Alder AG";"Bern";"Bank";"Bank";"CHE-100.200.300"\n'
        '"Rep Office";"Basel";"Vertretung";"Representative";""\n'
        '"Alder AG";"Zug";"Fondsleitung";"Fund management company";"CHE-100.200.300"\n'
        '"";"";"X";"Y";""\n'
    )
    path = land(tmp_path / "u", **{"uid__csv": body})
    rows = dicts(csv_files.read_finma_csv(spark, path))
    assert rows[0] == {
        "Name": "Alder AG", "City": "Bern", "UID": "CHE-100.200.300", "uid_digits": "100200300", "authorisation_count": "2",
        "authorisation_AuthorisationTypeDE": "Bank | Fondsleitung",
        "authorisation_AuthorisationTypeEN": "Bank | Fund management company",
    }
    assert [r["Name"] for r in rows] == ["Alder AG", "Rep Office", ""]
    assert [r["authorisation_count"] for r in dicts(csv_files.read_finma_csv(spark, path, "fund"))] == ["1"]
    assert "uid_digits" not in dicts(csv_files.read_finma_csv(spark, path, derived=False))[0]


def test_trade_licence_csv(spark, tmp_path, dicts):
    body = "nuts2,gewerbeart,adress_art,inhaber_pers_art\nAT13,5,1,2\nat13,2,9,\n,,,\nAT11,5,1,1\n"
    path = land(tmp_path / "g", **{"Ogd_stat03_2026__08__csv": body})
    rows, _ = csv_files.read_gisa_csv(spark, path, "NUTS2=at13")
    assert dicts(rows) == [
        {"nuts2": "AT13", "gewerbeart": "5", "adress_art": "1", "inhaber_pers_art": "2", "_vintage": "2026.08",
         "gewerbeart_label": "konzessioniertes Gewerbe", "adress_art_label": "Standort",
         "inhaber_pers_art_label": "juristische Person", "nuts2_label": "Wien"},
        {"nuts2": "at13", "gewerbeart": "2", "adress_art": "9", "inhaber_pers_art": "", "_vintage": "2026.08",
         "gewerbeart_label": "freies Gewerbe", "nuts2_label": "Wien"},
    ]
    counted, seen = csv_files.read_gisa_csv(spark, path, "NUTS2=at13")
    assert counted.count() == 2 and seen.get == {"scanned": 4, "kept": 2}
    assert csv_files.read_gisa_csv(spark, path, select="concession")[0].count() == 2
    with pytest.raises(selection.UnknownSelection, match="no such column"):
        csv_files.read_gisa_csv(spark, path, {"nope": "1"})


def test_licence_wording(rows):
    codes = rows([{"gewerbeschluessel": "1", "gewerbewortlaut": "Tischler", "gewerbeart": "Handwerk"}])
    out = csv_files.label_licences(rows([{"gewerbeschluessel": "1"}, {"gewerbeschluessel": "2"}]), codes)
    assert {r["ordinal"]: r["code_wording"] for r in out.collect()} == {0: "Tischler", 1: None}


ENTITIES = [
    {"CA_OwnerID": "AT_FMA", "EntityCode": "E1", "EntityType": "PSD_EMI", "__EBA_EntityVersion": "20260814223344848",
     "Properties": [{"ENT_NAM": "Alder"}, {}, {"ENT_EXC": ["X1", "X9"]}, {"ENT_COU_RES": "AT"}, {"ENT_NAM": "Alder Pay"}],
     "Services": [{"DE": ["PS_2", "PS_1", "PS_2"]}, {"AT": "PS_3"}, {"DE": "PS_4"}]},
    {"CA_OwnerID": "ZZ", "EntityCode": "E2", "EntityType": "PSD_AG", "Properties": [{"ENT_NAM": "Agent"}]},
]
META = [{"CodeLists": [
    {"CodeListCode": "ENT_TYP_PSD", "Values": [{"CodeValue": "PSD_EMI", "CodeValueDisplay": "E-money"}]},
    {"CodeListCode": "ENUM_ENT_EXC", "Values": [{"CodeValue": "X1", "CodeValueDisplay": "Excl"}]},
], "ServiceDefinition": [{"CodeValue": "PS_1", "CodeValueDisplay": "Cash"}]}]


def test_payment_institutions(spark, tmp_path, dicts, monkeypatch):
    path = land(tmp_path / "e", **{"copy__json": [[{"__EBA_Disclaimer": "x"}], ENTITIES]})
    (row,) = dicts(payment_institutions.read_eba_golden_copy(spark, path))
    assert row == {
        "CA_OwnerID": "AT_FMA", "EntityCode": "E1", "EntityType": "PSD_EMI", "ENT_NAM": "Alder Pay", "ENT_EXC": "X1 | X9",
        "ENT_COU_RES": "AT", "ENT_SER": "PS_1 | PS_2 | PS_3 | PS_4", "ENT_SER_COU": "AT | DE", "ENT_SER_COU_count": "2",
        "ENT_SER_BY_COU": "AT=PS_3 | DE=PS_2,PS_1,PS_4", "__EBA_EntityVersion": "20260814223344848",
    }
    lists = payment_institutions.read_code_lists(spark, land(tmp_path / "meta", **{"metadata__json": META}))
    everything = payment_institutions.read_eba_golden_copy(spark, path, "ALL", code_lists=lists)
    first, agent = dicts(everything)
    assert first["EntityTypeLabel"] == "E-money" and first["CA_OwnerName"] == "" and first["ENT_EXC_label"] == "Excl | X9"
    assert first["ENT_SER_label"] == "Cash | PS_2 | PS_3 | PS_4"
    assert first["__EBA_EntityVersion_iso"] == "2026-08-14T22:33:44Z"
    assert agent["ENT_SER"] == "" and agent["ENT_SER_COU_count"] == "0" and "ENT_EXC_label" not in agent
    lines = land(tmp_path / "l", **{"copy__ndjson": "\n".join(json.dumps(e) for e in ENTITIES)})
    by_line = dicts(payment_institutions.read_eba_golden_copy(spark, lines, "ALL", lines=True))
    assert by_line[0] == row
    joined = payment_institutions.read_eba_golden_copy(spark, path, "ALL", code_lists=lists)
    assert dicts(joined) == [first, agent]


def test_device_actors(spark, tmp_path, dicts):
    actor = {
        "name": "Alder", "telephone": None, "latestVersion": True, "versionNumber": 3, "tags": ["a", "b"], "none": [],
        "names": {"texts": [{"text": "Alder"}, {"text": None}, {"text": "Erle"}]},
        "actorType": {"code": "refdata.actor-type.importer", "srnCode": "IM", "category": None},
        "country": {"isoCode": "DE", "name": "Germany"}, "abbreviatedNames": None,
        "legislationLinks": [{"legislationCode": "MDR", "link": "u"}, {"legislationCode": "IVDR", "link": None}],
        "odd": {"x": [1, {"y": 2}]},
    }
    path = land(tmp_path / "a", **{"p1__json": {"content": [actor, {"name": "B", "actorType": {"code": "refdata.actor-type.manufacturer"}}]}})
    out = dicts(json_pages.read_eudamed_pages(spark, path))
    assert out[0] == {
        "name": "Alder", "telephone": "", "latestVersion": "true", "versionNumber": "3", "tags": "a | b", "none": "",
        "names": "Alder | Erle", "actorType": "refdata.actor-type.importer", "actorType_srnCode": "IM", "country": "DE",
        "country_name": "Germany", "abbreviatedNames": "", "legislationCodes": "MDR | IVDR", "legislationLinks": "u",
        "odd": '{"x": [1, {"y": 2}]}',
    }
    assert [r["name"] for r in dicts(json_pages.read_eudamed_pages(spark, path, "mf"))] == ["B"]


def test_trials(spark, tmp_path, dicts):
    path = land(tmp_path / "t", **{"p1__json": {"data": [{"ctNumber": "1", "a": ["x", None, "", "y"], "n": None, "o": {"b": 1}, "i": 4}]}})
    assert dicts(json_pages.read_ctis_pages(spark, path)) == [{"ctNumber": "1", "a": "x | y", "n": "", "o": '{"b": 1}', "i": "4"}]


def test_legal_entities(spark, tmp_path, dicts):
    record = {"id": "LEI1", "type": "t", "attributes": {"lei": "LEI1", "bic": None, "entity": {
        "legalName": {"name": "Alder", "language": "de"}, "otherNames": [], "legalAddress": {"country": "LI", "addressLines": ["a", None, "b"]},
        "events": [{"z": 1, "a": [2]}], "registeredAs": None}}}
    path = land(tmp_path / "g", **{"p1__json": {"data": [record, {"id": "LEI2", "attributes": {"entity": {"legalAddress": {"country": "FR"}}}}]}})
    out = dicts(json_pages.read_gleif_pages(spark, path))
    assert out[0] == {
        "lei": "LEI1", "entity.legalName.name": "Alder", "entity.legalName.language": "de", "entity.legalAddress.country": "LI",
        "entity.legalAddress.addressLines": "a | b", "entity.events": '[{"a": [2], "z": 1}]',
    }
    assert [r["lei"] for r in dicts(json_pages.read_gleif_pages(spark, path, "dach"))] == ["LEI1"]


def test_notices(spark, tmp_path, dicts):
    notice = {
        "publication-number": "1-2026", "links": {"x": 1}, "buyer-country": ["DEU", "DEU"], "classification-cpv": ["2", "1", "2", ""],
        "winner-name": {"fra": ["F"], "deu": ["Alder ", "Birke", "Alder", ""]}, "notice-title": {"hun": "h", "eng": "", "ita": "i"},
        "buyer-name": {"swe": ["s", "t"]}, "deadline": None,
    }
    path = land(tmp_path / "n", **{"p1__json": {"notices": [notice, {"publication-number": "2", "buyer-country": ["FRA"]}]}})
    out = dicts(json_pages.read_ted_pages(spark, path))
    assert out[0] == {
        "publication-number": "1-2026", "buyer-country": "DEU", "classification-cpv": "2 | 1", "winner_count": "2",
        "winner-name": "Alder | Birke", "notice-title": "i", "buyer-name": "s | t", "deadline": "",
    }
    assert len(dicts(json_pages.read_ted_pages(spark, path, "dach"))) == 1


def test_vat_answers(spark, tmp_path, dicts):
    answer = {"isValid": False, "userError": "INVALID", "vatNumber": "1", "viesApproximate": {"name": None, "matchName": 3}, "l": [1, 2]}
    path = land(tmp_path / "v", **{"00001_vies-DE__json": answer, "00002_vies-AT__json": {"countryCode": "XI", "isValid": True}})
    out = dicts(json_pages.read_vies_answers(spark, path))
    assert out[0] == {
        "countryCode": "DE", "isValid": "false", "userError": "INVALID", "vatNumber": "1", "viesApproximate.name": "",
        "viesApproximate.matchName": "3", "l": "1 | 2",
    }
    assert out[1]["countryCode"] == "XI"
    status = {"vow": {"available": True}, "countries": [{"countryCode": "AT", "availability": "Available"}, {"countryCode": "XX"}]}
    rows = json_pages.vat_status_rows(landing.read_bodies(spark, land(tmp_path / "s", **{"s__json": status})))
    assert dicts(rows)[1] == {"countryCode": "XX", "availability": "", "vow_available": "true"}


def test_vat_lists(spark):
    df = spark.createDataFrame([(1, "vat=DE123456789; ATU12345678,,Acme GmbH"), (2, "")], "id int, cell string")
    out = [(r["id"], r["country"], r["number"], r["parses"]) for r in json_pages.split_vat(df, "cell").orderBy("item_position").collect()]
    assert out == [(1, "DE", "123456789", True), (1, "AT", "U12345678", True), (1, None, None, False)]


def test_enterprise_xml(spark, tmp_path, dicts):
    org = (
        "<organisation xmlns='e'><organisationIdentification><uid><uidOrganisationIdCategorie>CHE</uidOrganisationIdCategorie>"
        "<uidOrganisationId>101329561</uidOrganisationId></uid><OtherOrganisationId><organisationId>A</organisationId></OtherOrganisationId>"
        "<OtherOrganisationId><organisationId>B</organisationId></OtherOrganisationId><legalForm>0151</legalForm>"
        "</organisationIdentification><address><town> Bern </town><street></street></address></organisation>"
        "<vat><status>2</status></vat>"
    )
    search = f"<s:Envelope xmlns:s='x'><s:Body><R xmlns='u'><uidEntitySearchResultItem><organisation>{org}</organisation><rating>90</rating><isHistoryMatch>false</isHistoryMatch></uidEntitySearchResultItem></R></s:Body></s:Envelope>"
    direct = f"<s:Envelope xmlns:s='x'><s:Body><R xmlns='u'><organisationType>{org}</organisationType><organisationType>{org}</organisationType></R></s:Body></s:Envelope>"
    path = land(tmp_path / "x", **{"1_search__xml": search})
    expected = {
        "uid": "CHE-101.329.561", "organisationIdentification.OtherOrganisationId.organisationId": "A | B",
        "organisationIdentification.legalForm": "0151", "address.town": "Bern", "vat.status": "2",
    }
    assert dicts(uid_xml.read_uid_xml(spark, path)) == [{**expected, "rating": "90", "isHistoryMatch": "false"}]
    assert dicts(uid_xml.read_uid_xml(spark, land(tmp_path / "y", **{"2_get__xml": direct}))) == [expected, expected]
    empty = "<s:Envelope xmlns:s='x'><s:Body><R/></s:Body></s:Envelope>"
    path = land(tmp_path / "z", **{"3__xml": empty, "4__xml": "<a><s:Fault><f>bad  input</f></s:Fault></a>"})
    assert uid_xml.read_uid_xml(spark, path).count() == 0
    assert [(r["file"], r["detail"]) for r in uid_xml.faults(spark, path).collect()] == [("4.xml", "bad  input")]


def test_orders_are_dealt_to_all_cores_before_they_become_pages(spark):
    from rollbook.plans.queries.landing import document_pages

    plan = document_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan or "REPARTITION_BY_NUM" in plan


def test_a_text_that_begins_like_a_list_is_a_cell_of_its_own(spark):
    from pyspark.sql import functions as F

    from rollbook.functions.text import variant_cell

    texts = ['"[not a list"', '["a", null, ["b"]]', "[]", "null", '{"b": [1]}', "3"]
    told = spark.createDataFrame([(t,) for t in texts], "t string").select(variant_cell(F.parse_json("t")).alias("c"))
    assert [r.c for r in told.collect()] == ["[not a list", "a |  | b", "", "", '{"b": [1]}', "3"]
