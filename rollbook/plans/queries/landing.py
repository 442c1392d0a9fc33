"""Register files as they land, made from the test tables, and read by the readers.

Pages hold a bounded number of records with consecutive keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import codes
from rollbook.operators.flatten import flatten_auto, flatten_blocks, to_wide
from rollbook.plans.queries.base import money, query, rows_of, sql_money, table
from rollbook.session import shared_folder
from rollbook.sizing import spread
from rollbook.sources import csv_files, documents, json_pages, landing, payment_institutions, uid_xml

_PER_PAGE = 200


def _pages(records, key: str, head: str, tail: str):
    """Landed bodies: ``head``, the JSON records of one page, ``tail``."""
    page = F.floor(F.col(key) / _PER_PAGE).cast("bigint")
    grouped = records.groupBy(page.alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "json"))), lambda s: s["json"]), ",").alias("list")
    )
    name = F.format_string("%05d_page.json", F.col("page"))
    return grouped.select(name.alias("file"), "page", F.concat(F.lit(head), "list", F.lit(tail)).alias("body"))


def _json(**members):
    return F.to_json(F.struct(*[v.alias(k.replace("__", "-")) for k, v in members.items()]), {"ignoreNullFields": "false"})


def _null():
    return F.lit(None).cast("string")


def _document_pages(spark, folder):
    orders = spread(table(spark, folder, "orders"))
    root = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    kind = F.when(F.col("o_orderstatus") == "F", "aeActivityHistory").otherwise("aeActivity")
    parent = _json(
        id=root, _root_=root, type_s=F.lit("parent"), entity_type=F.lit("ae"), ae_entityTypeCode=F.col("o_orderpriority"),
        flags=F.array("o_orderstatus", _null(), F.lit("x")), _version_=F.col("o_custkey"), ae_dbId=F.col("o_custkey"),
    )
    child = _json(
        id=F.concat(root, F.lit("c")), _root_=root, type_s=F.lit("child"), entity_type=kind, ac_serviceName=F.concat(F.lit("[W] "), "o_orderstatus")
    )
    records = orders.select("o_orderkey", F.concat_ws(",", parent, child).alias("json"))
    return documents.parse_pages(_pages(records, "o_orderkey", '{"response":{"docs":[', "]}}"))


_DOC_COLUMNS = ["id", "ae_entityTypeCode", "flags", "ae_dbId", "aeActivity_ac_serviceName", "aeActivityHistory_ac_serviceName"]
_SQL_DOCS = """SELECT 'o' || o_orderkey AS id, o_orderpriority AS ae_entityTypeCode, o_orderstatus || ' |  | x' AS flags,
      CAST(o_custkey AS VARCHAR) AS ae_dbId, CASE WHEN o_orderstatus <> 'F' THEN '[W] ' || o_orderstatus END AS aeActivity_ac_serviceName,
      {history} AS aeActivityHistory_ac_serviceName FROM orders"""


@query(_SQL_DOCS.format(history="CASE WHEN o_orderstatus = 'F' THEN '[W] F' END"))
def document_pages(spark, folder):
    """Pages of parent and child documents to one row per entity, past states included."""
    docs = documents.doc_type_filter(_document_pages(spark, folder), include_history=True)
    return to_wide(flatten_blocks(docs), _DOC_COLUMNS, keep=())


@query(_SQL_DOCS.format(history="CAST(NULL AS VARCHAR)") + " WHERE o_orderpriority = '1-URGENT'")
def document_pages_selected(spark, folder):
    """Whole blocks of the parents that match a selection, current states only."""
    docs = documents.doc_type_filter(_document_pages(spark, folder))
    return to_wide(flatten_blocks(documents.select_solr(docs, "1-urgent")), _DOC_COLUMNS, keep=())


@query("SELECT 'o' || o_orderkey AS id, o_orderpriority AS code FROM orders")
def undescribed_pages(spark, folder):
    """Pages of an index nobody described: blocks are detected."""
    rows = flatten_auto(_document_pages(spark, folder))
    f = F.col("fields")
    return rows.select(f["id"].alias("id"), f["ae_entityTypeCode"].alias("code"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS ae_lei, p_name || ', "' || p_brand || '"' AS ae_lei_name, 'a. custody' || chr(10) || 'c. ' || p_type
      AS ac_serviceCode, 'a|c' AS ac_serviceCode_normalised FROM part"""
)
def crypto_asset_csv(spark, folder):
    """A CSV file with quotes, line breaks and a nameless column."""
    part = table(spark, folder, "part")
    path = shared_folder(spark, "casp")
    part.select(
        F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("ae_lei"),
        F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("ae_lei_name"),
        F.concat(F.lit("a. custody\nc. "), "p_type").alias("ac_serviceCode"),
        F.lit("").alias(" "),
    ).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False).csv(path)
    rows, _ = csv_files.read_mica_csv(spark, path)
    return to_wide(rows, ["ae_lei", "ae_lei_name", "ac_serviceCode", "ac_serviceCode_normalised"], keep=())


@query(
    """WITH r AS (SELECT c_custkey AS o, 'Firm ' || c_nationkey AS Name, CASE WHEN c_nationkey > 20 THEN '' ELSE 'CHE-' || c_nationkey END AS UID,
      c_mktsegment AS en FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
    SELECT Name, 'Town' AS City, UID, regexp_replace(UID, '[^0-9]', '', 'g') AS uid_digits, CAST(count(*) AS VARCHAR) AS authorisation_count,
      string_agg(en, ' | ' ORDER BY o) AS authorisation_AuthorisationTypeEN FROM r GROUP BY ALL"""
)
def authorisation_documents(spark, folder):
    """One row per authorisation to one row per institution."""
    customer = table(spark, folder, "customer")
    nation = F.col("c_nationkey").cast("string")
    rows = rows_of(
        customer,
        "c_custkey",
        {
            "Name": F.concat(F.lit("Firm "), nation), "City": F.lit("Town"),
            "UID": F.when(F.col("c_nationkey") > 20, "").otherwise(F.concat(F.lit("CHE-"), nation)),
            "AuthorisationTypeEN": "c_mktsegment", "AuthorisationTypeDE": F.lit("x"),
        },
    )
    docs = csv_files.authorisation_documents(rows, "Building; MACHIN")
    columns = ["Name", "City", "UID", "uid_digits", "authorisation_count", "authorisation_AuthorisationTypeEN"]
    return to_wide(flatten_blocks(docs, csv_files.FINMA_LAYOUT), columns, keep=())


_NUTS = ("AT11", "AT12", "AT13", "AT21", "AT22", "AT31", "AT32", "AT33", "AT34")
_NUTS_NAMES = ("Burgenland", "Niederösterreich", "Wien", "Kärnten", "Steiermark", "Oberösterreich", "Salzburg", "Tirol", "Vorarlberg")
_SQL_TRADES = f"""SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS gewerbeart, {list(_NUTS)}[length(p_brand)] AS nuts2,
      CASE p_size WHEN 1 THEN 'reglementiertes Gewerbe' WHEN 2 THEN 'freies Gewerbe' WHEN 3 THEN 'nicht bewilligungspflichtiges gebundenes Gewerbe'
      WHEN 4 THEN 'Handwerk' WHEN 5 THEN 'konzessioniertes Gewerbe' WHEN 6 THEN 'bewilligungspflichtiges gebundenes Gewerbe' WHEN 7 THEN 'Teilgewerbe'
      WHEN 8 THEN 'Nebengewerbe' WHEN 9 THEN 'gewerbliche Ausübung eines Patentes' END AS gewerbeart_label,
      {list(_NUTS_NAMES)}[length(p_brand)] AS nuts2_label FROM part"""


def _trade_columns():
    return {"gewerbeart": F.col("p_size").cast("string"), "nuts2": F.element_at(F.array(*map(F.lit, _NUTS)), F.length("p_brand"))}


@query(_SQL_TRADES)
def label_trades(spark, folder):
    """Labels for the columns that hold codes, none for other values."""
    rows = rows_of(table(spark, folder, "part"), "p_partkey", _trade_columns())
    labelled = csv_files.label_trades(rows).withColumn("k", F.col("ordinal"))
    return to_wide(labelled, ["gewerbeart", "nuts2", "gewerbeart_label", "nuts2_label"], keep=("k",))


@query(f"SELECT CAST(k AS VARCHAR) AS k, gewerbeart, nuts2, gewerbeart_label, nuts2_label FROM ({_SQL_TRADES}) WHERE gewerbeart = '5' AND nuts2 = 'AT32'")
def trade_licence_csv(spark, folder):
    """Licences filtered while the file is scanned."""
    path = shared_folder(spark, "trades")
    part = table(spark, folder, "part")
    part.select(F.col("p_partkey").alias("k"), *[c.alias(n) for n, c in _trade_columns().items()]).write.option("header", True).csv(path)
    rows, _ = csv_files.read_gisa_csv(spark, path, "NUTS2=at32", "konzessioniert")
    return to_wide(rows, ["k", "gewerbeart", "nuts2", "gewerbeart_label", "nuts2_label"], keep=())


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y.%m') AS vintage FROM orders")
def vintages(spark, folder):
    """The month stated in a file name."""
    orders = table(spark, folder, "orders")
    name = F.concat(F.lit("Ogd_stat03_"), F.date_format("o_orderdate", "yyyy.MM"), F.lit(".csv.7z"))
    return orders.select("o_orderkey", codes.vintage(name).alias("vintage"))


_SQL_KINDS = "CASE WHEN s_acctbal < 2500 THEN 'PSD_AG' WHEN s_acctbal < 5000 THEN 'PSD_PI' ELSE 'PSD_EMI' END"


def _entity_lines(spark, folder):
    """Suppliers as entity documents; where and what they ship is their footprint."""
    shipped = table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()
    blocks = shipped.groupBy("l_suppkey").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.concat(F.lit('{"'), "l_returnflag", F.lit('": ["'), "l_linestatus", F.lit('", "X"]}')))), ","
        ).alias("services")
    )
    supplier = table(spark, folder, "supplier").join(blocks, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    balance = F.col("s_acctbal")
    kind = F.when(balance < 2500, "PSD_AG").when(balance < 5000, "PSD_PI").otherwise("PSD_EMI")
    body = F.concat(
        F.lit('{"CA_OwnerID": "N'), F.col("s_nationkey").cast("string"), F.lit('", "EntityCode": "E'), F.col("s_suppkey").cast("string"),
        F.lit('", "EntityType": "'), kind, F.lit('", "Properties": [{"ENT_NAM": "old"}, {}, {"ENT_NAM": "'), "s_name",
        F.lit('"}, {"ENT_COU_RES": ["AT", "DE"]}], "Services": ['), F.coalesce("services", F.lit("")),
        F.lit('], "__EBA_EntityVersion": "20260814223344848"}'),
    )
    return payment_institutions.entity_lines(supplier.select(F.col("s_suppkey").alias("ordinal"), body.alias("body")))


_SQL_FOOTPRINT = """used AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS c, l_linestatus AS s FROM lineitem),
    foot AS (SELECT k, string_agg(DISTINCT c, ' | ' ORDER BY c) AS cou, string_agg(DISTINCT s, ' | ' ORDER BY s) || ' | X' AS ser FROM used GROUP BY k)"""


@query(
    f"""WITH {_SQL_FOOTPRINT} SELECT 'E' || s_suppkey AS EntityCode, {_SQL_KINDS} AS EntityType, s_name AS ENT_NAM, 'AT | DE' AS ENT_COU_RES,
      coalesce(ser, '') AS ENT_SER, coalesce(cou, '') AS ENT_SER_COU FROM supplier LEFT JOIN foot ON k = s_suppkey WHERE s_acctbal >= 2500"""
)
def payment_institutions_read(spark, folder):
    """Entity documents to rows; dependents are left out unless asked for."""
    rows = payment_institutions.institution_rows(_entity_lines(spark, folder))
    return to_wide(rows, ["EntityCode", "EntityType", "ENT_NAM", "ENT_COU_RES", "ENT_SER", "ENT_SER_COU"], keep=())


@query(
    f"""WITH {_SQL_FOOTPRINT} SELECT 'E' || s_suppkey AS EntityCode, CASE {_SQL_KINDS} WHEN 'PSD_PI' THEN 'Institution' ELSE '' END AS EntityTypeLabel,
      n_name AS CA_OwnerName, CASE WHEN ser IS NULL THEN '' ELSE replace(ser, 'X', 'Extra') END AS ENT_SER_label,
      '2026-08-14T22:33:44Z' AS version FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN foot ON k = s_suppkey"""
)
def label_codes(spark, folder):
    """Labels from code lists; an unknown service keeps its code."""
    nation = table(spark, folder, "nation")
    lists = nation.select(F.lit("RDL_COM_AUT_PSD").alias("code_list"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("label"))
    fixed = spark.createDataFrame(
        [("ENT_TYP_PSD", "PSD_PI", "Institution"), ("ServiceDefinition", "X", "Extra")], "code_list string, code string, label string"
    )
    rows = payment_institutions.institution_rows(_entity_lines(spark, folder), "ALL")
    labelled = payment_institutions.label_institutions(rows, lists.unionByName(fixed))
    columns = ["EntityCode", "EntityTypeLabel", "CA_OwnerName", "ENT_SER_label", "__EBA_EntityVersion_iso"]
    return to_wide(labelled, columns, keep=()).withColumnRenamed("__EBA_EntityVersion_iso", "version")


@query(
    """SELECT c_name AS name, '' AS telephone, c_name || ' | ' || c_mktsegment AS names, 'refdata.actor-type.importer' AS actorType, 'IM' AS actorType_srnCode,
      CAST(c_nationkey AS VARCHAR) AS country, c_mktsegment AS country_name, 'MDR | IVDR' AS legislationCodes, 'u' AS legislationLinks,
      '{"x": [' || c_custkey || ', {"y": 2}]}' AS odd FROM customer WHERE c_acctbal > 0"""
)
def device_actors(spark, folder):
    """Actor records with reference data, texts and unknown shapes, of one actor type."""
    customer = table(spark, folder, "customer")
    kind = F.when(F.col("c_acctbal") > 0, "importer").otherwise("manufacturer")
    text = lambda c: F.struct(c.alias("text"))
    record = _json(
        name=F.col("c_name"), telephone=_null(), names=F.struct(F.array(text(F.col("c_name")), text(_null()), text(F.col("c_mktsegment"))).alias("texts")),
        actorType=F.struct(F.concat(F.lit("refdata.actor-type."), kind).alias("code"), F.lit("IM").alias("srnCode"), _null().alias("category")),
        country=F.struct(F.col("c_nationkey").cast("string").alias("isoCode"), F.col("c_mktsegment").alias("name")),
        legislationLinks=F.array(
            F.struct(F.lit("MDR").alias("legislationCode"), F.lit("u").alias("link")), F.struct(F.lit("IVDR").alias("legislationCode"), _null().alias("link"))
        ),
    )
    odd = F.concat(F.regexp_replace(record, r"\}$", ""), F.lit(',"odd":{"x":['), F.col("c_custkey").cast("string"), F.lit(',{"y":2}]}}'))
    pages = _pages(customer.select("c_custkey", odd.alias("json")), "c_custkey", '{"content":[', '],"last":true}')
    rows = json_pages.actor_rows(landing.page_documents(pages, "content"), "im")
    columns = ["name", "telephone", "names", "actorType", "actorType_srnCode", "country", "country_name", "legislationCodes", "legislationLinks", "odd"]
    return to_wide(rows, columns, keep=())


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS ctNumber, o_orderstatus || ' | ' || o_orderpriority AS areas, '' AS endDate,
      '{"n": ' || o_custkey || '}' AS nested FROM orders"""
)
def clinical_trials(spark, folder):
    """Trial records; blanks inside lists are skipped."""
    orders = table(spark, folder, "orders")
    record = _json(
        ctNumber=F.col("o_orderkey").cast("string"), areas=F.array("o_orderstatus", F.lit(""), _null(), "o_orderpriority"),
        endDate=_null(), nested=F.struct(F.col("o_custkey").alias("n")),
    )
    pages = _pages(orders.select("o_orderkey", record.alias("json")), "o_orderkey", '{"pagination":{},"data":[', "]}")
    return to_wide(json_pages.trial_rows(landing.page_documents(pages, "data")), ["ctNumber", "areas", "endDate", "nested"], keep=())


@query(
    f"""SELECT 'L' || c_custkey AS lei, c_name AS name, ['DE', 'FR', 'CH', 'LI', 'AT'][c_nationkey // 5 + 1] AS country,
      c_mktsegment || ' | ' || {sql_money('c_acctbal')} AS lines FROM customer WHERE c_nationkey // 5 <> 1"""
)
def legal_entities(spark, folder):
    """Nested records to dotted paths, of the countries asked for."""
    customer = table(spark, folder, "customer")
    country = F.element_at(F.array(*map(F.lit, ("DE", "FR", "CH", "LI", "AT"))), (F.floor(F.col("c_nationkey") / 5) + 1).cast("int"))
    entity = F.struct(
        F.struct(F.col("c_name").alias("name")).alias("legalName"), F.array().cast("array<string>").alias("otherNames"),
        F.struct(country.alias("country"), F.array("c_mktsegment", _null(), money("c_acctbal")).alias("lines")).alias("legalAddress"),
        _null().alias("registeredAs"),
    )
    record = _json(id=F.concat(F.lit("L"), F.col("c_custkey").cast("string")), attributes=F.struct(entity.alias("entity")))
    pages = _pages(customer.select("c_custkey", record.alias("json")), "c_custkey", '{"meta":{},"data":[', "]}")
    rows = json_pages.legal_entity_rows(landing.page_documents(pages, "data"), "dach")
    f = F.col("fields")
    return rows.select(
        f["lei"].alias("lei"), f["entity.legalName.name"].alias("name"), f["entity.legalAddress.country"].alias("country"),
        f["entity.legalAddress.lines"].alias("lines"),
    )


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS number, text AS title, source || ' | B' AS winners, CAST(2 AS VARCHAR) AS winner_count, upper(lang) || 'X' AS countries
    FROM documents WHERE lang IN ('de', 'fr')"""
)
def procurement_notices(spark, folder):
    """Notices in one language each, winners without repeats, of two countries."""
    documents_ = table(spark, folder, "documents")
    texts = F.map_from_arrays(F.array(F.lit("hun"), F.when(F.col("lang") == "en", "eng").otherwise("spa")), F.array(F.lit(""), F.col("text")))
    country = F.concat(F.upper("lang"), F.lit("X"))
    record = _json(
        publication__number=F.col("doc_id").cast("string"), notice__title=texts,
        winner__name=F.create_map(F.lit("deu"), F.array(F.concat("source", F.lit(" ")), F.lit("B"), F.col("source"), F.lit(""))),
        buyer__country=F.array(country, country), links=F.struct(F.lit(1).alias("x")),
    )
    pages = _pages(documents_.select("doc_id", record.alias("json")), "doc_id", '{"notices":[', "]}")
    rows = json_pages.notice_rows(landing.page_documents(pages, "notices"), "dex; frx")
    f = F.col("fields")
    return rows.select(
        f["publication-number"].alias("number"), f["notice-title"].alias("title"), f["winner-name"].alias("winners"),
        f["winner_count"].alias("winner_count"), f["buyer-country"].alias("countries"),
    )


@query(
    """SELECT 'CHE-' || substr(n, 1, 3) || '.' || substr(n, 4, 3) || '.' || substr(n, 7, 3) AS uid, s_name || ' | x' AS ids, '0151' AS form,
      CAST(s_nationkey AS VARCHAR) AS rating FROM (SELECT *, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS n FROM supplier)"""
)
def enterprise_replies(spark, folder):
    """XML replies to dotted columns; repeated elements are joined."""
    supplier = table(spark, folder, "supplier")
    nine = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    item = F.concat(
        F.lit("<uidEntitySearchResultItem><organisation><organisation><organisationIdentification><uid><uidOrganisationIdCategorie>CHE"
              "</uidOrganisationIdCategorie><uidOrganisationId>"), nine,
        F.lit("</uidOrganisationId></uid><OtherOrganisationId><organisationId>"), "s_name",
        F.lit("</organisationId></OtherOrganisationId><OtherOrganisationId><organisationId>x</organisationId></OtherOrganisationId>"
              "<legalForm>0151</legalForm></organisationIdentification></organisation></organisation><rating>"),
        F.col("s_nationkey").cast("string"), F.lit("</rating></uidEntitySearchResultItem>"),
    )
    path = shared_folder(spark, "replies")
    page = F.floor(F.col("s_suppkey") / _PER_PAGE)
    replies = supplier.groupBy(page.alias("page")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    reply = F.concat(F.lit("<Envelope><Body>"), "items", F.lit("</Body></Envelope>"))
    replies.select("page", reply.alias("value")).write.partitionBy("page").text(path)
    f = F.col("fields")
    return uid_xml.read_uid_xml(spark, path).select(
        f["uid"].alias("uid"), f["organisationIdentification.OtherOrganisationId.organisationId"].alias("ids"),
        f["organisationIdentification.legalForm"].alias("form"), f["rating"].alias("rating"),
    )


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS number, CASE WHEN s_acctbal < 0 THEN 'XI' ELSE 'DE' END AS country, s_name AS match_name,
      CASE WHEN s_nationkey = 3 THEN 'unknown' WHEN s_acctbal > 5000 THEN 'valid' ELSE 'invalid' END AS verdict FROM supplier"""
)
def vat_answers(spark, folder):
    """VAT answers to rows; an answer that could not be given is not a negative one."""
    supplier = table(spark, folder, "supplier")
    named = F.when(F.col("s_acctbal") < 0, F.lit('"countryCode": "XI", ')).otherwise("")
    body = F.concat(
        F.lit("{"), named, F.lit('"isValid": '), (F.col("s_acctbal") > 5000).cast("string"), F.lit(', "vatNumber": "'),
        F.col("s_suppkey").cast("string"), F.lit('", "userError": "'), F.when(F.col("s_nationkey") == 3, "ms_unavailable").otherwise("VALID"),
        F.lit('", "viesApproximate": {"name": "'), "s_name", F.lit('", "matchName": 3}}'),
    )
    bodies = supplier.select(F.lit("x").alias("file"), F.col("s_suppkey").alias("page"), body.alias("body"), F.lit("DE").alias("country"))
    f = F.col("fields")
    return json_pages.vat_rows(bodies).select(
        f["vatNumber"].alias("number"), f["countryCode"].alias("country"), f["viesApproximate.name"].alias("match_name"),
        codes.vat_verdict(f["isValid"], f["userError"]).alias("verdict"),
    )


@query("SELECT n_name AS country, CASE n_regionkey WHEN 0 THEN '' ELSE 'Available' END AS availability, CASE WHEN n_regionkey > 2 THEN 'true' ELSE 'false' END AS vow FROM nation")
def vat_status(spark, folder):
    """Which member state systems answer."""
    nation = table(spark, folder, "nation")
    body = F.concat(
        F.lit('{"vow": {"available": '), (F.col("n_regionkey") > 2).cast("string"), F.lit('}, "countries": [{"countryCode": "'), "n_name",
        F.when(F.col("n_regionkey") == 0, '"}]}').otherwise('", "availability": "Available"}]}'),
    )
    bodies = nation.select(F.lit("x").alias("file"), F.col("n_nationkey").cast("bigint").alias("page"), body.alias("body"))
    f = F.col("fields")
    return json_pages.vat_status_rows(bodies).select(f["countryCode"].alias("country"), f["availability"].alias("availability"), f["vow_available"].alias("vow"))


@query(
    """SELECT c_custkey, unnest([0, 1, 2]) AS item_position, unnest(['AT', 'DE', NULL]) AS country,
      unnest(['U' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), '1' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), NULL]) AS number,
      unnest([true, true, false]) AS parses FROM customer"""
)
def split_vat(spark, folder):
    """VAT numbers as people write them; what is none is flagged."""
    customer = table(spark, folder, "customer")
    eight = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    cell = F.concat(F.lit(" atU-"), eight, F.lit(";vat = DE 1"), F.regexp_replace(eight, "(..)(?=.)", "$1."), F.lit(", Firm GmbH,"))
    split = json_pages.split_vat(customer.select("c_custkey", cell.alias("cell")), "cell")
    return split.select("c_custkey", "item_position", "country", "number", "parses")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'withdrawn' WHEN o_orderpriority = '5-LOW' THEN 'lapsed'
      WHEN o_orderpriority = '1-URGENT' THEN 'not valid' WHEN o_totalprice > 300000 THEN 'licensed' ELSE 'in register' END AS verdict FROM orders"""
)
def status_verdicts(spark, folder):
    """What each register's own status column says."""
    orders = table(spark, folder, "orders")
    fields = codes.map_of(
        {
            "ae_status": F.when(F.col("o_orderstatus") == "F", "Inactive").otherwise("Active"),
            "registration.status": F.when(F.col("o_orderpriority") == "5-LOW", "LAPSED").otherwise("ISSUED"),
            "isValid": F.when(F.col("o_orderpriority") == "1-URGENT", "false").otherwise("true"),
        }
    )
    source = F.when(F.col("o_totalprice") > 300000, "finma").otherwise("ctis")
    return orders.select("o_orderkey", codes.status_verdict(fields, source).alias("verdict"))


@query("SELECT doc_id, replace(text, ' ', '') AS text FROM documents")
def strip_nul(spark, folder):
    """NUL characters removed from landed text."""
    documents_ = table(spark, folder, "documents")
    return documents_.select("doc_id", landing.strip_nul(F.translate("text", " ", "\x00")).alias("text"))
