"""Match keys, watchlists, coverage and lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rollbook.functions.codes import map_of
from rollbook.model import register
from rollbook.operators import matching as mt
from rollbook.operators import quality
from rollbook.operators import snapshots as sn
from rollbook.plans.queries.base import money, query, rows_of, table
from rollbook.sizing import spread

# Customers are institutions with a printed number and a legal form by segment.
_FORMS = {"BUILDING": " AG", "MACHINERY": " S.A.", "FURNITURE": " G.m.b.H.", "HOUSEHOLD": " Ltd., Inc.", "AUTOMOBILE": ""}
_SQL_NINE = "lpad(CAST(c_custkey AS VARCHAR), 9, '0')"
_SQL_KEY = "lower(replace(c_name, '#', ' '))"


def _nine(column):
    return F.lpad(F.col(column).cast("string"), 9, "0")


def _institutions(spark, folder):
    customer = spread(table(spark, folder, "customer"))
    nine = _nine("c_custkey")
    form = F.create_map(*[F.lit(x) for pair in _FORMS.items() for x in pair])[F.col("c_mktsegment")]
    printed = F.concat(F.lit("CHE-"), F.substring(nine, 1, 3), F.lit("."), F.substring(nine, 4, 3), F.lit("."), F.substring(nine, 7, 3))
    return rows_of(
        customer,
        "c_custkey",
        {"UID": printed, "uid_digits": nine, "Name": F.concat("c_name", form), "balance": money("c_acctbal"), "segment": "c_mktsegment"},
        F.lit("finma").alias("source"),
    )


def _legal_entities(spark, folder):
    supplier = spread(table(spark, folder, "supplier"))
    return rows_of(
        supplier,
        "s_suppkey",
        {"lei": F.concat(F.lit("LEI"), _nine("s_suppkey")), "entity.legalName.name": "s_name"},
        F.lit("gleif").alias("source"),
    )


def _watchlist(spark, folder):
    """Rich customers: some by number, some by name, some named twice, some elsewhere only."""
    rich = table(spark, folder, "customer").filter("c_acctbal > 9000")
    key = F.col("c_custkey").cast("string")
    none = F.array().cast("array<string>")

    def entities(segments, prefix, *, identifiers=none, names=none, sources=none):
        return rich.filter(F.col("c_mktsegment").isin(segments)).select(
            F.concat(F.lit(prefix), key).alias("id"), F.lit("").alias("label"), identifiers.alias("identifiers"),
            names.alias("names"), sources.alias("sources"), F.lit("").alias("note"),
        )

    number = F.array(F.regexp_replace(_nine("c_custkey"), r"(\d{3})(?=\d)", "$1 "))
    parts = [
        entities(["BUILDING"], "b", identifiers=number),
        entities(["MACHINERY", "FURNITURE"], "n", names=F.array(F.upper("c_name"))),
        entities(["FURNITURE"], "d", names=F.array(F.concat("c_name", F.lit(" AG")))),
        entities(["HOUSEHOLD"], "s", identifiers=number, sources=F.array(F.lit("gleif"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_SQL_MATCHES = f"""matches AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' ELSE 'n' END || c_custkey AS entity_id,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'identifier' ELSE 'name' END AS match, c_mktsegment, c_name FROM customer
      WHERE c_acctbal > 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY'))"""


@query(
    f"""SELECT c_custkey AS ordinal, unnest(['identifier', 'identifier', 'identifier', 'name']) AS kind,
      unnest(['UID', 'UID', 'uid_digits', 'Name']) AS col, unnest(['CHE' || {_SQL_NINE}, {_SQL_NINE}, {_SQL_NINE}, {_SQL_KEY}]) AS key
    FROM customer"""
)
def match_keys(spark, folder):
    """Every key of every row: identifier spellings and normalised names."""
    found = mt.match_keys(_institutions(spark, folder), mt.register_columns(spark))
    return found.select("ordinal", "kind", F.col("column").alias("col"), "key")


@query(
    f"""WITH {_SQL_MATCHES} SELECT c_custkey AS ordinal, entity_id, match, CASE match WHEN 'name' THEN 'Name' ELSE 'UID' END AS match_column,
      CASE match WHEN 'name' THEN c_name || ' S.A.' ELSE 'CHE-' || substr({_SQL_NINE}, 1, 3) || '.' || substr({_SQL_NINE}, 4, 3) || '.' ||
        substr({_SQL_NINE}, 7, 3) END AS match_value FROM matches"""
)
def watch_match(spark, folder):
    """The strongest match of every row that is about a watched entity."""
    found = mt.match_rows(_institutions(spark, folder), _watchlist(spark, folder), mt.register_columns(spark))
    return found.select("ordinal", "entity_id", "match", "match_column", "match_value")


@query(
    f"""WITH {_SQL_MATCHES} SELECT entity_id AS _entity_id, entity_id AS _entity_label, match AS _match,
      CASE match WHEN 'name' THEN c_name || ' S.A.' ELSE c_name || ' AG' END AS Name, c_mktsegment AS segment FROM matches"""
)
def watch_scope(spark, folder):
    """Watched rows with who is meant and why."""
    from rollbook.operators.flatten import to_wide

    scoped = mt.scope(_institutions(spark, folder), _watchlist(spark, folder), mt.register_columns(spark))
    return to_wide(scoped, ["_entity_id", "_entity_label", "_match", "Name", "segment"], keep=())


@query(f"SELECT 'name' AS kind, {_SQL_KEY} AS key FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'FURNITURE'")
def collisions(spark, folder):
    """Keys that two watched entities claim."""
    return mt.collisions(_watchlist(spark, folder))


def _detail(spark, folder):
    rows = _institutions(spark, folder).unionByName(_legal_entities(spark, folder))
    return mt.coverage_detail(rows, _watchlist(spark, folder), mt.register_columns(spark), ["finma", "gleif"])


_SQL_DETAIL = """w AS (SELECT c_custkey, c_mktsegment AS seg, unnest(CASE c_mktsegment WHEN 'FURNITURE' THEN ['n', 'd'] WHEN 'BUILDING' THEN ['b']
      WHEN 'MACHINERY' THEN ['n'] WHEN 'HOUSEHOLD' THEN ['s'] ELSE [] END) || c_custkey AS entity_id FROM customer WHERE c_acctbal > 9000),
    d AS (SELECT *, unnest(CASE seg WHEN 'HOUSEHOLD' THEN ['gleif'] ELSE ['finma', 'gleif'] END) AS source FROM w),
    detail AS (SELECT source, entity_id, CASE WHEN source = 'finma' AND seg = 'BUILDING' THEN 'identifier' WHEN source = 'finma' AND seg = 'MACHINERY'
      THEN 'name' WHEN source = 'gleif' AND seg IN ('BUILDING', 'HOUSEHOLD') AND c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'identifier' END AS match FROM d)"""


@query(
    f"""WITH {_SQL_DETAIL} SELECT source, count(*) AS watched, count(match) AS matched, count(*) FILTER (match = 'identifier') AS by_identifier,
      count(*) FILTER (match = 'name') AS by_name FROM detail GROUP BY source"""
)
def coverage(spark, folder):
    """How many watched entities each register shows, and how."""
    return mt.coverage(_detail(spark, folder))


@query(f"WITH {_SQL_DETAIL} SELECT source, entity_id FROM detail WHERE match IS NULL")
def unmatched_entities(spark, folder):
    """Watched entities that a register should show but does not."""
    return mt.unmatched(_detail(spark, folder))


@query(
    f"""WITH {_SQL_MATCHES} SELECT entity_id, CASE match WHEN 'name' THEN 'added' ELSE 'changed' END AS change FROM matches"""
)
def watch_changes(spark, folder):
    """Change events about watched entities.

    In the earlier version of the register one segment is missing and another has other balances.
    """
    new = _institutions(spark, folder)
    f = F.col("fields")
    repriced = F.transform_values(f, lambda k, v: F.when(k == "balance", F.concat(F.lit("0"), v)).otherwise(v))
    old = new.filter(f["segment"] != "MACHINERY").withColumn("fields", F.when(f["segment"] == "BUILDING", repriced).otherwise(f))
    columns = register("finma").key_columns
    events = sn.diff_snapshots(sn.with_keys(old, columns), sn.with_keys(new, columns))
    tagged = events.withColumn("source", F.lit("finma")).withColumn("stamp", F.lit("20260101T000000Z"))
    return mt.watch_changes(tagged, _watchlist(spark, folder), mt.register_columns(spark)).select("entity_id", "change")


@query(
    """SELECT 'identifier' AS how, c_custkey AS ordinal FROM customer WHERE c_custkey = 7
    UNION ALL SELECT 'name', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"""
)
def find_subject(spark, folder):
    """Rows for an identifier, and for a name where no identifier fits."""
    rows, finma = _institutions(spark, folder), register("finma")
    named = F.transform_values("fields", lambda k, v: F.when(k == "Name", F.concat(F.col("fields")["segment"], F.lit(" | x"))).otherwise(v))
    parts = []
    for needle, table_ in (("CHE 000 000 007", rows), ("Building S.A.", rows.withColumn("fields", named))):
        hit, how = mt.find_subject(table_, needle, finma)
        parts.append(hit.select(F.lit(how).alias("how"), "ordinal"))
    return parts[0].unionByName(parts[1])


def _identities(spark, folder):
    rows = _institutions(spark, folder).unionByName(_legal_entities(spark, folder))
    keyed = rows.withColumn("row_key", F.col("ordinal").cast("string"))
    return mt.match_keys(keyed, mt.register_columns(spark), keep=("source", "row_key"))


@query(
    f"""SELECT 'identifier' AS kind, {_SQL_NINE} AS key, CAST(c_custkey AS VARCHAR) AS finma, CAST(s_suppkey AS VARCHAR) AS gleif,
      CAST(2 AS BIGINT) AS finma_rows, CAST(1 AS BIGINT) AS gleif_rows FROM customer JOIN supplier ON c_custkey = s_suppkey"""
)
def xref_identity(spark, folder):
    """Keys that two registers share, one column per register."""
    return mt.entity_xref(_identities(spark, folder), ["finma", "gleif"]).select("kind", "key", "finma", "gleif", "finma_rows", "gleif_rows")


@query(
    f"""WITH k AS (SELECT 'identifier' AS kind, {_SQL_NINE} AS key, c_custkey AS id FROM customer JOIN supplier ON c_custkey = s_suppkey)
    SELECT kind, key, unnest(['finma', 'gleif']) AS source, CAST(id AS VARCHAR) AS row_key FROM k"""
)
def shared_identities(spark, folder):
    """Every row whose key also occurs in another register."""
    return mt.shared_rows(_identities(spark, folder))


@query("SELECT c_custkey, n_name AS code_wording, CAST(n_regionkey AS VARCHAR) AS code_kind FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2")
def licence_wording(spark, folder):
    """Licences with the wording of their code."""
    from rollbook.sources.csv_files import label_licences

    licences = rows_of(table(spark, folder, "customer"), "c_custkey", {"gewerbeschluessel": "c_nationkey"}, "c_custkey")
    nation = table(spark, folder, "nation").filter("n_regionkey <> 2")
    codes = rows_of(nation, "n_nationkey", {"gewerbeschluessel": "n_nationkey", "gewerbewortlaut": "n_name", "gewerbeart": "n_regionkey"})
    return label_licences(licences, codes).select("c_custkey", "code_wording", "code_kind")


@query(
    """WITH r AS (SELECT 'customer' AS source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
      UNION ALL SELECT 'part', p_partkey, p_name || ' 0000' FROM part),
    h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS rank FROM r WHERE contains(name, '0000'))
    SELECT source, id AS ordinal, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 4"""
)
def lookup_rows(spark, folder):
    """The first four rows of every register that mention a term."""
    parts = [
        rows_of(table(spark, folder, name), key, {"name": text}, F.lit(name).alias("source"))
        for name, key, text in (
            ("customer", "c_custkey", F.col("c_name")),
            ("supplier", "s_suppkey", F.col("s_name")),
            ("part", "p_partkey", F.concat("p_name", F.lit(" 0000"))),
        )
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return quality.lookup(rows, "0000").select("source", "ordinal", "rank")


@query(
    """SELECT 'a' || c_custkey AS row_key FROM customer WHERE contains(c_mktsegment, 'MACH') ORDER BY 'a' || c_custkey DESC LIMIT 20"""
)
def lookup_changes(spark, folder):
    """The newest twenty events that mention a term."""
    customer = table(spark, folder, "customer")
    events = customer.select(
        F.lit("finma").alias("source"), F.lit("s").alias("stamp"), F.lit("added").alias("kind"),
        F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("row_key"), F.array().cast("array<string>").alias("columns"),
        map_of({"segment": F.col("c_mktsegment")}).alias("row"), F.lit(None).cast("map<string,string>").alias("previous"),
    )
    return quality.lookup_changes(events, "mach").select("row_key")


@query(
    """SELECT 's' || s_suppkey AS id, s_name AS label, 'N1|LEI' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS identifiers,
      s_name || '|Alias ' || s_suppkey AS names, CASE WHEN s_acctbal > 5000 THEN 'gleif' ELSE '' END AS sources FROM supplier"""
)
def load_watchlist(spark, folder):
    """A watchlist exported as CSV, read, checked and merged."""
    from rollbook.session import shared_folder
    from rollbook.sources.watchlists import load_watchlist as load

    supplier = table(spark, folder, "supplier")
    key = F.col("s_suppkey").cast("string")
    path = shared_folder(spark, "watchlist") + ".csv"
    supplier.select(
        F.concat(F.lit("s"), key).alias("id"), F.col("s_name").alias("label"),
        F.concat(F.lit(" N1 | |LEI"), _nine("s_suppkey")).alias("identifiers"), F.concat(F.lit("Alias "), key).alias("names"),
        F.when(F.col("s_acctbal") > 5000, "gleif").otherwise("").alias("sources"),
    ).write.option("header", True).csv(path)
    listed = load(spark, path)
    return listed.select("id", "label", *[F.array_join(c, "|").alias(c) for c in ("identifiers", "names", "sources")])


def _watched_archive(spark, folder):
    """Institutions in two versions and suppliers in one, ingested; in the earlier version a segment is missing and another has other balances."""
    from rollbook.plans.archive import Archive
    from rollbook.plans.ingest import ingest
    from rollbook.session import shared_folder

    new, f = _institutions(spark, folder).drop("source"), F.col("fields")
    repriced = F.transform_values(f, lambda k, v: F.when(k == "balance", F.concat(F.lit("0"), v)).otherwise(v))
    old = new.filter(f["segment"] != "MACHINERY").withColumn("fields", F.when(f["segment"] == "BUILDING", repriced).otherwise(f))
    suppliers = _legal_entities(spark, folder).drop("source")
    archive = Archive(spark, shared_folder(spark, "watched"))
    for day, readers in ((1, {"finma": lambda: old, "gleif": lambda: suppliers}), (2, {"finma": lambda: new})):
        outcomes = ingest(archive, readers, now=dt.datetime(2026, 1, day, tzinfo=dt.timezone.utc))
        failed = [o.error for o in outcomes if not o.ok]
        if failed:
            raise RuntimeError(failed[0])
    return archive


@query(
    f"""WITH {_SQL_MATCHES}, {_SQL_DETAIL}
    SELECT 'event' AS what, 'finma' AS source, entity_id, CASE match WHEN 'name' THEN 'added' ELSE 'changed' END AS change, match FROM matches
    UNION ALL SELECT 'coverage', source, entity_id, NULL, match FROM detail"""
)
def watch_archive(spark, folder):
    """Events and coverage of a watchlist over an archive, from the match keys stored with its snapshots."""
    from rollbook.plans.watch import watch

    seen = watch(_watched_archive(spark, folder), _watchlist(spark, folder), since="20260102")
    none = F.lit(None).cast("string")
    events = seen.events.select(F.lit("event").alias("what"), "source", "entity_id", "change", "match")
    return events.unionByName(seen.detail.select(F.lit("coverage").alias("what"), "source", "entity_id", none.alias("change"), "match"))


def _bridged(spark, folder):
    """Three registers: licences name the holder's entry in the second, which names the holder's number in the first."""
    letters = lambda c: F.translate(_nine(c), "0123456789", "ABCDEFGHIJ")
    nine = _nine("s_suppkey")
    printed = F.concat(F.lit("CHE-"), F.substring(nine, 1, 3), F.lit("."), F.substring(nine, 4, 3), F.lit("."), F.substring(nine, 7, 3))
    suppliers = table(spark, folder, "supplier")
    entities = rows_of(suppliers, "s_suppkey", {"lei": letters("s_suppkey"), "entity.registeredAs": printed}, F.lit("gleif").alias("source"))
    holder = (F.col("p_partkey") % suppliers.count()).alias("holder")
    parts = table(spark, folder, "part").select("p_partkey", holder)
    licences = rows_of(parts, "p_partkey", {"ae_lei": letters("holder")}, F.lit("mica-casp").alias("source"))
    rows = _institutions(spark, folder).unionByName(entities).unionByName(licences)
    return rows.withColumn("row_key", F.col("ordinal").cast("string"))


@query(
    """WITH n AS (SELECT count(*) AS n FROM supplier), rows AS (
      SELECT 'finma' AS source, c_custkey AS id, c_custkey AS holder FROM customer UNION ALL SELECT 'gleif', s_suppkey, s_suppkey FROM supplier
      UNION ALL SELECT 'mica-casp', p_partkey, p_partkey % n FROM part, n)
    SELECT source, CAST(id AS VARCHAR) AS row_key, min(row(source, CAST(id AS VARCHAR))) OVER (PARTITION BY holder)[1] AS entity_source,
      min(row(source, CAST(id AS VARCHAR))) OVER (PARTITION BY holder)[2] AS entity_key, count(*) OVER (PARTITION BY holder) AS entity_rows FROM rows"""
)
def entity_identities(spark, folder):
    """One identity per entity over three registers, linked by identifiers and by way of others."""
    from rollbook.operators import identity

    rows = _bridged(spark, folder)
    keyed = mt.match_keys(rows, mt.register_columns(spark), keep=("source", "row_key")).select("source", "row_key", "kind", "key")
    return identity.resolve(rows, keyed.unionByName(identity.bridge_keys(rows)))
