"""Table schemas and the catalogue of known registers."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

FIELDS = "map<string,string>"
ROWS = f"ordinal bigint, fields {FIELDS}"
SNAPSHOT_ROWS = f"row_key string, ordinal bigint, diff_hash string, row_hash string, names string, fields {FIELDS}"
SNAPSHOTS = f"{SNAPSHOT_ROWS}, source string, stamp string"
CHANGES = (
    f"against string, kind string, row_key string, columns array<string>, row {FIELDS}, previous {FIELDS}, "
    "source string, stamp string"
)
SNAPSHOT_CATALOG = (
    "source string, stamp string, captured_at string, row_count bigint, duplicate_keys bigint, body_digest string, "
    "key_columns array<string>, select string, query string, columns array<string>, warnings array<string>, "
    "run_id string, title string, jurisdiction string, docs_url string, cadence_hours double, data_licence string"
)
RETIRED = "source string, stamp string, retired_at string"
CHANGE_RUNS = (
    "source string, stamp string, against string, added bigint, changed bigint, removed bigint, written_at string"
)
HTTP = (
    "struct<requests:bigint,retries:bigint,failures:bigint,bytes_in:bigint,"
    "seconds_requesting:double,seconds_waiting:double>"
)
RUN_LOG = (
    "run_id string, source string, ok boolean, skipped string, stamp string, rows bigint, added bigint, "
    "changed bigint, removed bigint, unchanged boolean, warnings array<string>, error string, seconds double, "
    f"phases map<string,double>, http {HTTP}"
)
WATCHLIST = (
    "id string, label string, identifiers array<string>, names array<string>, sources array<string>, note string"
)


@dataclass(frozen=True)
class Register:
    """What one register declares about its rows."""

    key: str
    title: str
    jurisdiction: str = "EU"
    docs_url: str = ""
    key_columns: tuple[str, ...] = ()
    identifier_columns: tuple[str, ...] = ()
    name_columns: tuple[str, ...] = ()
    expected_fields: tuple[str, ...] = ()
    enum_fields: tuple[str, ...] = ()
    multi_value_fields: dict[str, str] = field(default_factory=dict)
    cadence_hours: float | None = 24.0
    block_structured: bool = False
    bulk_readable: bool = True
    disclaimer: str = ""
    data_licence: str = ""
    personal_data: str = ""
    #: False where old rows age out of the window served, so that a missing row
    #: is not a removal.
    population: bool = True

    @property
    def entity_shaped(self) -> bool:
        return bool(self.identifier_columns or self.name_columns)


# Statements of publishers, in their words.
ESMA_STATEMENT = (
    "The crypto-asset white papers listed in ESMA's register have not been reviewed or approved by any competent authority in any "
    "Member State of the European Union. The offeror and/or issuer of the crypto-asset is solely responsible for the content of each "
    "crypto-asset white paper."
)
EBA_STATEMENT = (
    "Unlike national registers under PSD2, this Register has no legal significance and confers no rights in law. […] responsibility for "
    "the accuracy of that information lies with the competent authorities at national level."
)
CC_BY, CC0 = "CC BY 4.0 — https://creativecommons.org/licenses/by/4.0/", "CC0 1.0 — https://www.gleif.org/en/meta/lei-data-terms-of-use"


def _mica(key: str, title: str, *enums: str, keys: tuple[str, ...] = (), multi: tuple[str, ...] = ()) -> Register:
    return Register(
        key,
        title,
        docs_url="https://www.esma.europa.eu/",
        key_columns=keys,
        identifier_columns=("ae_lei",),
        name_columns=("ae_lei_name", "ae_commercial_name"),
        expected_fields=("ae_lei_name", "ae_homeMemberState"),
        enum_fields=("ae_competentAuthority", "ae_homeMemberState", *enums),
        multi_value_fields={name: "|" for name in multi},
        disclaimer=ESMA_STATEMENT,
        cadence_hours=168.0,
    )


def _flat_index(key: str, title: str) -> Register:
    return Register(
        key, title, docs_url="https://registers.esma.europa.eu/", key_columns=("id",), identifier_columns=("id",),
        cadence_hours=None,
    )


# Register keys, column names, cadences and publisher statements.
REGISTERS: tuple[Register, ...] = (
    Register(
        "upreg",
        "Authorised entities of the EU securities markets",
        docs_url="https://registers.esma.europa.eu/",
        key_columns=("id",),
        identifier_columns=("ae_lei", "id"),
        name_columns=("ae_entityName", "ae_commercialName"),
        expected_fields=("ae_entityName", "ae_entityTypeCode", "ae_status", "_root_"),
        enum_fields=(
            "ae_entityTypeCode", "ae_entityTypeLabel", "ae_status", "ae_officeType", "ae_competentAuthority",
            "ae_homeMemberState", "ac_serviceName", "ac_status",
        ),
        cadence_hours=None,
        block_structured=True,
    ),
    _flat_index("bench-entities", "Benchmark administrators"),
    _flat_index("funds", "Alternative, social and venture funds"),
    _flat_index("mmf", "Money market funds"),
    _flat_index("saris", "Suspensions and removals of instruments"),
    _mica(
        "mica-casp", "Crypto-asset service providers", "ac_serviceCode", "ac_serviceCode_normalised",
        "ac_serviceCode_cou", keys=("ae_lei", "ae_lei_name"),
        multi=("ac_serviceCode_cou", "ac_serviceCode", "ac_serviceCode_normalised"),
    ),
    _mica("mica-art", "Asset-referenced token issuers", "ae_credit_institution", multi=("wp_url_cou", "ae_DTI")),
    _mica(
        "mica-emt", "E-money token issuers", "ae_exemption48_4", "ae_exemption48_5", "ae_authorisation_other_emt",
        multi=("ae_DTI",),
    ),
    _mica("mica-other", "White papers for other crypto-assets", multi=("ae_offerCode_cou", "ae_DTI")),
    _mica("mica-ncasp", "Non-compliant crypto-asset entities", "ae_infrigment"),
    Register(
        "eba-psd",
        "Payment and e-money institutions",
        docs_url="https://euclid.eba.europa.eu/register/pir/registerDownload",
        key_columns=("EntityCode",),
        identifier_columns=("EntityCode",),
        name_columns=("ENT_NAM",),
        expected_fields=("EntityCode", "EntityType", "CA_OwnerID", "ENT_NAM"),
        enum_fields=(
            "EntityType", "EntityTypeLabel", "CA_OwnerID", "CA_OwnerName", "ENT_COU_RES", "ENT_SER", "ENT_SER_COU",
            "ENT_EXC", "DER_CHI_ENT_AUT",
        ),
        multi_value_fields={"ENT_SER": " | ", "ENT_SER_COU": " | ", "ENT_EXC": " | "},
        disclaimer=EBA_STATEMENT,
        personal_data="Agents are largely natural persons, listed with name and address.",
    ),
    Register(
        "eudamed-eo",
        "Economic operators for medical devices",
        docs_url="https://ec.europa.eu/tools/eudamed",
        key_columns=("eudamedIdentifier",),
        identifier_columns=("eudamedIdentifier", "srn"),
        name_columns=("name",),
        expected_fields=("name", "eudamedIdentifier", "actorType", "countryIso2Code"),
        enum_fields=(
            "actorType", "actorType_srnCode", "actorStatus", "countryIso2Code", "countryName", "countryType", "roleName",
        ),
        personal_data="Most rows carry an e-mail address and a telephone number; some are sole traders.",
    ),
    Register(
        "eudamed-nb",
        "Notified bodies for medical devices",
        docs_url="https://ec.europa.eu/tools/eudamed",
        key_columns=("eudamedIdentifier",),
        identifier_columns=("eudamedIdentifier", "srn"),
        name_columns=("name",),
        expected_fields=("name", "eudamedIdentifier"),
        enum_fields=("actorType", "countryIso2Code", "countryName", "legislationCodes", "nbStatus"),
        multi_value_fields={"legislationCodes": " | ", "legislationLinks": " | "},
    ),
    Register(
        "ctis",
        "Clinical trials and their sponsors",
        docs_url="https://euclinicaltrials.eu/",
        key_columns=("ctNumber",),
        identifier_columns=("ctNumber",),
        name_columns=("sponsor",),
        expected_fields=("ctNumber", "sponsor", "sponsorType", "ctStatus"),
        enum_fields=(
            "sponsorType", "trialPhase", "trialCountries", "therapeuticAreas", "ctStatus", "trialRegion",
            "resultsFirstReceived",
        ),
        multi_value_fields={"trialCountries": " | ", "therapeuticAreas": " | "},
    ),
    Register(
        "finma",
        "Swiss authorisation holders",
        jurisdiction="CH",
        docs_url="https://www.finma.ch/",
        key_columns=("UID", "Name"),
        identifier_columns=("UID", "uid_digits"),
        name_columns=("Name",),
        expected_fields=("Name", "UID", "authorisation_AuthorisationTypeEN"),
        enum_fields=("authorisation_AuthorisationTypeEN", "authorisation_AuthorisationTypeDE", "City"),
        block_structured=True,
    ),
    Register(
        "ch-uid",
        "Swiss enterprise identification numbers",
        jurisdiction="CH",
        docs_url="https://www.uid.admin.ch/",
        identifier_columns=("uid",),
        name_columns=(
            "organisationIdentification.organisationName", "organisationIdentification.organisationLegalName",
        ),
        expected_fields=("uid", "organisationIdentification.organisationName", "address.cantonAbbreviation"),
        enum_fields=(
            "organisationIdentification.legalForm", "address.cantonAbbreviation",
            "uidregInformation.uidregStatusEnterpriseDetail", "commercialRegisterInformation.commercialRegisterStatus",
            "vatRegisterInformation.vatStatus",
        ),
        bulk_readable=False,
        personal_data="Sole traders are listed by name, some at a home address.",
    ),
    Register(
        "gisa",
        "Austrian trade licences",
        jurisdiction="AT",
        docs_url="https://www.data.gv.at/",
        expected_fields=("nuts2", "gewerbeart", "gewerbewortlaut", "rechtswirksam"),
        enum_fields=("gewerbeart", "gewerbeart_label", "nuts2", "nuts2_label", "adress_art", "inhaber_pers_art"),
        cadence_hours=720.0,
        data_licence=CC_BY,
    ),
    Register(
        "gisa-codes",
        "Austrian trade code list",
        jurisdiction="AT",
        docs_url="https://www.data.gv.at/",
        key_columns=("gewerbeschluessel",),
        expected_fields=("gewerbeschluessel", "gewerbewortlaut", "gewerbeart"),
        enum_fields=("gewerbeart", "ist_historisch"),
        cadence_hours=720.0,
        data_licence=CC_BY,
    ),
    Register(
        "gleif",
        "Legal entity identifiers",
        docs_url="https://www.gleif.org/en/lei-data/gleif-api",
        key_columns=("lei",),
        identifier_columns=("lei",),
        name_columns=("entity.legalName.name",),
        expected_fields=("lei", "entity.legalName.name", "entity.status", "registration.status"),
        enum_fields=(
            "entity.status", "registration.status", "entity.legalAddress.country", "entity.legalForm.id",
            "entity.category", "entity.registeredAt.id", "registration.corroborationLevel",
        ),
        data_licence=CC0,
        disclaimer="Summary, not a quotation: accuracy is not verified beyond the corroboration level recorded on each record.",
    ),
    Register(
        "vies",
        "VAT number checks",
        docs_url="https://ec.europa.eu/taxation_customs/vies/",
        key_columns=("countryCode", "vatNumber"),
        identifier_columns=("vatNumber",),
        name_columns=("name",),
        expected_fields=("isValid", "vatNumber", "requestDate"),
        enum_fields=("isValid", "userError", "countryCode", "availability"),
        bulk_readable=False,
        disclaimer="Summary, not a quotation: a valid answer confirms registration, not solvency, activity or identity.",
        personal_data="The registration of a sole trader carries name and address.",
    ),
    Register(
        "ted",
        "EU public procurement notices",
        docs_url="https://docs.ted.europa.eu/api/",
        key_columns=("publication-number",),
        name_columns=("winner-name", "buyer-name"),
        expected_fields=("publication-number", "publication-date", "notice-type"),
        enum_fields=("notice-type", "buyer-country", "classification-cpv"),
        multi_value_fields={"winner-name": " | ", "classification-cpv": " | "},
        disclaimer="Summary, not a quotation: notices are republished as submitted, without warranty of accuracy or completeness.",
        population=False,
    ),
)

BY_KEY = {r.key: r for r in REGISTERS}


def register(key: str) -> Register:
    """A known register, or an ad-hoc one for ``solr:<core>`` keys."""
    if key in BY_KEY:
        return BY_KEY[key]
    if key.startswith("solr:") and len(key) > 5:
        return Register(key, f"ad-hoc document index {key[5:]}")
    raise KeyError(f"unknown register {key!r}; known: {', '.join(BY_KEY)}")


def register_catalog(spark: SparkSession, registers: tuple[Register, ...] = REGISTERS) -> DataFrame:
    """The catalogue as a table: one row per register, bounded by the list above."""
    schema = (
        "key string, title string, jurisdiction string, docs_url string, key_columns array<string>, "
        "identifier_columns array<string>, name_columns array<string>, expected_fields array<string>, "
        "enum_fields array<string>, multi_value_fields map<string,string>, cadence_hours double, "
        "block_structured boolean, bulk_readable boolean, disclaimer string, data_licence string, "
        "personal_data string, population boolean"
    )
    names = [part.split(" ")[0] for part in schema.split(", ")]
    rows = []
    for r in registers:
        values = asdict(r)
        rows.append(tuple(list(v) if isinstance(v, tuple) else v for v in (values[n] for n in names)))
    return spark.createDataFrame(rows, schema)
