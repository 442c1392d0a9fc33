"""One query per operator over its whole table, and SQL for the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import (
    ball_tree,
    decontamination,
    html_text,
    langid,
    mixture,
    quality,
    simhash,
    suffix_dedup,
    toxicity,
    training_order,
    url_rules,
    value_codes,
    whitening,
)
from rollbook.llm.common import in_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), short_items=True)


@query()
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = in_fold(F.col("doc_id"), 5, 0)
    machine = quality.learn(docs, labels.where(~held).select("doc_id", "quality"), chars="n_chars")
    scored = quality.score(docs.withColumn("held_out", held), machine, "doc_id", "held_out", chars="n_chars")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query()
def op3_training_order(spark: SparkSession, folder: str) -> DataFrame:
    return training_order.training_order(table(spark, folder, "documents"))


#: The verdicts stated for hosts and paths.
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


_SQL_RULES = ", ".join(f"('{r}', '{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for r, v in URL_RULES)
_SQL_REST = "substr(url, instr(url, '://') + 3)"


@query(
    f"""
    WITH split AS (
        SELECT page_id, coalesce(instr(url, '://') > 0, false) AS has, {_SQL_REST} AS rest FROM pages),
    parts AS (
        SELECT page_id, has, rest,
            CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*', 0), '{url_rules._UPPER}', '{url_rules._LOWER}') ELSE '' END AS host,
            CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
            regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query
        FROM split),
    named AS (
        SELECT *, list_reverse(string_split(host, '.')) AS d, string_split(path, '/') AS p,
            array_to_string(list_sort(list_distinct(list_transform(string_split(query, '&'), lambda k: regexp_extract(k, '^[^=]*', 0)))), '&') AS keys
        FROM parts),
    tokens AS (
        SELECT page_id, host, path, CASE WHEN has THEN list_sort(list_filter([
            'd1=' || d[1], 'd2=' || d[2], 'd3=' || d[3],
            'p1=' || nullif(regexp_replace(p[2], '[0-9]+', '#', 'g'), ''), 'p2=' || nullif(regexp_replace(p[3], '[0-9]+', '#', 'g'), ''),
            'q=' || nullif(keys, ''), CASE WHEN instr(rest, '#') > 0 THEN 'f=' END], lambda x: x IS NOT NULL)) ELSE [] END AS tokens
        FROM named),
    rules AS (SELECT * FROM (VALUES {_SQL_RULES}) r(rule, verdict, rule_host, rule_path)),
    ruled AS (
        SELECT t.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
        FROM tokens t JOIN rules r ON (t.host = r.rule_host OR ends_with(t.host, '.' || r.rule_host)) AND starts_with(t.path, r.rule_path)
        GROUP BY t.page_id),
    bags AS (SELECT t.tokens, r.verdict, count(*) AS n FROM tokens t JOIN ruled r USING (page_id) GROUP BY ALL),
    numbers AS (SELECT range AS m FROM range(1, 128)),
    subsets AS (
        SELECT list_filter(tokens, lambda x, i: (m >> (i - 1)) % 2 = 1) AS own, verdict, n
        FROM bags, numbers WHERE m < (1 << len(tokens))),
    counted AS (
        SELECT own, verdict, sum(n) AS both_n, sum(sum(n)) OVER (PARTITION BY own) AS own_n FROM subsets GROUP BY own, verdict),
    mined AS (
        SELECT own, verdict, both_n, both_n::DOUBLE / own_n AS confidence FROM counted
        WHERE both_n >= ceil((SELECT sum(n) FROM bags) * {url_rules.MIN_SUPPORT}) AND both_n::DOUBLE / own_n >= {url_rules.MIN_CONFIDENCE}),
    sets AS (SELECT DISTINCT tokens FROM tokens ANTI JOIN ruled USING (page_id)),
    decided AS (
        SELECT s.tokens, max(row(m.confidence, m.both_n, m.verdict)) AS best
        FROM sets s JOIN mined m ON list_has_all(s.tokens, m.own) GROUP BY s.tokens)
    SELECT t.page_id, t.host, t.path, r.rule, coalesce(r.verdict, d.best[3], '{url_rules.DEFAULT}') AS verdict
    FROM tokens t LEFT JOIN ruled r USING (page_id) LEFT JOIN decided d ON t.tokens = d.tokens AND r.rule IS NULL
    """
)
def op4_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    return url_rules.judge(table(spark, folder, "pages"), rules, "page_id")


@query()
def op5_mixture(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixture.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


@query()
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query(
    f"""
    WITH whole AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({ball_tree.SCALE} * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
        SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
        FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM pairs QUALIFY rank <= 10
    """
)
def op7_ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    return ball_tree.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"), "page_id", "url")


@query()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = in_fold(F.col("doc_id"), 4, 2)
    model = toxicity.learn(docs, labels.where(~held).select("doc_id", "toxic"))
    scored = toxicity.score(docs.withColumn("held_out", held), model, "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query()
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = in_fold(F.col("doc_id"), 4, 2)
    net = langid.learn(docs.where(~held))
    judged = langid.predict(docs.select("doc_id", "text", held.alias("held_out")), net, keep=("doc_id", "held_out"))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


@query(value_codes.sql())
def op11_value_codes(spark: SparkSession, folder: str) -> DataFrame:
    return value_codes.compress(table(spark, folder, "embeddings"))


@query(suffix_dedup.SQL)
def op12_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, folder, "documents"))


@query()
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
