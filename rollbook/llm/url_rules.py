"""URL filter: explicit rules first, then association rules mined from labelled URLs.

An explicit rule names a host and the beginning of a path.  Where none fits, association rules
decide: FP-growth finds the frequent combinations of URL tokens with a label, and the rules with
enough confidence and support are filed in an inverted index under their rarest token.  URLs are
matched as distinct token sets, so a host with a third of all pages is matched a few times.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.session import materialise

#: Share of the labelled URLs that have a rule's tokens and label; share of those with its tokens that have the label.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6
#: What a URL is judged that no rule of either kind fits.
DEFAULT = "allow"
_LABEL = "verdict="

_REST = "substr(url, instr(url, '://') + 3)"
_HAS = "coalesce(instr(url, '://') > 0, false)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(urls: DataFrame) -> DataFrame:
    """``urls`` with ``host``, ``path`` and ``tokens`` of the column ``url``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the
    path follows up to ``?``, ``#`` or the end.  Null and without ``://``: both empty, no tokens.
    Tokens are the last three host labels by place, the first two path segments with digits as ``#``,
    the set of query keys, and whether there is a fragment: at most seven.
    """
    host = F.expr(f"case when {_HAS} then translate(regexp_extract({_REST}, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') else '' end")
    path = F.expr(f"case when {_HAS} then regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) else '' end")
    query = f"regexp_extract({_REST}, '^[^?#]*[?]([^#]*)', 1)"
    keys = f"array_join(array_sort(array_distinct(transform(split({query}, '&'), k -> regexp_extract(k, '^[^=]*', 0)))), '&')"
    labels, segments = "reverse(split(host, '[.]'))", "split(path, '/')"
    tokens = [f"'d{i + 1}=' || get({labels}, {i})" for i in range(3)]
    tokens += [f"'p{i}=' || nullif(regexp_replace(get({segments}, {i}), '[0-9]+', '#'), '')" for i in (1, 2)]
    tokens += [f"'q=' || nullif({keys}, '')", f"case when instr({_REST}, '#') > 0 then 'f=' end"]
    found = F.expr(f"case when {_HAS} then array_sort(array_distinct(array_compact(array({', '.join(tokens)})))) else array() end")
    return urls.withColumn("host", host).withColumn("path", path).withColumn("tokens", found)


def fitting_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with ``host``, ``path``) and the longest rule that fits each: ``rule``, ``ruled``; both null if none does.

    ``rules`` has ``rule`` (host, then path from the first ``/`` on) and ``verdict``.  A rule fits its host and all
    subdomains, where the path begins with the rule's.  Of rules of one length the first in code
    point order wins.  Rules are found per distinct host, by equality with a suffix of it.
    """
    cut = "instr(rule || '/', '/')"
    rules = rules.selectExpr("rule", "verdict", f"substr(rule, 1, {cut} - 1) as rule_host", f"substr(rule, {cut}) as rule_path")
    hosts = rows.select("host").where("host <> ''").distinct()
    labels = "split(host, '[.]')"
    suffix = F.explode(F.expr(f"transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels})), '.'))"))
    hosts = hosts.select(F.col("host").alias("known_host"), suffix.alias("suffix"))
    fits = hosts.join(rules, F.col("suffix") == F.col("rule_host"))
    order = F.struct((-F.length("rule")).alias("length"), "rule", "rule_path", F.col("verdict").alias("ruled"))
    fits = fits.groupBy("known_host").agg(F.sort_array(F.collect_list(order)).alias("fits"))
    rows = rows.join(fits, F.col("host") == F.col("known_host"), "left")
    best = F.expr("get(filter(fits, f -> startswith(path, f.rule_path)), 0)")
    return rows.withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("ruled", F.col("best.ruled")).drop("known_host", "fits", "best")


def mine(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``rule_tokens, verdict, confidence, support`` of the rules mined from ``tokens, verdict`` rows.

    Rules lead from tokens to a label and reach both bounds.  Rows without tokens count towards the
    support of none.  No rows give no rules.
    """
    bags = labelled.select(F.array_append("tokens", F.concat(F.lit(_LABEL), "verdict")).alias("items"))
    grown = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(bags)
    rules = grown.associationRules.where(F.startswith(F.get("consequent", F.lit(0)), F.lit(_LABEL)))
    verdict = F.substring(F.get("consequent", F.lit(0)), len(_LABEL) + 1, 1 << 20)
    return rules.select(F.col("antecedent").alias("rule_tokens"), verdict.alias("verdict"), "confidence", "support")


def match(sets: DataFrame, mined: DataFrame) -> DataFrame:
    """``tokens, mined`` for every distinct token set that a mined rule fits: the verdict of the surest rule.

    Ties in confidence go to the larger support, then to ``block``.  A rule is filed under that of its tokens
    that fewest sets have, so only sets with that token are tried.
    """
    sets = sets.select("tokens").distinct()
    common = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rules = materialise(mined.withColumn("no", F.monotonically_increasing_id()), "rules")
    rare = rules.select("no", F.explode("rule_tokens").alias("token")).join(common, "token", "left")
    rare = rare.groupBy("no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rare"))
    index = rules.join(rare, "no").select(F.col("rare.token").alias("token"), "rule_tokens", "verdict", "confidence", "support")
    tried = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = tried.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    surest = F.max(F.struct("confidence", "support", "verdict"))
    return fits.groupBy("tokens").agg(surest.alias("surest")).select("tokens", F.col("surest.verdict").alias("mined"))


def judge(pages: DataFrame, rules: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` for every ``url``.

    The longest fitting rule decides.  Other URLs are judged by rules mined from those that are so
    decided, and as ``DEFAULT`` where none of these fits, as are null URLs.  Repeated rows come back
    repeated; columns of ``pages`` other than ``keep`` and ``url`` are ignored.
    """
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = pages.select(F.col("url").cast("string").alias("url"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)])
    rows = materialise(fitting_rule(parts(rows), rules).select("host", "path", "tokens", "rule", "ruled", *names), "urls")
    mined = mine(rows.where("ruled is not null").select("tokens", F.col("ruled").alias("verdict")))
    decided = match(rows.where("ruled is null"), mined).select(F.col("tokens").alias("set"), "mined")
    rows = rows.join(decided, F.col("tokens") == F.col("set"), "left")
    verdict = F.coalesce("ruled", "mined", F.lit(DEFAULT)).alias("verdict")
    return rows.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "host", "path", "rule", verdict)
