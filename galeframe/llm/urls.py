"""URL filters: pattern rules indexed by their rarest literal token, so that a regular expression runs on the few urls that hold its token.

A pattern is matched against ``host + path`` of a url:

* ``||`` at its start: the rest begins at the host's start or after one of the host's dots;
* ``|`` at its end: the path ends there;
* ``*``: any run of characters; everything else stands for itself.

Tokens are runs of ASCII letters and digits. A token of a pattern is usable
where it must be a whole token of every url that fits: it touches neither a
``*`` nor an open end. A pattern without such a token is listed under the
empty one, which every url has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm.common import column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and where there is no ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 1))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; case counts."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 2)


def compiled(rules: DataFrame) -> DataFrame:
    """``rules`` with ``regex`` and ``tokens``, the usable tokens of the pattern. Hosts of ``||`` patterns are lower-cased.

    Each piece between stars is taken where it comes first, in an atomic
    group: that is enough for such patterns, and a very long url is read once.
    """
    p = F.col("pattern")
    at_host, at_end = p.startswith("||"), p.endswith("|") & (F.length(p) > F.when(p.startswith("||"), 2).otherwise(0))
    body = p.substr(F.when(at_host, 3).otherwise(1), F.length(p) - F.when(at_host, 2).otherwise(0) - F.when(at_end, 1).otherwise(0))
    lowered = F.concat(ascii_lower(F.regexp_extract(body, "(?s)^[^/]*", 0)), F.regexp_extract(body, "(?s)^[^/]*(.*)$", 1))
    r = rules.withColumns({"_host": at_host, "_end": at_end, "_body": F.when(at_host, lowered).otherwise(body)})
    pieces = F.transform(F.split("_body", r"\*"), lambda x: F.regexp_replace(x, "([^A-Za-z0-9])", r"\\$1"))
    r = r.withColumn("_pieces", pieces)
    first, one, n = F.col("_pieces")[0], F.size("_pieces") == 1, F.size("_pieces")
    middle = F.slice("_pieces", F.lit(2), n - F.when(F.col("_end"), 2).otherwise(1))
    head = F.when(F.col("_host"), F.concat(F.lit(r"(?>(?:[^/]*?\.)??"), first, F.lit(")"))).otherwise(F.concat(F.lit("(?>.*?"), first, F.lit(")")))
    tail = F.when(F.col("_end"), F.concat(F.lit(".*"), F.element_at("_pieces", -1), F.lit(r"\z"))).otherwise("")
    many = F.concat(head, F.array_join(F.transform(middle, lambda x: F.concat(F.lit("(?>.*?"), x, F.lit(")"))), ""), tail)
    only = F.concat(F.when(F.col("_host"), r"(?:[^/]*\.)?").otherwise(".*"), first, F.lit(r"\z"))
    regex = F.concat(F.lit("(?s)^"), F.when(one & F.col("_end"), only).when(one, head).otherwise(many))
    edged = F.concat(F.when(F.col("_host"), ".").otherwise("*"), "_body", F.when(F.col("_end"), ".").otherwise("*"))
    tokens = F.array_distinct(F.regexp_extract_all(edged, F.lit("(?<![A-Za-z0-9*])([A-Za-z0-9]+)(?![A-Za-z0-9*])")))
    return r.withColumns({"regex": regex, "tokens": tokens}).drop("_host", "_end", "_body", "_pieces")


def url_tokens(subject: Column) -> Column:
    """The distinct tokens of ``host + path``, the empty one among them."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(subject, F.lit("([A-Za-z0-9]+)"))))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    """A rules DataFrame from (rule_id, pattern, verdict, tier); ``size`` is the pattern's length. Its size is known to the planner."""
    rows = ", ".join(f"({literal(i)}, {literal(p)}, {literal(v)}, {int(t)}, {len(p)})" for i, p, v, t in rules)
    return spark.sql(f"select * from values {rows} as r(rule_id, pattern, verdict, tier, size)")


def literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def token_index(subjects: DataFrame, rules: DataFrame) -> DataFrame:
    """The compiled rules, each under ``token``: the one of its tokens that the fewest of all ``subjects`` hold (ties: the least text).

    Only tokens that some rule has are counted, so that the counts that meet
    are as many as the rules' tokens, whatever the number of urls.
    """
    r = compiled(rules)
    named = r.select("rule_id", F.explode("tokens").alias("token"))
    seen = subjects.select(F.explode(url_tokens(F.col("_subject"))).alias("token")).join(named.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    ranked = named.join(seen, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "token")).alias("_least"))
    return r.join(ranked, "rule_id", "left").withColumn("token", F.coalesce("_least.token", F.lit(""))).drop("tokens", "_least")


def url_verdicts(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path`` and ``fit``: (rule_id, tier, size, pattern, verdict) of the rule that decides, or null.

    ``rules``: (rule_id unique, pattern, verdict, tier int, size int). Of the
    rules that fit, those of the least ``tier`` come first, then the greatest
    ``size``, then the least ``rule_id``. Rows of ``rules`` with a null pattern
    fit nothing.

    A url is judged once however many rows hold it: distinct urls meet the
    index by token, regular expressions run on those pairs only, the best of a
    url is kept by an aggregation that combines before its shuffle, and rows
    join it by url. No side is told to be broadcast: a short list of rules is
    by its size, a long one is joined by token, where adaptive execution
    splits a hot token or url. Null urls and those without ``://`` have an
    empty host and path, and can fit only patterns that fit the empty text.
    Repeated rows stay; an empty table gives an empty one; columns of
    ``pages`` named ``host``, ``path`` or ``fit`` are replaced.
    """
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "fit")]
    url = column(url_col)
    rules = rules.where(F.col("pattern").isNotNull()).select("rule_id", "pattern", "verdict", "tier", "size")
    subjects = pages.select(F.concat(host(url), path(url)).alias("_subject"))
    index = token_index(subjects, rules)
    met = subjects.distinct().select("_subject", F.explode(url_tokens(F.col("_subject"))).alias("token")).join(index, "token").where(F.regexp_like("_subject", F.col("regex")))
    best = F.min_by(F.struct("rule_id", "tier", "size", "pattern", "verdict"), F.struct("tier", -F.col("size"), "rule_id"))
    judged = met.groupBy("_subject").agg(best.alias("fit"))
    rows = pages.select(*[column(c) for c in keep], host(url).alias("host"), path(url).alias("path")).withColumn("_subject", F.concat("host", "path"))
    return rows.join(judged, "_subject", "left").drop("_subject")
