"""URL filters against a loop over all rules, and against SQL."""

import random
import re

from pyspark.sql import functions as F

from galeframe.llm import queries, urls
from tests.compare import difference

RULES = [
    ("org/", "||org/", "allow", 1), ("ex.org/a", "||ex.org/a", "block", 1), ("upper", "||EX.com/A", "block", 1), ("end", "||com/de|", "block", 1), ("star", "*b*d/", "allow", 2), ("plain", "xx-yy", "block", 2), ("mid", "/a/*.html|", "block", 2),
    ("dots", "||a+b(c).com", "allow", 2), ("tie1", "||net/q", "allow", 3), ("tie2", "||net/q", "block", 3), ("all", "*", "block", 9),
]


def split(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def fits(pattern, host, path):
    body, at_host = (pattern[2:], True) if pattern.startswith("||") else (pattern, False)
    body, at_end = (body[:-1], True) if body.endswith("|") else (body, False)
    if at_host:
        first, slash, rest = body.partition("/")
        body = first.lower() + slash + rest
    regex = re.compile(".*".join(map(re.escape, body.split("*"))) + (r"\Z" if at_end else ""), re.S)
    subject = host + path
    starts = [0, *[i + 1 for i, c in enumerate(host) if c == "."]] if at_host else range(len(subject) + 1)
    return any(regex.match(subject, i) for i in starts)


def brute(url, rules):
    host, path = split(url)
    good = [(t, -len(p), i, v) for i, p, v, t in rules if fits(p, host, path)]
    return (host, path, min(good)[2] if good else None)


def rows(spark, urls_, extra=()):
    return spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(urls_)] + list(extra), "page_id long, url string, host string, path string, tier int")


def test_query_matches_sql(spark, sf):
    assert difference(queries.op11_url_filters(spark, sf), queries.SQL["op11_url_filters"], sf) == ""


def test_rules_fit_as_in_a_loop(spark):
    rng = random.Random(5)
    hosts = ["org", "ex.org", "a.EX.org", "xorg", "ex.com", "com", "b.com", "a+b(c).com", "net", "q.net:80", "xx-yy.net", "Éx.org", ""]
    paths = ["", "/", "/a", "/A", "/ab/c", "/a/x.html", "/a/x.htmls", "/de", "/de/", "/q/b/d/", "/b\nd/"]
    made = [f"{rng.choice(['http', 'x://y', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a://b/c', '#://x', '?q#f'])}" for _ in range(300)]
    made += [None, "", "no scheme", "://", "http://", "http:///a/1.html", "http://" + "long." * 500 + "org/", "https://ex.org/" + "a" * 3000]
    given = urls.rules_table(spark, RULES)
    got = urls.url_verdicts(rows(spark, made, [(None, "http://ex.org/a", None, None, None), (7, made[7], "h", "p", 1)]), given).select("page_id", "url", "host", "path", "tier", F.col("fit.rule_id")).collect()
    assert len(got) == len(made) + 2
    for r in got:
        assert (r["host"], r["path"], r["rule_id"]) == brute(r["url"], RULES), r["url"]


def test_very_long_urls_are_read_once(spark):
    long = "http://" + "long." * 100_000 + "org/" + "ab" * 200_000
    got = urls.url_verdicts(rows(spark, [long]), urls.rules_table(spark, RULES)).select("fit.rule_id").collect()
    assert got[0][0] == "org/"


def test_index_takes_the_rarest_whole_token(spark):
    given = urls.rules_table(spark, [("r", "||ex.org/common/rare/par", "block", 1), ("n", "*open*", "block", 1)])
    subjects = spark.createDataFrame([("ex.org/common/",)] * 5 + [("ex.org/common/rare/partly",)], "_subject string")
    assert {r["rule_id"]: r["token"] for r in urls.token_index(subjects, given).collect()} == {"r": "rare", "n": ""}


def test_empty_tables(spark):
    given = urls.rules_table(spark, RULES)
    assert urls.url_verdicts(rows(spark, []), given).count() == 0
    got = urls.url_verdicts(rows(spark, ["http://ex.org/a"]), given.where("false")).collect()
    assert [(r["host"], r["path"], r["fit"]) for r in got] == [("ex.org", "/a", None)]
