"""Importance resampling against a plain loop."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from galeframe.llm import queries, resampling
from tests.compare import difference
from tests.llm.helpers import empty, odd, words

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, most):
    ws = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, most + 1) for i in range(len(ws) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(docs, target, most, buckets, least, percent, seed):
    s = Counter(bucket(g, buckets) for _, t in docs for g in grams(t, most)[1])
    t = Counter(bucket(g, buckets) for x in target for g in grams(x, most)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(s.total() + buckets) / ((s[b] + 1) * float(t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, features = grams(text, most)
        weight = sum(gain[bucket(g, buckets)] for g in features)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: len(fit) * percent // 100]
    return Counter([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in fit[len(drawn) :] + [r for r in out if r[4] < least]])


def test_query_matches_sql(spark, sf):
    assert difference(queries.op12_importance_resampling(spark, sf), queries.SQL["op12_importance_resampling"], sf) == ""


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 7)])
def test_matches_a_loop(spark, most, buckets):
    docs = odd(spark).unionByName(spark.createDataFrame([(100 + i, words(20 + i % 30, i % 50)) for i in range(200)], "doc_id long, text string"), allowMissingColumns=True)
    target = spark.createDataFrame([(1, words(40, 3)), (2, None), (None, "Ärger ÖL and 12 words"), (1, words(40, 3))], "item_id long, text string")
    got = resampling.resample(docs, target, most=most, buckets=buckets, percent=30, seed=7)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], most, buckets, 20, 30, 7)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == want


def test_small_batches_give_the_same_counts(spark):
    docs = odd(spark)
    whole, cut = (Counter((r["_id"], r["n_words"], tuple(r["buckets"]), tuple(r["counts"])) for r in resampling.bucket_counts(docs, "doc_id", "text", 2, 50, batch_bytes=b).collect()) for b in (1 << 22, 10))
    assert whole == cut


def test_empty_tables(spark):
    target = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty(spark), target).count() == 0
    got = resampling.resample(spark.createDataFrame([(i, words(20, i)) for i in range(10)], "doc_id long, text string"), target)
    assert got.where(F.col("rank").isNotNull()).count() == 1


def test_equal_rows_are_ranked_apart(spark):
    rows = spark.createDataFrame([(None, words(25, 1))] * 500 + [(i, words(25, i)) for i in range(500)], "doc_id long, text string")
    got = [r["rank"] for r in resampling.resample(rows, rows.select(F.col("doc_id").alias("item_id"), "text"), percent=90).collect()]
    assert sorted(r for r in got if r is not None) == list(range(1, 901))
