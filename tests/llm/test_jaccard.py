"""The similarity join against all pairs, and its pruning."""

import math
import random
import re
from collections import defaultdict

import numpy as np

from galeframe.llm import jaccard, queries
from tests.llm.helpers import empty, odd, words


def shingles(text, width=5):
    w = re.findall(r"\w+", (text or "").lower())
    if not w:
        return {("raw", (text or "").strip())}
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def brute(texts, threshold=0.8):
    """(root of each row's class, linked pairs of unlike sets)."""
    sets = [frozenset(shingles(t)) for t in texts]
    holds = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].add(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holds[x] if j < i}:
            both = len(s & sets[j])
            if both / (len(s) + len(sets[j]) - both) >= threshold:
                root[find(i)] = find(j)
                if s != sets[j]:
                    pairs.add(frozenset((s, sets[j])))
    return [find(i) for i in range(len(texts))], pairs


def same_classes(got, want):
    a, b = defaultdict(set), defaultdict(set)
    for i, (x, y) in enumerate(zip(got, want, strict=True)):
        a[x].add(i)
        b[y].add(i)
    assert sorted(map(sorted, a.values())) == sorted(map(sorted, b.values()))


def test_classes_match_all_pairs(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op4_jaccard_join(spark, sf).collect()}
    want, _ = brute([r["text"] for r in docs])
    assert len(got) == len(docs)
    same_classes([got[r["doc_id"]]["class_id"] for r in docs], want)
    assert all(r["class_id"] <= r["doc_id"] for r in got.values())


def near_copies(n, length, edits, seed):
    rng = np.random.default_rng(seed)
    base = words(length, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, length, edits):
            w[at] = "edited" + str(rng.integers(1000))
        out.append(" ".join(w))
    return out


def test_a_large_group_of_near_copies_is_one_class(spark):
    texts = near_copies(300, 120, 2, 4) + [words(120, 1000 + i) for i in range(100)] + near_copies(40, 60, 3, 5)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in jaccard.similarity_join(rows).collect()}
    want, pairs = brute(texts)
    same_classes([got[i] for i in range(len(texts))], want)
    all_rows, links = jaccard.near_duplicates(rows)
    assert 0 < links.count() <= len(pairs)
    assert all_rows.count() == len(texts)


def test_odd_rows(spark):
    rows = odd(spark)
    got = jaccard.similarity_join(rows).collect()
    assert len(got) == rows.count()
    by = {r["doc_id"]: r for r in got}
    assert by[6]["class_id"] == 6 == by[7]["class_id"] and by[6]["copies"] == 4
    assert by[0]["class_id"] == 0 == by[1]["class_id"] == by[2]["class_id"]
    assert by[10]["class_id"] == 10 and by[8]["class_id"] == 8
    kept = jaccard.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (0, 4, 5, 6, 8, 9, 10, 11, 12)] + [(True, 0)]
    assert jaccard.similarity_join(empty(spark)).count() == 0
    assert jaccard.one_of_each(empty(spark)).count() == 0


def test_pruning_keeps_what_can_still_reach_the_threshold():
    steps = (16, 64, 128)
    least = jaccard.least_matches(0.8, 1e-5, steps)
    for n, m in zip(steps, least, strict=True):
        tail = lambda k: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= 1e-5 and (m == 0 or tail(m - 1) < 1e-5)
        missed = sum(math.comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(m))
        assert missed < 1e-4


def test_minhash_estimates_similarity():
    a, b = jaccard._coefficients()
    rng = np.random.default_rng(8)
    x = np.unique(rng.integers(0, 1 << 63, 1000, np.uint64))
    y = np.concatenate([x[:700], np.unique(rng.integers(0, 1 << 63, 300, np.uint64))])
    s = np.mean(jaccard.minhash(x, a, b) == jaccard.minhash(np.sort(y), a, b))
    assert abs(s - 700 / 1300) < 0.15


def test_a_group_that_drifted_apart(spark):
    """Copies of one text with edits of every strength: the classes are those of all pairs, though most pairs never meet."""
    rng = random.Random(5)
    base = words(160, 3).split()
    texts = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"edit{k}x{rng.randrange(999)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in jaccard.similarity_join(docs).collect()}
    same_classes([got[i] for i in range(len(texts))], brute(texts)[0])
    assert len(set(got.values())) > 10


def degrees(texts, pairs):
    """Each text's number of linked unlike sets."""
    n = defaultdict(int)
    for pair in pairs:
        for s in pair:
            n[s] += 1
    return [n[frozenset(shingles(t))] for t in texts]


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    """n_links and the links of near copies, of copies that drifted apart, and of small classes, in one block of nodes and in many."""
    rng = random.Random(6)
    base = words(150, 12).split()
    drifted = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 10)):
            w[rng.randrange(len(w))] = f"edit{k}x{rng.randrange(999)}"
        drifted.append(" ".join(w))
    texts = near_copies(250, 500, 1, 21) + drifted + [t for k in range(20) for t in near_copies(3, 80, 2, 50 + k)] + [words(90, 700 + i) for i in range(20)]
    texts += texts[:5]
    want, pairs = brute(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for nodes, hashes in ((128, 1 << 18), (1000, 1 << 13)):
        monkeypatch.setattr(jaccard, "BLOCK_NODES", nodes)
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", hashes)
        got = {r["doc_id"]: r for r in jaccard.similarity_join(rows).collect()}
        assert [got[i]["n_links"] for i in range(len(texts))] == degrees(texts, pairs)
        same_classes([got[i]["class_id"] for i in range(len(texts))], want)
    _, links = jaccard.near_duplicates(rows)
    links = links.collect()
    assert len({(r["a"], r["b"]) for r in links}) == len(links) == len(pairs) and all(r["jaccard"] >= 0.8 for r in links)
