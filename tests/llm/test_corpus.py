"""Fingerprints, mixing, the language model and the pipeline against brute-force versions and invariants."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from galeframe.llm import common, fingerprints, jaccard, lm, mixing, packing, queries, toxicity
from tests.llm.helpers import empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def long_of(h):
    return h - (1 << 64) if h >> 63 else h


def hash_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return long_of(seed)


def i_match(texts, low=1.386, high=4.606):
    """The fingerprints of texts under their own lexicon, in plain Python."""
    split = [sorted({long_of(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\W_]+", t.lower()) if w}) for t in texts]
    df = Counter(t for ts in split for t in ts)
    known = {t for t, n in df.items() if low <= math.log(len(texts) / n) <= high}

    def one(ts):
        kept = [t for t in ts if t in known]
        out = [hash_longs(kept or ts)]
        marks = [(t, hash_longs([t]), long_of(xxhash.xxh64_intdigest(struct.pack("<i", 1), hash_longs([t]) % (1 << 64)))) for t in kept]
        for (bits, count), (f, first) in zip(fingerprints.LEVELS, ((0, 0), (0, 20), (1, 0), (2, 0)), strict=True):
            for k in range(count):
                some = [m[0] for m in marks if ((m[f] % (1 << 64)) >> (k * bits + first)) & ((1 << bits) - 1) == 0]
                out.append(hash_longs(some) if some else None)
        return out

    return one, split


def like(a, b):
    some = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in some) / len(some)


def digits(fp):
    return f"{fp[0] % (1 << 64):016x}:" + "".join("-" if h is None else f"{h % (1 << 32):08x}" for h in fp[1:])


def test_fingerprints_match_plain_python(spark, sf):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    one, split = i_match([t for _, t in docs])
    got = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, sf).collect()}
    near = []
    for i, (key, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        fp = one(split[i])
        assert r["fingerprint"] == digits(fp)
        ts = sorted({long_of(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\W_]+", edited.lower()) if w})
        assert r["edited_fingerprint"] == digits(one(ts))
        assert r["near_edited"] == pytest.approx(like(fp, one(ts))) and r["near_next"] == pytest.approx(like(fp, one(split[(i + 1) % len(docs)])))
        near.append((r["near_edited"], r["near_next"]))
    assert np.mean([a for a, _ in near]) > 2 * np.mean([b for _, b in near])


def test_fingerprints_of_odd_rows(spark):
    rows = odd(spark)
    got = fingerprints.edit_probe(rows).collect()
    assert len(got) == rows.count() and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["fingerprint"] == by[7]["fingerprint"] and by[0]["fingerprint"] == by[1]["fingerprint"]
    assert fingerprints.edit_probe(empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    r = fingerprints.edit_probe(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest() and r["near_next"] == 1.0


def test_next_row_over_many_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 1009, str(i * 7 % 1009)) for i in range(1009)], "id long, t string")
    got = {r["id"]: r["next_t"] for r in fingerprints.with_next(rows, "id", ["t"], 16).collect()}
    assert got == {i: str((i - 1) % 1009) for i in range(1009)}


def test_next_row_of_other_ids(spark):
    rows = spark.createDataFrame([(f"k{i:04d}", str(i)) for i in range(400)] + [(None, "none")], "id string, t string")
    got = {r["id"]: r["next_t"] for r in fingerprints.with_next(rows, "id", ["t"], 16).collect()}
    assert got == {f"k{i:04d}": str(i - 1) if i else "none" for i in range(400)} | {None: "399"}
    assert fingerprints.edit_probe(rows, "id", "t").count() == 401


def brute_mix(rows, slots_of, block):
    """Words taken of each (row, source, size, start), block by block: as often as the slots name the block."""
    named = Counter((r["_none"], r["_src"], r["block"]) for r in slots_of)
    return {r["row"]: sum(named[r["_none"], r["_src"], w // block] for w in range(r["start"], r["start"] + r["size"])) for r in rows}


def test_words_taken_are_those_of_the_slots(spark, sf):
    m = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))
    rows, slots = m.rows.collect(), m.slots.collect()
    want = brute_mix(rows, slots, m.block)
    by_id = {r["_id"]: want[r["row"]] for r in rows}
    got = {r["_id"]: r["taken"] for r in mixing.mixed_sizes(m).collect()}
    assert got == by_id
    at = {}
    for r in sorted(rows, key=lambda r: (r["_none"], r["_src"], r["start"], r["size"])):  # documents of a source lie end to end
        assert r["start"] == at.get((r["_none"], r["_src"]), 0)
        at[r["_none"], r["_src"]] = r["start"] + r["size"]


def test_targets():
    assert mixing.targets([100, 100, 100], (5, 2, 1), 3) == [300 * 5 / 8, 300 * 2 / 8, 300 / 8]
    got = mixing.targets([10, 1000, 1000, 5], (5, 2, 1), 3)
    assert got[0] == 30 and got[3] == 15 and sum(got) == pytest.approx(2015) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([], (5,), 3) == [] and mixing.targets([0, 0], (5, 2), 3) == [0, 0]


def check_mix(rows, sizes):
    """rows: (id, size, source_size, target, taken); sizes: id -> [(source, words)]."""
    by_source, taken, goal = defaultdict(int), defaultdict(int), {}
    for many in sizes.values():
        for s, n in many:
            by_source[s] += n
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([by_source[s] for s in order], (5.0, 2.0, 1.0), 3), strict=True))
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
    for r in rows:
        s = next(s for s, n in sizes[r["doc_id"]] if n == r["size"])
        assert r["source_size"] == by_source[s] and r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
        goal[s] = r["target"]
    return taken, goal


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.op3_mixing(spark, sf).collect()
    taken, goal = check_mix(rows, {r["doc_id"]: [(r["source"], len(WORD.findall(r["text"] or "")))] for r in docs})
    assert len(rows) == len(docs)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.05 * goal[s] + 64
    assert sorted(rows) == sorted(queries.op3_mixing(spark, sf).collect())


def test_slots_are_permutations(spark, sf):
    m = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), slots=50)
    by = defaultdict(dict)
    for r in m.slots.collect():
        by[r["_src"]][r["k"]] = r["block"]
    n = {r["_src"]: r["blocks"] for r in m.sources.collect()}
    for s, got in by.items():
        assert sorted(got) == list(range(len(got)))
        for at in range(0, len(got), n[s]):
            part = [got[k] for k in range(at, min(at + n[s], len(got)))]
            assert len(set(part)) == len(part) and all(0 <= b < n[s] for b in part)
        assert len(got) < 5 or [got[k] for k in range(min(len(got), n[s]))] != list(range(min(len(got), n[s])))
    starts = defaultdict(list)
    for r in m.rows.collect():
        starts[r["_src"]].append((r["start"], r["size"]))
    for parts in starts.values():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size


def test_mixing_odd_rows(spark):
    rows = odd(spark)
    sizes = defaultdict(list)
    for r in rows.collect():
        sizes[r["doc_id"]].append((r["source"], len(WORD.findall(r["text"] or ""))))
    got = mixing.mixed_sizes(mixing.mix(rows)).withColumnRenamed("_id", "doc_id").collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((k, n) for k, many in sizes.items() for _, n in many)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    out = mixing.mixed_documents(rows)
    assert out.columns == rows.columns
    whole = {r["text"] for r in rows.collect()}
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and any(t and all(w in t for w in r["text"].split()) for t in whole)
    assert mixing.mixed_sizes(mixing.mix(empty(spark))).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words_of = lambda rows: Counter({r["doc_id"]: r["w"] for r in rows.groupBy("doc_id").agg(F.sum("w").alias("w")).collect() if r["w"]})
    out = mixing.mixed_documents(docs)
    taken = Counter({r["_id"]: r["taken"] for r in mixing.mixed_sizes(mixing.mix(docs)).collect() if r["taken"]})
    assert words_of(out.withColumn("w", mixing.word_count(F.col("text")))) == taken
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert any(r["text"] == texts[r["doc_id"]] for r in out.collect())


def test_language_model(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    c = Counter()
    plain = lambda t: WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t))
    for k, t in docs.items():
        if not held[k]:
            c.update(plain(t))
            c[""] += 1
    n, v = sum(c.values()), len(c)
    rows = queries.op1_lm_scoring(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        toks = [*plain(docs[r["doc_id"]]), ""]
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(toks), sum(c[t] > 0 for t in toks), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def small_lexicon():
    rng = np.random.default_rng(1)
    tokens = [b"", *(f"w{i}".encode() for i in range(6000))]
    return lm.Lexicon(tokens, np.concatenate([[50], rng.integers(0, 30, 6000)]), 90_000, 5_800)


def filled(spark):
    lex = small_lexicon()
    rows = [(t, lm.tail_class(t), int(n), int(n) + 1) for t, n in zip(lex.tokens, lex.train, strict=True)]
    return lm.lexicon(spark.createDataFrame([(bytearray(t), c, n, m) for t, c, n, m in rows], "token binary, cls int, train long, total long"), 5000)


def test_probabilities_sum_to_one(spark):
    lex = filled(spark)
    p = lm.fresh(lex, 3)
    h = np.random.default_rng(2).normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.WORDS + lm.TAILS)
    logs = lm.target_logs(p, np.repeat(h, len(every), 0), every.astype(np.int32)).astype(float)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)
    # within a tail class: the head's words of it, and the rest of its mass for words outside the head
    cls = np.array([lm.tail_class(t) for t in lex.tokens])
    for k in range(lm.TAILS):
        mine = (cls == k) & (lex.place < 0)
        assert 0 < (10.0 ** lex.extra[mine]).sum() <= 1 + 1e-9


def test_gradients_match_differences(spark):
    lex = filled(spark)
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in lm.fresh(lex, 3).items()}
    p["Wc"] += rng.normal(0, 0.3, p["Wc"].shape)
    y = rng.integers(0, lm.WORDS + lm.TAILS, (5, 3)).astype(np.int32)
    doc = np.array([[0, 1, 2], [0, 1, 2], [3, 1, 2], [3, 1, 2], [3, 1, 4]], np.int32)
    x, start = lm.inputs(y, doc)
    h0 = np.zeros((3, lm.HIDDEN))

    def loss():
        s, _ = lm.run_window(p, x, start, h0)
        logs = lm.target_logs(p, s.reshape(-1, lm.HIDDEN).astype(np.float64), y.ravel())
        return -logs.mean()

    g, _ = lm.gradients(p, x, y, start, h0)
    rows, values = g["E"]
    g["E"] = np.zeros_like(p["E"])
    g["E"][rows] = values
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        keep, e = p[k][at], 1e-2
        p[k][at] = keep + e
        up = loss()
        p[k][at] = keep - e
        down = loss()
        p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-4), k


def test_state_is_carried_across_windows(spark):
    p = lm.fresh(filled(spark), 3)
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(1, lm.WORDS + lm.TAILS, n), 0).astype(np.int32) for n in (400, 3, 0, 77, 130, 1)]
    whole = []
    for t in texts:
        x = np.concatenate([[0], t[:-1]])[:, None]
        s, _ = lm.run_window(p, x, np.arange(len(t))[:, None] == 0, np.zeros((1, lm.HIDDEN), np.float32))
        whole.append(lm.target_logs(p, s[:, 0], t).sum())
    for width in (1, 2, 4):
        assert lm.score_texts(p, texts, width=width, window=16) == pytest.approx(whole, rel=1e-4)


def test_few_lanes_take_long_windows(spark, monkeypatch):
    """A long text is scored in few windows, with the same result as in short ones."""
    p = lm.fresh(filled(spark), 3)
    texts, sizes, plain = [np.random.default_rng(k).integers(0, lm.WORDS + lm.TAILS, n).astype(np.int32) for k, n in enumerate((4000, 30, 5))], [], lm.target_logs
    short = [lm.score_texts(p, [t], width=1, window=16)[0] for t in texts]
    monkeypatch.setattr(lm, "target_logs", lambda p, h, y: (sizes.append(len(y)), plain(p, h, y))[1])
    assert lm.score_texts(p, texts) == pytest.approx(short, rel=1e-4) and len(sizes) <= 4 and sum(sizes) == 4035


@pytest.mark.parametrize("size", [1.0, 100.0])
def test_softmax_of_large_outputs(spark, size):
    """Outputs whose exponentials leave the range of float32 have the same logs and gradients as in double."""
    p, rng = lm.fresh(filled(spark), 3), np.random.default_rng(5)
    for k in ("Wc", "Wi"):
        p[k] = rng.normal(0, size, p[k].shape).astype(np.float32)
    wide = {k: v.astype(np.float64) for k, v in p.items()}
    y = rng.integers(0, lm.WORDS + lm.TAILS, (16, 8)).astype(np.int32)
    x, start = lm.inputs(y, np.zeros_like(y))
    h = rng.uniform(-1, 1, (128, lm.HIDDEN)).astype(np.float32)
    a = h.astype(np.float64) @ wide["Wc"] + wide["bc"]
    want = a[np.arange(128), np.where(y.ravel() < lm.WORDS, y.ravel() // lm.EACH, lm.CLASSES + y.ravel() - lm.WORDS)] - np.logaddexp.reduce(a, 1)
    for i, w in enumerate(y.ravel()):
        if w < lm.WORDS:
            b = h[i].astype(np.float64) @ wide["Wi"][w // lm.EACH] + wide["bi"][w // lm.EACH]
            want[i] += b[w % lm.EACH] - np.logaddexp.reduce(b)
    assert np.allclose(lm.target_logs(p, h, y.ravel()), want, rtol=1e-3, atol=1e-3)
    (g, _), (double, _) = (lm.gradients(q, x, y, start, np.zeros((8, lm.HIDDEN), q["U"].dtype)) for q in (p, wide))
    for k in ("Wc", "bc", "Wi", "bi"):
        assert np.isfinite(g[k]).all() and np.allclose(g[k], double[k], rtol=0.02, atol=0.02 * np.abs(double[k]).max())


def test_sums_by_id():
    """Gradients of input words, those that come equally often in one block, are the plain sums."""
    rng = np.random.default_rng(9)
    for ids in (rng.zipf(1.3, 700) % 500, np.zeros(40, np.int64), np.arange(30)[::-1], np.array([7])):
        values = rng.normal(0, 1, (3, len(ids), lm.HIDDEN)).astype(np.float32)
        want = np.zeros((500, 3 * lm.HIDDEN))
        np.add.at(want, ids, values.transpose(1, 0, 2).reshape(len(ids), -1).astype(float))
        rows, sums = lm.sums_by_id(ids, values)
        assert sorted(rows.tolist()) == sorted(set(ids.tolist()))
        assert np.allclose(sums, want[rows], rtol=1e-4, atol=1e-4)


def test_training_lowers_the_loss(spark):
    lex = filled(spark)
    rng = np.random.default_rng(7)
    texts = [np.append(np.tile(rng.integers(1, 40, 2), 30), 0).astype(np.int32) for _ in range(200)]
    p = lm.fresh(lex, 3)
    q = lm.train_shard(p, texts[:150], 0.01, epochs=3, width=16)
    assert lm.score_texts(q, texts[150:]).sum() > 0.5 * lm.score_texts(p, texts[150:]).sum()


def test_language_model_of_odd_rows(spark):
    rows = odd(spark)
    got = lm.lm_scores(rows, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))).collect()
    assert len(got) == rows.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_tokens"] == by[1]["n_tokens"] == by[2]["n_tokens"] == 1
    assert all(math.isfinite(r["score"]) for r in got)
    assert lm.lm_scores(empty(spark), F.lit(True)).count() == 0
    assert lm.lm_scores(rows, F.lit(False)).where("train_tokens = 0 and n_known = 0").count() == rows.count()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "mixing", "packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, sf).cache()
    assert clean.columns == docs.columns and 0.8 * docs.count() < clean.count() < docs.count()
    one = corpus_pipeline.drop_near_copies(spark, clean, sf).cache()
    assert one.columns == docs.columns
    classes = jaccard.similarity_join(clean)
    assert sorted(r[0] for r in one.select("doc_id").collect()) == sorted(r[0] for r in classes.select("class_id").distinct().collect())
    assert jaccard.similarity_join(one).where("n_links > 0 or copies > 1").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, one, sf)
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.run(spark, sf)
    seqs = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert seqs.where("n != end or n > 4096").count() == 0


@pytest.mark.parametrize("operator", [jaccard.one_of_each, toxicity.held_out_fit, packing.token_pieces])
def test_texts_are_sent_in_small_batches(spark, sf, operator):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, more = spark.read.parquet(f"{sf}/documents.parquet"), {toxicity.held_out_fit: [spark.read.parquet(f"{sf}/labels.parquet")], packing.token_pieces: [queries.vocabulary("word_bpe_49k.json")]}
    spark.conf.unset(key)
    try:
        operator(docs, *more.get(operator, []))
        long = spark.range(0, 300, 1, 1).selectExpr("repeat('ab ', 40000) as text")
        sizes = [r[0] for r in long.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
        assert sum(sizes) > 300 * 120_000 and max(sizes) < 1.1 * common.SENT_BYTES
        spark.conf.set(key, "33m")
        operator(docs, *more.get(operator, []))
        assert spark.conf.get(key) == "33m"
    finally:
        spark.conf.unset(key)


def test_pipeline_of_clashing_names(spark, sf, tmp_path):
    """Columns named like the stages' own, and names with dots."""
    rows = odd(spark).limit(8)
    for c in ("_toxicity", "_keep_id", "_keep_key", "_rest", "_key", "doc", "a.b", "x`y"):
        rows = rows.withColumn(c, F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf)
        n = out.count()
        assert out.columns == rows.columns and (n > 0 or name == "toxicity"), name


def test_pipeline_of_odd_and_empty_tables(spark, sf):
    base = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in odd(spark).collect()], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (base, base.limit(0), base.withColumn("score", F.lit(1)).withColumn("size", F.lit("x"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns
            docs = out.cache()
        docs.count()
