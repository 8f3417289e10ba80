"""Token counts, media, toxicity, licences, sharding and packing against brute force, on the small tables and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from galeframe.llm import licenses, media, packing, queries, sharding, tokens, toxicity
from tests.llm.helpers import empty, odd, words

pub = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def whole(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pub.path(name))


def test_token_counts_match_whole_texts(spark, sf, docs):
    t = whole("byte_bpe_50k.json")
    got = queries.op9_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(t.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)


def test_token_counts_of_odd_rows(spark):
    t = whole("byte_bpe_50k.json")
    rows = odd(spark)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(rows, pub.path("byte_bpe_50k.json"), batch_bytes=100, cache_entries=50).collect())
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows.collect())
    assert got == want
    assert tokens.token_counts(empty(spark), pub.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("text", ["a  b   c\n\n d\t\te ", " lead", "!\x1c x\x1c y", "a\xa0 b \xa0c", "it's we'll\n 12 34", "x" * 300 + " y", "᠎ a   b", "é ́ q", "  <|endoftext|>  z"])
def test_units_are_safe(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = whole(name)
        assert sum((t.encode(u, add_special_tokens=False).ids for u in tokens.safe_units(text)), []) == t.encode(text, add_special_tokens=False).ids
    assert "".join(tokens.safe_units(text)) == text
    t = whole("word_bpe_49k.json")
    assert sum((t.encode(u, add_special_tokens=False).ids for u in tokens.visible_units(text)), []) == t.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, capacity):
    t = whole("word_bpe_49k.json")
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for key, many in texts.items():
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[key])
        want = []
        for text in many:
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
            want += [(k, k * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[i : i + capacity] for i in range(0, len(ids), capacity))]
        assert got == sorted(want)
    for many in by_seq.values():
        at = 0
        for r in sorted(many, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    return len(by_seq), -(-total // capacity)


def test_packing(spark, sf, docs):
    rows = queries.op5_packing(spark, sf).collect()
    used, least = check_packing(rows, {k: [v] for k, v in docs.items()}, 4096)
    assert used <= least + 2


def test_packing_of_odd_rows(spark):
    rows = odd(spark)
    texts = defaultdict(list)
    for r in rows.collect():
        texts[r["doc_id"]].append(r["text"])
    check_packing(packing.pack_documents(rows, pub.path("word_bpe_49k.json"), capacity=64).collect(), texts, 64)
    assert packing.pack_documents(empty(spark), pub.path("word_bpe_49k.json")).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_bulk_best_fit_is_near_best_fit_decreasing(spark):
    rng = np.random.default_rng(3)
    for high, n, capacity in ((41, 150, 40), (400, 300, 1000), (3, 200, 40), (700, 120, 1000)):
        lengths = rng.integers(1, high, n).tolist()
        runs = packing.best_fit(spark.createDataFrame(list(Counter(lengths).items()), "length long, n long"), capacity).collect()
        placed, ranks = defaultdict(list), defaultdict(list)
        for r in runs:
            for i in range(r["n"] * r["each"]):
                placed[r["sequence"] + i // r["each"]].append((capacity - r["gap"] + i % r["each"] * r["length"], r["length"]))
                ranks[r["length"]].append(r["rank"] + i)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in Counter(lengths).items()}
        for parts in placed.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(placed) == list(range(len(placed)))
        assert len(placed) <= best_fit_decreasing(lengths, capacity) + 1


def test_ids_of_all_latin_letters():
    """Words of all letters up to U+024F with marks, contractions, special strings and odd spaces: ids as the library gives them."""
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()] + list("\u0130\u0130\u03a3\u03c2\ufb01\u6f22\u04390123")
    marks = list(".,;:!?&#*%$)]}+=-_/@~^\"'")
    word = lambda: "".join(rng.choices(letters, k=rng.randint(0, 6))) + "".join(rng.choices(marks, k=rng.choice([0, 0, 1, 2, 4]))) + rng.choice(["", "'s", "\u0301", "<|endoftext|>", ""])
    texts = [" ".join(word() for _ in range(rng.randint(0, 12))) + rng.choice(["", " ", "\t x", "\u0085"]) for _ in range(8000)] + ["\u0130.", "", "  "]
    for name, lower in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        encode = tokens.UnitEncoder(open(pub.path(name)).read(), packing.id_bytes if lower else len, 1 << 20, 1 << 16, lower)
        for at in range(0, len(texts), 1000):
            some = texts[at : at + 1000]
            want = [e.ids for e in whole(name).encode_batch(some, add_special_tokens=False)]
            if lower:
                ids, ends = packing.ids_of(packing.words_of(pa.array(some)), encode)
                assert [p.tolist() for p in np.split(ids, ends)[:-1]] == want
            else:
                assert [sum(encode(tokens.safe_units(t))) for t in some] == list(map(len, want))


def test_each_part_of_words_is_looked_up_once():
    """Words that differ in case and closing marks share what is encoded; a word that ends otherwise is looked up whole."""
    encode, seen = tokens.UnitEncoder(open(pub.path("word_bpe_49k.json")).read(), packing.id_bytes, 1 << 20, 1 << 16, True), []
    texts = ["Word, word; WORD word", "", "don't. Don't!! \u00c9t\u00e9, \u00e9t\u00e9 x1, ,,"]
    ids, ends = packing.ids_of(packing.words_of(pa.array(["zzz", *texts])[1:]), lambda units: (seen.extend(units), encode(units))[1])
    assert sorted(seen) == sorted(["word", "don't", "Don't", "\u00e9t\u00e9", "x1,", ",,", "", ",", ";", ".", "!!", ""])  # the empty text is a word, and words without marks have empty ones
    assert [p.tolist() for p in np.split(ids, ends)[:-1]] == [e.ids for e in whole("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    assert [a.tolist() for a in packing.ids_of(packing.words_of(pa.array([], pa.string())), encode)] == [[], []]


def test_media_round_trip(spark, sf, docs):
    rows = queries.op10_media(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["feature"] and r["media_sha256"]


def test_media_odd_rows_and_clips(spark):
    rows = odd(spark)
    f = media.media_features(media.store_avi(rows))
    assert f.where("error is not null").count() == 0 and f.count() == rows.count()
    clips = media.clip_rows(f).collect()
    assert all(c["end_ms"] > c["start_ms"] for c in clips)
    bad = spark.createDataFrame([(1, b"RIFFxxxx"), (2, None), (3, b"RIFF\x04\0\0\0AVI ")], "doc_id int, media binary")
    assert media.media_features(bad).where("error is not null and media_sha256 is null").count() == 3
    assert media.media_features(media.store_avi(empty(spark))).count() == 0


def test_frames_and_shots():
    rng = np.random.default_rng(5)
    for h in (1, 2, 63, 64):
        for x in (rng.integers(0, 256, (h, 64)), np.zeros((h, 64)), np.full((h, 64), 255)):
            data = media.encode_frame(x.astype(np.uint8))
            assert (media.decode_frame(data) == x).all()
            # the same stream under a table that the decoder doesn't know by sight
            slow = data.replace(media._TABLE, media._TABLE[:2] + bytes([0, 20 + 9]) + media._TABLE[4:] + b"\x09")
            slow = slow.replace(bytes([1] * 9 + [0] * 7), bytes([1] * 9 + [1] + [0] * 6))
            assert (media.decode_frame(slow) == x).all()
    frames = [np.full((8, 64), 34 + i, np.uint8) for i in range(10)] + [np.full((8, 64), 200, np.uint8)] * 5
    assert media.shots(frames)[0][-1] == 10
    with pytest.raises(ValueError):
        media.decode_frame(b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xd9")


def check_shards(rows, n_shards, slack):
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) <= set(range(n_shards))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    total, most = sum(size.values()), max(r["size"] for r in rows)
    for s in range(n_shards):
        assert abs(size[s] - total / n_shards) <= most + slack * total / n_shards


def test_sharding(spark, sf, docs):
    rows = queries.op6_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    check_shards(rows, 40, 0.01)


def test_sharding_cuts_a_hot_group(spark):
    same = words(20, 9)
    rows = [(i, same if i % 3 else words(20, i)) for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=40).collect()
    check_shards(got, 40, 0.01)
    assert sharding.shard_documents(odd(spark), shards=3).count() == odd(spark).count()
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_toxicity_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.1")  # some 800 held-out rows
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op7_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in y]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = sum(r["predicted"] == y[r["doc_id"]] for r in rows)
    assert right / len(rows) > 0.95
    pos, neg = np.array([r["score"] for r in rows if y[r["doc_id"]]]), np.array([r["score"] for r in rows if not y[r["doc_id"]]])
    assert np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)) > 0.9


def test_toxicity_learns_a_pair_that_no_sum_separates():
    # toxic only where both or neither occur: additive weights reach 3 of 4 at most
    rows = [([0, 1], 1), ([0], 0), ([1], 0), ([], 1)] * 50
    fm = toxicity.train(rows, np.array([5, 9]), 20, 4, 800, 1)
    p = fm.raw(np.array([[0, 1], [0, 2], [1, 2], [2, 2]]))
    assert (p > 0).tolist() == [True, False, False, True]


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, None), (None, 1), (6, 0), (6, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(odd(spark), toxicity.fit(odd(spark), labels))
    assert got.count() == odd(spark).count() and got.where("score between 0 and 1").count() == got.count()
    none = toxicity.fit(empty(spark), labels.limit(0))
    assert toxicity.toxicity_scores(empty(spark), none).count() == 0
    assert toxicity.toxicity_scores(odd(spark), none).where("score < 0.6").count() == odd(spark).count()


def test_license_spans(spark):
    """Wrapped notices, sentences inside longer lines and whole licences in longer texts: lines and whole texts miss them."""
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    prose = [words(300, 90 + i) for i in range(12)]
    wrapped = [(k, f"{prose[0]}\n{wrap(licenses.TEMPLATES[k], 8)}\n{prose[1]}") for k in ("MIT-notice", "GPL-3.0-notice", "BSD-3-Clause", "ISC")]
    inline = [("CC-BY-NC-4.0", f"{prose[2]} licensed under CC BY-NC 4.0. {prose[3]}"), ("Unlicense", f"{prose[4]} {licenses.TEMPLATES['Unlicense']} {prose[5]}")]
    full = [(k, f"{prose[6]}\n\n{t}\n{prose[7]}") for k, t in licenses.FULL_TEXTS.items()]
    cases = [*wrapped, *inline, *full]
    rows = spark.createDataFrame([*[(i, t) for i, (_, t) in enumerate(cases)], (100, None), (101, prose[8]), (102, "Released under the MIT License.")], "doc_id long, text string")
    before = {(r["doc_id"], r["license"]) for r in licenses.license_scan(rows).collect()}
    got = {(r["doc_id"], r["license"]): r for r in licenses.license_spans(rows).collect()}
    for i, (k, t) in enumerate(cases):
        assert (i, k) not in before and got[(i, k)]["unit"] == -2 and got[(i, k)]["dice"] >= (0.97 if k in licenses.FULL_TEXTS else 1.0), k
    assert got[(102, "MIT")]["unit"] == -1 and before <= set(got) and not {100, 101} & {i for i, _ in got}
    assert licenses.license_spans(odd(spark)).count() == 0 and licenses.license_spans(empty(spark)).count() == 0


def test_licenses(spark):
    rows = [(1, "Some prose here.\nReleased under the MIT License.\nMore prose."), (2, None), (3, ""), (4, "licensed under the apache license version 2.0"), (5, "a prose text about a licence"), (4, "x"), (6, "Released under the MIT License.\n" * 400)]
    got = {(r["doc_id"], r["license"]): (r["unit"], r["dice"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[(1, "MIT")] == (1, 1.0) and got[(4, "Apache-2.0")] == (-1, 1.0) and (6, "MIT") in got
    assert {k[0] for k in got} == {1, 4, 6}
    assert licenses.license_scan(odd(spark)).count() == 0 and licenses.license_scan(empty(spark)).count() == 0


def test_repeated_rows_are_cut_among_shards(spark):
    """400 rows of one id and text and one other: the law holds though nothing but the row tells them apart."""
    rows = spark.createDataFrame([(7, "the same words")] * 400 + [(8, "others")], "doc_id long, text string").repartition(3)
    got = sharding.shard_documents(rows).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    each = 14 + 16
    assert len(got) == 401 and len(size) == 40 and max(size.values()) - min(size.values()) <= 2 * each
    for k in size:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def brute_chi2(sample, least, kept):
    """Buckets of the labelled texts that chi-squared keeps, by plain counting."""
    n, p, df, pos = len(sample), sum(y for _, y in sample), Counter(), Counter()
    for terms, y in sample:
        df.update(terms)
        if y:
            pos.update(terms)
    score = {}
    for b, d in df.items():
        a = pos[b]
        if 3 <= d < n:
            score[b] = n * (a * (n - p) - (d - a) * p) ** 2 / (d * (n - d) * max(p, 0.5) * max(n - p, 0.5))
    best = sorted((b for b, c in score.items() if c >= least), key=lambda b: (-score[b], b))[:kept]
    return sorted(best)


def test_toxicity_terms_and_scores_by_plain_python(spark, sf, docs):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None}
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.held_out_fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    terms = lambda t: {b for w in set(toxicity._WORD.findall(t.lower())) for b in toxicity.hashed_terms(w, 20)}
    sample = [(terms(docs[k]), y) for k, y in labels.items() if k in docs and zlib.crc32(str(k).encode()) % 5]
    assert model.buckets.tolist() == brute_chi2(sample, 12.0, 4096)
    place = {int(b): i for i, b in enumerate(model.buckets)}
    for r in toxicity.toxicity_scores(table, model).collect():
        at = [place[b] for b in terms(docs[r["doc_id"]]) if b in place]
        pairs = sum(float(model.v[i] @ model.v[j]) for n, i in enumerate(at) for j in at[:n]) if len(at) < 40 else None
        if pairs is not None:
            assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.bias + model.w[at].sum() + pairs))), rel=1e-6)


def test_toxicity_sample_is_bounded_where_ids_repeat(spark):
    rows = spark.createDataFrame([(1, f"you idiot {i}") for i in range(300)] + [(2, f"good day {i}") for i in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    seen = []
    whole = toxicity.train
    try:
        toxicity.train = lambda rows, *more: seen.append(len(rows)) or whole(rows, *more)
        toxicity.fit(rows, marks, sample_rows=50)
    finally:
        toxicity.train = whole
    assert seen == [50]


def test_licenses_match_their_sql(spark, sf):
    from tests.compare import difference

    assert difference(queries.op8_licenses(spark, sf), queries.SQL["op8_licenses"], sf) == ""
