"""N-gram Jaccard join with Bayesian candidate pruning: MinHash values compared step by step, survivors verified exactly."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import by_bytes, column, durable, one_thread, partitions, scratch, small_batches, text

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
BANDS, ROWS = 25, 5
HASHES = 128
#: Buckets that hold several classes are compared block by block: a block's nodes at most, about; BLOCK_SHINGLES bounds it too.
BUCKET_NODES = 256
#: All pairs inside a class are compared block by block: a block's nodes, the blocks that nodes alone ask for, and its shingles.
BLOCK_NODES, BLOCKS, BLOCK_SHINGLES = 128, 64, 1 << 18


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, HASHES, np.uint64) * 2 + 1, rng.integers(0, 1 << 63, HASHES, np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's runs of ``width`` lower-case words.

    A text of fewer words has one, of all its words; one without words has
    that of its raw characters, so that only equal ones agree.
    """

    def __init__(self, width: int, entries: int = 1 << 19) -> None:
        self.width, self.entries, self.known = width, entries, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words, ends = [], []
        for t in texts:
            words += _WORD.findall(t.lower())
            ends.append(len(words))
        distinct = set(words)
        fresh = distinct.difference(self.known)
        if len(self.known) + len(fresh) > self.entries:
            self.known.clear()
            fresh = distinct
        self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
        w = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        for x in fresh:
            if len(x) > 48:
                del self.known[x]
        runs = w[: max(0, len(w) - self.width + 1)].copy()
        for k in range(1, self.width):
            runs *= _MIX
            runs += w[k : k + len(runs)]
        runs ^= runs >> np.uint64(29)
        runs *= np.uint64(0xBF58476D1CE4E5B9)
        runs ^= runs >> np.uint64(32)
        out, start = [], 0
        for t, end in zip(texts, ends, strict=True):
            if end - start >= self.width:
                out.append(np.unique(runs[start : end - self.width + 1]))
            else:
                whole = "\0".join(words[start:end]) if end > start else "\1" + t.strip()
                out.append(np.array([xxhash.xxh3_64_intdigest(whole)], np.uint64))
            start = end
        return out


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(best, (a[:, None] * shingles[at : at + 512] + b[:, None]).min(1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


@lru_cache(maxsize=64)
def least_matches(threshold: float, tolerance: float, steps: tuple[int, ...]) -> list[int]:
    """For each number n of compared values, the least number m of matches that keeps a pair.

    With a uniform prior on the similarity s, its posterior after m of n
    matches is Beta(m + 1, n - m + 1), and P(s >= threshold) is the chance of m
    successes at most in n + 1 trials of the threshold.
    """
    out = []
    for n in steps:
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance or m == n:
                break
            m += 1
        out.append(m)
    return out


@dataclass
class Nodes:
    """members: (_row, id, _id, _key, _rest, node), one for each row; nodes: (node, _id, _key, rep_id, copies, sig), one for each distinct shingle set."""

    members: DataFrame
    nodes: DataFrame


def text_key(text_col: str, id_col: str) -> list[Column]:
    return [F.coalesce(column(id_col).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text(text_col)).alias("_key")]


def rest_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash of a row's other columns, which tells rows of one id and text apart."""
    others = [f for f in docs.schema.fields if f.name not in (id_col, text_col)]
    values = [F.to_json(F.struct(column(f.name).alias("v"))) if "map<" in f.dataType.simpleString() else column(f.name) for f in others]
    return F.xxhash64(F.lit(0), *values).alias("_rest")


def nodes(docs: DataFrame, id_col: str, text_col: str, width: int) -> Nodes:
    """Digests and MinHash signatures of all rows; rows with equal shingle sets become one node."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, (a, b) = Shingler(width), _coefficients()
        for batch in by_bytes(batches, "_text", 1 << 21):
            sets = shingle(batch.column(5).to_pylist())
            digest = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets]
            sig = [minhash(s, a, b).tobytes() for s in sets]
            more = [pa.array([int(d[0]) for d in digest], pa.int64()), pa.array([int(d[1]) for d in digest], pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], ["_row", "id", "_id", "_key", "_rest", "d1", "d2", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), column(id_col).alias("id"), *text_key(text_col, id_col), rest_key(docs, id_col, text_col), text(text_col).alias("_text"))
    signed = durable(rows.mapInArrow(sign, f"_row long, id {kind}, _id string, _key long, _rest long, d1 long, d2 long, sig binary"))
    groups = signed.groupBy("d1", "d2").agg(F.min("_row").alias("node"), F.min("id").alias("rep_id"), F.count("*").alias("copies"))
    members = signed.select("_row", "id", "_id", "_key", "_rest", "d1", "d2").join(groups.select("d1", "d2", "node"), ["d1", "d2"])
    first = signed.select(F.col("_row").alias("node"), "_id", "_key", "sig").join(groups.select("node", "rep_id", "copies"), "node")
    return Nodes(members.select("_row", "id", "_id", "_key", "_rest", "node"), durable(first))


def buckets(n: DataFrame) -> DataFrame:
    """(bucket, node) for each band of each signature, only of buckets with several nodes."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, HASHES)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _MIX + np.zeros((len(sig), 1), np.uint64)
            for k in range(ROWS):
                h = (h ^ sig[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(node)], ["bucket", "node"])

    all_bands = n.select("node", "sig").mapInArrow(bands, "bucket long, node long")
    shared = all_bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return all_bands.join(shared, "bucket")


def star_pairs(b: DataFrame) -> DataFrame:
    """Each bucket's nodes with one of them, chosen by a hash of bucket and node."""
    lead = b.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), "node")).alias("lead"))
    pairs = b.join(lead.select("bucket", F.col("lead.node").alias("lead_node")), "bucket").where(F.col("node") != F.col("lead_node"))
    return pairs.select(F.least("node", "lead_node").alias("a"), F.greatest("node", "lead_node").alias("b")).distinct()


def mixed_buckets(met: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, node, label, main) of the buckets whose nodes aren't all of one class; main: the class of most of them.

    The one pair of a bucket of two nodes was compared as that of its leader.
    """
    named = met.join(label, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("k"), F.sum("m").alias("n")).where("k > 1 and n > 2").select("bucket", "main")
    return named.join(mixed, "bucket")


def bucket_blocks(mixed: DataFrame, sig: DataFrame, sets: DataFrame) -> DataFrame:
    """(seek, other): pairs of blocks of a bucket, so that every two of its nodes of different classes are in one; other is null where a block is met with itself.

    One of two nodes of different classes is outside the bucket's main class:
    blocks of those seek, and are met among themselves as on a circle and with
    the blocks of the main class, which aren't met with each other. So what is
    sent grows with the nodes times those outside the main class. A bucket may
    have any number of blocks.
    """
    sides = mixed.join(sets.select("node", "size"), "node").withColumn("seeks", F.col("label") != F.col("main"))
    sizes = sides.groupBy("bucket").agg(*[F.sum(F.when(F.col("seeks") == s, v)).alias(n) for n, s, v in (("s", True, F.lit(1)), ("s_size", True, F.col("size")), ("t", False, F.lit(1)), ("t_size", False, F.col("size")))])
    ks, kt = (F.least(F.greatest(F.ceil(F.col(c) / BUCKET_NODES), F.ceil(F.col(f"{c}_size") / BLOCK_SHINGLES)), F.col(c)).cast("int").alias(n) for c, n in (("s", "ks"), ("t", "kt")))
    dealt = sides.join(sizes.select("bucket", ks, kt), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("seeks"), F.col("ks")).otherwise(F.col("kt"))).cast("int"))
    dealt = dealt.drop("size").join(sig.select("node", "sig"), "node").join(sets, "node")
    blocks = durable(dealt.groupBy("bucket", "ks", "kt", "seeks", "block").agg(F.collect_list(F.struct("node", "label", "sig", "shingles")).alias("held")))
    seek, main = blocks.where("seeks"), blocks.where("not seeks").select("bucket", "block", F.col("held").alias("other"))
    gap = F.explode(F.expr("sequence(1, ks div 2)"))
    sent = seek.where("ks > 1").select("bucket", "ks", "block", "held", gap.alias("gap")).where("gap * 2 < ks or block < gap")
    sent = sent.select("bucket", ((F.col("block") + F.col("gap")) % F.col("ks")).alias("block"), F.col("held").alias("other"))
    among = seek.select("bucket", "block", "held").join(sent, ["bucket", "block"]).select("held", "other")
    across = seek.select("bucket", "held", F.explode(F.expr("sequence(0, kt - 1)")).alias("block")).join(main, ["bucket", "block"]).select("held", "other")
    return seek.select("held", F.lit(None).cast(blocks.schema["held"].dataType).alias("other")).unionByName(among).unionByName(across)


def pruned_places(x: np.ndarray, y: np.ndarray, alive: tuple[np.ndarray, np.ndarray], threshold: float, tolerance: float, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (place in x, place in y), those that the comparison of their signatures, ``step`` values at a time, doesn't rule out."""
    (i, j), matches = alive, np.zeros(len(alive[0]), np.int64)
    steps = tuple(range(step, HASHES + 1, step))
    for at, least in zip(steps, least_matches(threshold, tolerance, steps), strict=True):
        for low in range(0, len(i), 1 << 18):
            part = slice(low, low + (1 << 18))
            matches[part] += (x[i[part], at - step : at] == y[j[part], at - step : at]).sum(1)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def class_bridges(blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b, jaccard, la, lb): links between nodes of different classes, as many as bring a pair of blocks' classes together.

    A pair of blocks gives one link fewer than it has classes at most, however
    many of its pairs are linked: pairs whose classes are together already are
    left to the count of links inside a class.
    """

    def bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held, other = (batch.column(c)[k].as_py() for c in (0, 1))
                x, itself = held, other is None
                y = held if itself else other
                sx, sy = (np.frombuffer(b"".join(r["sig"] for r in side), "<u4").reshape(-1, HASHES) for side in (x, y))
                lx, ly = (np.array([r["label"] for r in side], np.int64) for side in (x, y))
                i, j = pruned_places(sx, sy, np.nonzero(np.triu(lx[:, None] != ly, 1) if itself else lx[:, None] != ly), threshold, tolerance)
                root: dict[int, int] = {}

                def find(v: int, root: dict[int, int] = root) -> int:
                    while (up := root.get(v, v)) != v:
                        v = up
                    return v

                out = []
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = find(int(lx[a])), find(int(ly[b]))
                    if p != q and (s := jaccard(x[a]["shingles"], y[b]["shingles"])) >= threshold:
                        root[max(p, q)] = min(p, q)
                        u, v = (x[a], y[b]) if x[a]["node"] < y[b]["node"] else (y[b], x[a])
                        out.append((u["node"], v["node"], s, u["label"], v["label"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "b", "jaccard", "la", "lb"])

    return blocks.mapInArrow(bridge, "a long, b long, jaccard double, la long, lb long")


def jaccard(x: bytes, y: bytes) -> float:
    """Of two sorted sets of hashes."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(u, v, assume_unique=True))
    return both / (len(u) + len(v) - both)


def verified(pairs: DataFrame, n: DataFrame, sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach the threshold: pruned by their signatures step by step, then compared by their sets."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, HASHES) for k in (2, 3))
            all_of = np.arange(len(x))
            alive = pa.array(pruned_places(x, y, (all_of, all_of), threshold, tolerance)[0])
            yield pa.RecordBatch.from_arrays([batch.column(k).take(alive) for k in (0, 1)], ["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([jaccard(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
            reach = pa.array(np.flatnonzero(s >= threshold))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(reach) for k in (0, 1)), pa.array(s).take(reach)], ["a", "b", "jaccard"])

    def beside(p: DataFrame, table: DataFrame, col: str) -> DataFrame:
        p = p.join(table.select(F.col("node").alias("a"), F.col(col).alias("x")), "a")
        return p.join(table.select(F.col("node").alias("b"), F.col(col).alias("y")), "b").select("a", "b", "x", "y")

    left = beside(pairs, n, "sig").mapInArrow(prune, "a long, b long")
    return beside(left, sets, "shingles").mapInArrow(exact, "a long, b long, jaccard double")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node one node of its connected component, the same for all of the component.

    Each round hooks every vertex to the neighbour (or itself) that hashes
    lowest in this round, jumps from there to that one's own hook, and
    contracts: the next round's edges join what is left, without loops and
    repeats, so that rounds shrink, chains of links too.
    """
    labels, left, turn = None, edges.select("a", "b"), 0
    while True:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["v"].alias("to"))
        hook = durable(hook)
        hook = hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
        if labels is None:
            labels = hook.withColumnRenamed("to", "label")
        else:
            labels = labels.join(hook.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        ends = [hook.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"]
        left = left.join(ends[0], "a").join(ends[1], "b").where("to_a != to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        left, labels, turn = durable(left), durable(labels), turn + 1
        if left.isEmpty():
            return labels


def overlaps(x: list[np.ndarray], y: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """The number of shingles that each set of ``x`` shares with each of ``y`` (None: with the others of ``x``; the diagonal is then meaningless)."""
    u = np.concatenate(x)
    if y is None:
        known, count = np.unique(u, return_counts=True)
        known, sides = known[count > 1], [x]
    else:
        known, sides = np.intersect1d(u, np.concatenate(y)), [x, y]
    placed = []
    for side in sides:
        all_of, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.searchsorted(known, all_of)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == all_of) if len(known) else np.zeros(0, np.int64)
        hit = hit[np.argsort(at[hit], kind="stable")]
        placed.append((at[hit], owner[hit], len(side)))
    out = np.zeros((len(x), len(sides[-1])))
    for start in range(0, len(known), width):
        dense = []
        for at, owner, n in placed:
            lo, hi = np.searchsorted(at, [start, start + width])
            d = np.zeros((n, min(width, len(known) - start)), np.float32)
            d[owner[lo:hi], at[lo:hi] - start] = 1
            dense.append(d)
        out += dense[0] @ dense[-1].T
    return out


def class_blocks(named: DataFrame, sets: DataFrame) -> DataFrame:
    """(held, other): pairs of blocks of a class, so that every two nodes of a class with pairs not yet linked are in one pair of blocks; other is null where a block is met with itself.

    ``named``: (node, label, n_links, size), n_links counted from verified
    links. Classes whose pairs are all linked already are left out if they
    fit one block. Blocks are dealt by a hash of the node, and met as on a circle, so that a
    block is sent to half of the others. A row is a block: at most about
    ``BLOCK_SHINGLES`` hashes, or one set.
    """
    sizes = named.groupBy("label").agg(F.count("*").alias("m"), F.sum("size").alias("total"), F.sum("n_links").alias("ends"))
    k = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.least(F.ceil(F.col("m") / BLOCK_NODES), F.lit(BLOCKS)))
    sizes = sizes.withColumn("k", F.least(k, F.col("m")).cast("int"))
    large = sizes.where("k > 1").select("label", "k")  # grows with the corpus: Spark broadcasts it by its size or doesn't
    dealt = named.select("node", "label").join(large, "label", "left")
    small = dealt.where("k is null").drop("k").join(sizes.where("k = 1 and ends < m * (m - 1)").select("label", "k"), "label")
    dealt = dealt.where("k is not null").select("node", "label", "k").unionByName(small.select("node", "label", "k"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).join(sets.select("node", "shingles"), "node")
    blocks = durable(dealt.groupBy("label", "k", "block").agg(F.collect_list(F.struct("node", "shingles")).alias("held")))
    gap = F.explode(F.expr("sequence(1, k div 2)"))
    sent = blocks.where("k > 1").select("label", "k", "block", "held", gap.alias("gap")).where("gap * 2 < k or block < gap")
    sent = sent.select("label", ((F.col("block") + F.col("gap")) % F.col("k")).alias("block"), F.col("held").alias("other"))
    met = blocks.select("label", "block", "held").join(sent, ["label", "block"]).select("held", "other")
    return blocks.select("held", F.lit(None).cast(blocks.schema["held"].dataType).alias("other")).unionByName(met)


def _blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple]:
    """(nodes of the rows, nodes of the columns, Jaccard similarities, links) for each pair of blocks."""
    one_thread()
    for batch in batches:
        for i in range(batch.num_rows):
            held, other = (batch.column(c)[i].as_py() for c in (0, 1))
            ids = [np.array([r["node"] for r in side], np.int64) for side in (held, other or held)]
            x = [np.frombuffer(r["shingles"], np.uint64) for r in held]
            y = x if other is None else [np.frombuffer(r["shingles"], np.uint64) for r in other]
            both = overlaps(x, None if other is None else y)
            sim = both / (np.array([[len(s)] for s in x]) + np.array([len(s) for s in y]) - both)
            linked = sim >= threshold
            if other is None:
                np.fill_diagonal(linked, False)
            yield ids[0], ids[1], sim, linked, other is None


def class_degrees(blocks: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links): with how many nodes of its class each node of ``class_blocks`` reaches the threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, _, linked, itself in _blocks(batches, threshold):
            node, n = (x, linked.sum(1)) if itself else (np.concatenate([x, y]), np.concatenate([linked.sum(1), linked.sum(0)]))
            yield pa.RecordBatch.from_arrays([pa.array(node[n > 0]), pa.array(n[n > 0].astype(np.int64))], ["node", "n_links"])

    return blocks.mapInArrow(count, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def class_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard): the pairs that ``class_degrees`` counts."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, sim, linked, itself in _blocks(batches, threshold):
            i, j = np.nonzero(np.triu(linked) if itself else linked)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[i], y[j])), pa.array(np.maximum(x[i], y[j])), pa.array(sim[i, j])], ["a", "b", "jaccard"])

    return blocks.mapInArrow(pairs, "a long, b long, jaccard double")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, tolerance: float = 1e-5, id_col: str = "doc_id", text_col: str = "text", count: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Classes of texts linked by a Jaccard similarity of at least ``threshold`` over runs of ``width`` words.

    Returns the rows (_row, id, _id, _key, _rest, class_id, class_row, copies,
    n_links), one for each of ``docs``, and the links between representatives
    (a, b, jaccard). class_id: the least id of the class. copies: rows with
    the same shingle set. n_links: to how many other representatives that set's
    representative is linked, all pairs of a class counted; the links are all
    of these pairs. Without ``count`` both keep to the links that the classes
    were found by.

    Rows with equal sets count as one node. Buckets of MinHash bands (a pair
    of similarity s meets with probability 1 - (1 - s^5)^25) are not expanded
    into all pairs: first, each bucket's nodes are compared with one of them,
    another in each of the 25 bands. Buckets that links haven't brought into
    one class are then compared block by block, nodes outside the bucket's
    main class with all others; signatures are compared and sets verified
    where the blocks are, and only links that join classes leave them. So no
    two linked texts that share a bucket stay apart.

    Null and empty texts have the set of an empty text and are copies of each
    other; texts without words agree only where equal; repeated rows are
    copies; a null id takes part, a class of null ids only has a null
    class_id; an empty table gives empty results; other columns are not read.
    """
    small_batches(docs.sparkSession)
    found = nodes(docs, id_col, text_col, width)
    met = durable(buckets(found.nodes))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in by_bytes(batches, "_text", 1 << 21):
            found = shingle(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64())], ["node", "shingles", "size"])

    wanted = met.select("node").distinct().join(found.nodes.select("node", "_id", "_key"), "node")
    whole = docs.select(*text_key(text_col, id_col), text(text_col).alias("_text")).join(wanted, ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    sets = durable(whole.select("node", "_text").mapInArrow(shingles, "node long, shingles binary, size long"))

    links = durable(verified(star_pairs(met), found.nodes, sets, threshold, tolerance))
    label = components(links)
    mixed = durable(mixed_buckets(met, label))
    if not mixed.isEmpty():
        bridges = durable(class_bridges(bucket_blocks(mixed, found.nodes, sets).repartition(partitions(docs.sparkSession)), threshold, tolerance))
        merged = components(bridges.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("to"))
        links = links.unionByName(bridges.select("a", "b", "jaccard")).dropDuplicates(["a", "b"])
        ends = [bridges.select(F.col(c).alias("node"), F.col(f"l{c}").alias("label")) for c in "ab"]
        named = label.unionByName(ends[0]).unionByName(ends[1]).distinct()
        label = durable(named.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")))

    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    if count:  # pairs inside a class that no step above had to compare
        named = durable(label.join(degree, "node").join(sets.select("node", "size"), "node"))
        blocks = class_blocks(named, sets).repartition(partitions(docs.sparkSession))
        whole = class_degrees(blocks, threshold).withColumnRenamed("n_links", "all_links")
        degree = named.select("node", "n_links").join(whole, "node", "left").select("node", F.coalesce("all_links", "n_links").alias("n_links"))
        links = links.unionByName(class_links(blocks, threshold)).dropDuplicates(["a", "b"])
    linked = label.join(degree, "node").join(found.nodes.select("node", "rep_id"), "node")
    lowest = linked.groupBy("label").agg(F.min("rep_id").alias("class_id"))
    classes = linked.join(lowest, "label").select("node", "label", "class_id", "n_links")
    classes = found.nodes.select("node", "rep_id", "copies").join(classes, "node", "left").select(
        "node", "copies", F.coalesce("label", "node").alias("class_row"), F.when(F.col("label").isNull(), F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    rows = found.members.join(classes, "node").select("_row", "id", "_id", "_key", "_rest", "class_id", "class_row", "copies", "n_links")
    return rows, links


def classes(docs: DataFrame, **more) -> DataFrame:
    """The rows of ``near_duplicates`` as a table of their own; what led to them is deleted."""
    with scratch(docs.sparkSession):
        return durable(near_duplicates(docs, **more)[0], keep=True)


def similarity_join(docs: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """(id, class_id, copies, n_links) for every row; see ``near_duplicates``."""
    rows = classes(docs, id_col=id_col, **more)
    return rows.select(F.col("id").alias(id_col), "class_id", "copies", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with one row of each class, the one with the least id (null last); of rows with one id and text, the one whose other columns hash lowest."""
    rows = classes(docs, id_col=id_col, text_col=text_col, count=False, **more)
    key = ["_id", "_key", "_rest"]
    stay = rows.groupBy("class_row").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *key)).alias("r")).select(*[F.col(f"r.{k}") for k in key])
    whole = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("doc"), *text_key(text_col, id_col), rest_key(docs, id_col, text_col))
    kept = whole.join(stay, key, "left_semi").dropDuplicates(key)
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
