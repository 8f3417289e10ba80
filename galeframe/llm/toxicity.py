"""Toxicity: a factorization machine over hashed terms, trained on a bounded sample of labelled rows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import column, durable, fold, small_batches, text

_WORD = re.compile(r"\w+")
STEMS = (4, 5)


def hashed_terms(word: str, bits: int) -> tuple[int, ...]:
    """Buckets of a word and of its longer stems: languages that compound and inflect rarely repeat a whole word."""
    parts = [word.encode(), *(b"^" + word[:n].encode() for n in STEMS if len(word) > n)]
    return tuple(zlib.crc32(p) & ((1 << bits) - 1) for p in parts)


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of w_i + half the sum over factors of (sum v_i)^2 - sum v_i^2), i over a text's distinct kept buckets."""

    buckets: np.ndarray  # sorted, of 2^bits
    bits: int
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, active: np.ndarray) -> np.ndarray:
        """active: (rows, width) places in ``buckets``, padded with len(buckets), whose weights are 0."""
        s = self.v[active].sum(1)
        return self.bias + self.w[active].sum(1) + 0.5 * (s * s - (self.v[active] ** 2).sum(1)).sum(1)


def train(rows: list[tuple[list[int], int]], buckets: np.ndarray, bits: int, factors: int, steps: int, seed: int) -> FactorizationMachine:
    """Adam on the logistic loss with weight decay; rows: (places in buckets, label)."""
    rng, n = np.random.default_rng(seed), len(buckets)
    y = np.array([r[1] for r in rows], float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    fm = FactorizationMachine(buckets, bits, float(np.log(rate / (1 - rate))), np.zeros(n + 1), rng.normal(0, 0.03, (n + 1, factors)))
    fm.v[n] = 0
    if not n or not len(rows):
        return fm
    size = np.array([len(r[0]) for r in rows])
    flat, first = np.concatenate([np.array(r[0], np.int64) for r in rows]), np.cumsum(size) - size
    m = [np.zeros(()), np.zeros_like(fm.w), np.zeros_like(fm.v)]
    q = [np.zeros(()), np.zeros_like(fm.w), np.zeros_like(fm.v)]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(rows), min(512, len(rows)))
        k = size[pick]
        row = np.repeat(np.arange(len(pick)), k)  # of each active place of the batch
        a = flat[np.arange(k.sum()) + np.repeat(first[pick] - np.cumsum(k) + k, k)]
        by_row = lambda x: np.bincount(row, x, len(pick))  # noqa: B023, E731
        by_place = lambda x: np.bincount(a, x, n + 1)  # noqa: B023, E731
        vs = fm.v[a]
        s = np.stack([by_row(vs[:, f]) for f in range(factors)], 1)
        raw = fm.bias + by_row(fm.w[a]) + 0.5 * ((s * s).sum(1) - by_row((vs * vs).sum(1)))
        err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / len(pick)
        e = err[row]
        gw = by_place(e)
        gv = np.stack([by_place(e * (s[row, f] - vs[:, f])) for f in range(factors)], 1)
        grads = [err.sum(), gw + 1e-5 * fm.w, gv + 1e-5 * fm.v]
        for k, g in enumerate(grads):
            m[k], q[k] = 0.9 * m[k] + 0.1 * g, 0.999 * q[k] + 0.001 * g * g
            move = 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
            if k == 0:
                fm.bias -= float(move)
            elif k == 1:
                fm.w -= move
            else:
                fm.v -= move
        fm.w[n], fm.v[n] = 0, 0
    return fm


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000,
    bits: int = 20, kept: int = 4096, least_chi2: float = 12.0, factors: int = 8, steps: int = 600, seed: int = 7,
) -> FactorizationMachine:
    """Learn from at most ``sample_rows`` labelled rows, those whose ids hash lowest.

    The sample's size is the bound of what is broadcast (ids and labels) and of
    what the driver trains on. Chi-squared against the label keeps at most
    ``kept`` of the 2^bits buckets, above ``least_chi2`` (about a chance of
    5e-4), so that the noise of long texts doesn't add up. Rows with a null
    label or id, labels without a document and documents without a label are
    not used; a document labelled twice counts twice. Of rows that repeat an
    id in ``docs`` the sample takes each, but no more than ``sample_rows`` in
    all, those whose texts hash lowest. Without usable rows the model is its
    bias alone, below one half.
    """
    small_batches(docs.sparkSession)
    y = column(label_col).cast("int")
    chosen = labels.where(y.isNotNull() & column(id_col).isNotNull()).select(column(id_col).alias("_l"), (y > 0).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_l", F.lit(seed)), "_l", "_y").limit(sample_rows)
    known = docs.select(column(id_col).alias("_id"), text(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_l"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sorted({b for w in set(_WORD.findall(t.lower())) for b in hashed_terms(w, bits)}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["terms", "y", "h"])

    sample = known.select("_text", "_y", F.xxhash64("_id", "_text", F.lit(seed)).alias("_h")).mapInArrow(terms, "terms array<int>, y int, h long")
    sample = durable(sample.withColumn("row", F.monotonically_increasing_id()))
    told = lambda: sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    total = told()
    if total["n"] > sample_rows:  # ids repeat
        sample = durable(sample.orderBy("h", "y", "row").limit(sample_rows))
        total = told()
    n, p = float(total["n"]), float(total["p"])
    # 2x2 table of a bucket against the label, with a of its df rows positive
    a, df = F.col("a").cast("double"), F.col("df").cast("double")
    chi2 = n * F.pow(a * (n - p) - (df - a) * p, F.lit(2.0)) / (df * (n - df) * F.lit(max(p, 0.5)) * F.lit(max(n - p, 0.5)))
    counts = sample.select(F.explode("terms").alias("b"), "y").groupBy("b").agg(F.sum("y").alias("a"), F.count("*").alias("df"))
    best = counts.where((F.col("df") >= 3) & (df < n)).select("b", chi2.alias("chi2")).where(F.col("chi2") >= least_chi2)
    buckets = np.array(sorted(r["b"] for r in best.orderBy(F.desc("chi2"), "b").limit(kept).collect()), dtype=np.int64)
    place = {int(b): i for i, b in enumerate(buckets)}
    held = F.array_intersect("terms", F.split(F.lit(",".join(map(str, buckets))), ",").cast("array<int>")) if len(buckets) else F.expr("cast(array() as array<int>)")
    rows = [([place[b] for b in r["held"]], r["y"]) for r in sample.select("row", held.alias("held"), "y").orderBy("row").collect()]
    return train(rows, buckets, bits, factors, steps, seed)


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out_col: str = "score") -> DataFrame:
    """``keep`` (the id alone by default) and ``out_col`` (0 to 1) for every row, from its whole text.

    The model has at most ``kept`` weights, which bounds what is broadcast. A
    null or empty text, or one without a kept term, scores the model's bias;
    repeated rows give repeated results, an empty table an empty one.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or [id_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm: FactorizationMachine = shared.value
        place = {int(b): i for i, b in enumerate(fm.buckets)}
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            raw = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                active: set[int] = set()
                for w in set(_WORD.findall(t.lower())):
                    got = seen.get(w)
                    if got is None:
                        got = tuple(place[b] for b in hashed_terms(w, fm.bits) if b in place)
                        if len(seen) >= 1 << 19:
                            seen.clear()
                        if len(w) <= 48:
                            seen[w] = got
                    if got:
                        active.update(got)
                raw.append(fm.raw(np.array([sorted(active)], int).reshape(1, -1))[0] if active else fm.bias)
            p = 1 / (1 + np.exp(-np.clip(np.array(raw, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], [*batch.schema.names[:-1], "_score"])

    rows = docs.select(*[column(c).alias(f"_c{i}") for i, c in enumerate(keep)], text(text_col).alias("_text"))
    schema = ", ".join(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", _score double"
    return rows.mapInArrow(score, schema).toDF(*keep, out_col)


def held_out_fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **more) -> FactorizationMachine:
    """``fit`` on the rows outside fold 0."""
    return fit(docs, labels.where(fold(id_col) != 0), id_col=id_col, **more)
