"""Hard negatives: for each anchor and positive the unlike rows that score a little under the positive.

Anchors are a stated query set, rows are dealt in blocks: a grid of cells, one
for each group of anchors and group of rows. A cell holds its anchors and
streams its rows by Arrow batch; for each anchor a batch is scored, sorted
whole by score and id, and searched. What leaves a cell is at most the k best
of each anchor and positive, and Spark merges cells by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.common import column, durable, one_thread, partitions, scratch

_EXACT = float(1 << 53)


def matrix(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) as float64; shorter vectors are filled up with zeros."""
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, int)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exact; those that a long can't hold are its limits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1) < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    limit = np.iinfo(np.int64)
    return np.clip(whole(a).dot(whole(b).T), limit.min, limit.max).astype(np.int64)


class Best:
    """The k best (score, id, row) of each (anchor, slot)."""

    def __init__(self, k: int, most: int = 500_000) -> None:
        self.k, self.most, self.parts, self.n = k, most, [], 0

    def add(self, anchor: int, slot: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(score):
            self.parts.append((np.full(len(score), anchor), np.full(len(score), slot), score, ids, rows))
            self.n += len(score)
            if self.n > self.most:
                self.parts = [self.cut()]
                self.n = len(self.parts[0][0])
                self.most = max(self.most, 2 * self.n)

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        anchor, slot, score, ids, rows = (c[np.lexsort((cols[4], cols[3], -cols[2], cols[1], cols[0]))] for c in cols)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(slot) != 0)]))
        place = np.arange(len(anchor)) - np.repeat(first, np.diff([*first, len(anchor)]))
        keep = place < self.k
        return tuple(c[keep] for c in (anchor, slot, score, ids, rows))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(cell, whether these are anchors, slice) in the order of the rows."""
    for batch in batches:
        cell, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(cell)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield int(cell[i]), kind[i] == 0, batch.slice(i, j - i)


class _Cell:
    """The anchors of a cell, and the best rows met so far: those of the anchor's label, or, where positives are given, those within a positive's limits."""

    def __init__(self, n_positives: int, k: int, low: int, high: int, scale: float, negatives: bool) -> None:
        self.k, self.low, self.high, self.scale, self.negatives = k if negatives else n_positives, low, high, scale, negatives
        self.anchors, self.best, self.x = [], Best(self.k), None

    def close(self) -> None:
        table = pa.Table.from_batches(self.anchors).combine_chunks()
        self.row, self.id, self.label = (table.column(c).to_numpy() for c in ("_row", "_id", "_label"))
        self.x = matrix(table.column("_x").combine_chunks().cast(pa.list_(pa.float64())), self.scale)
        if self.negatives:
            self.positives = table.column("_positives").to_pylist()
        self.anchors = []

    def meet(self, rows: pa.RecordBatch, each: int = 2_000_000) -> None:
        ids, row, label = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("_id", "_row", "_label"))
        x = matrix(rows.column(rows.schema.get_field_index("_x")).cast(pa.list_(pa.float64())), self.scale)
        step = max(1, each // max(1, len(ids)))
        for at in range(0, len(self.id), step):
            for i, score in enumerate(scores(self.x[at : at + step], x), at):
                order = np.lexsort((row, ids, -score))
                like = label[order] == self.label[i]
                if self.negatives:
                    self._within(i, score[order], ids[order], row[order], np.flatnonzero(~like))
                else:
                    take = order[like & (row[order] != self.row[i])][: self.k]
                    self.best.add(i, 0, score[take], ids[take], row[take])

    def _within(self, i: int, score: np.ndarray, ids: np.ndarray, row: np.ndarray, unlike: np.ndarray) -> None:
        falling = -score
        for slot, p in enumerate(self.positives[i]):
            most, least = self.high * p["score"] // 100, -(-self.low * p["score"] // 100)
            first, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
            i0, i1 = np.searchsorted(unlike, first), np.searchsorted(unlike, end)
            take = unlike[i0 : min(i0 + self.k, i1)]
            self.best.add(i, slot, score[take], ids[take], row[take])

    def result(self) -> pa.RecordBatch:
        anchor, slot, score, ids, row = self.best.cut()
        cols = [self.row[anchor], self.id[anchor], slot, score, ids, row] if len(anchor) else [anchor] * 6
        names = ["anchor_row", "anchor_id", "slot", "score", "id", "row"]
        if self.negatives:
            found = [self.positives[a][s] for a, s in zip(anchor.tolist(), slot.tolist(), strict=True)]
            cols += [pa.array([p[c] for p in found], pa.int64()) for c in ("id", "score")]
            names += ["positive_id", "positive_score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def _meet(rows: DataFrame, anchors: DataFrame, groups: tuple[int, int], **rules) -> DataFrame:
    """The best rows of each anchor and slot, from each cell of the grid of ``groups`` (of anchors, of rows)."""
    of_anchors, of_rows = groups
    cols = ["_row", "_id", "_label", "_x", *(c for c in anchors.columns if c == "_positives")]
    own = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.select(*cols, own(of_anchors).alias("_a"), every(of_rows).alias("_r"), F.lit(0).alias("_kind"))
    r = rows.select(*cols[:4], own(of_rows).alias("_r"), every(of_anchors).alias("_a"), F.lit(1).alias("_kind"))
    both = a.unionByName(r, allowMissingColumns=True).withColumn("_cell", F.col("_a") * of_rows + F.col("_r"))
    dealt = both.select("_cell", "_kind", *cols).repartitionById(of_anchors * of_rows, F.col("_cell")).sortWithinPartitions("_cell", "_kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        cell, now = None, -1
        for at, is_anchor, batch in _cells(batches):
            if at != now:
                if cell is not None and cell.x is not None:
                    yield cell.result()
                cell, now = _Cell(**rules), at
            if is_anchor:
                cell.anchors.append(batch)
                continue
            if cell.anchors:
                cell.close()
            if cell.x is not None:
                cell.meet(batch)
        if cell is not None and cell.x is not None:
            yield cell.result()

    out = "anchor_row long, anchor_id long, slot long, score long, id long, row long" + (", positive_id long, positive_score long" if rules["negatives"] else "")
    return dealt.mapInArrow(search, out)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    n_positives: int = 5, k: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, anchors_per_group: int = 4096, rows_per_group: int = 1000,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of two vectors of integers floor(scale * x);
    higher ones come first, ties by id, then by the row. An anchor's positives
    are its first ``n_positives`` other rows of the same label (all, if
    fewer); for each, the first ``k`` rows of another label are returned whose
    score is between ``low`` and ``high`` percent of the positive's.

    Rows with a null id, label or vector, or a null or non-finite component
    take no part. Rows that repeat are rows of their own. Components that one
    of two vectors lacks count as 0; scores beyond a long are its limits. An
    empty table, or one without anchors, gives an empty result; other columns
    aren't read. Ids are integers, labels integers.

    A task holds one group of anchors (``anchors_per_group`` vectors at most,
    about, and their k best for each positive) and a batch of rows. There are
    as many groups of rows as keep all cores busy, of ``rows_per_group`` at
    least; each is sent to every group of anchors, and anchors to every group
    of rows. Both passes, for positives and for negatives, compute and sort
    every score of every anchor.
    """
    spark = vectors.sparkSession
    x = column(vector_col)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(column(id_col).isNotNull() & column(label_col).isNotNull() & x.isNotNull() & good)
    rows = rows.select(column(id_col).cast("long").alias("_id"), column(label_col).cast("long").alias("_label"), x.alias("_x"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    with scratch(spark):
        rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
        anchors = rows.where("_anchor")
        n, m = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_anchor").cast("long")), F.lit(0))).first()
        of_anchors = max(1, -(-m // anchors_per_group))
        groups = of_anchors, max(1, min(-(-n // rows_per_group), -(-2 * partitions(spark) // of_anchors)))
        rules = {"n_positives": n_positives, "k": k, "low": low, "high": high, "scale": scale}
        first = lambda most, *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "row")) <= most
        near = _meet(rows, anchors, groups, **rules, negatives=False).withColumn("_keep", first(n_positives, "anchor_row")).where("_keep")
        near = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "row", "score"))).alias("_p"))
        near = near.select(F.col("anchor_row").alias("_row"), F.transform("_p", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("_positives"))
        found = _meet(rows, durable(anchors.join(near, "_row")), groups, **rules, negatives=True)
        place = F.row_number().over(Window.partitionBy("anchor_row", "slot").orderBy(F.col("score").desc(), "id", "row"))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
        result = durable(found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), keep=True)
    return result
