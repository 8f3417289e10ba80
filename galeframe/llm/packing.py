"""Best-fit packing: documents sorted by length and ranked, matched in bulk with the tightest gaps, gaps updated, repeated."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import buckets_for, by_bytes, column, durable, salted_prefix, scratch, small_batches, text
from galeframe.llm.tokens import LETTERS, MARKS, ODD_SPACE, encoder, visible_units

#: Ranks of a length are looked up in blocks of so many.
RANK_BLOCK = 1 << 12


def id_bytes(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text, between which the vocabulary drops white space."""
    odd = pc.match_substring_regex(texts, "[" + "".join(map(re.escape, ODD_SPACE)) + "]")
    if pc.any(odd).as_py():
        return pa.array([visible_units(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.ascii_split_whitespace(texts)


def parts_of(words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Each word as what ends in a plain letter, which is in lower case where it has no other letters, and the closing marks behind it; a word that ends otherwise is whole."""
    words = words.cast(pa.string())
    body = pc.utf8_rtrim(words, characters=MARKS)
    body = pc.if_else(pc.match_substring_regex(body, f"[{LETTERS}]$"), body, words)
    n = (pc.binary_length(words).to_numpy() - pc.binary_length(body).to_numpy()).astype(np.int32)
    ends, chars = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 :][: len(words)], words.buffers()[2] or b""
    to = np.cumsum(n, dtype=np.int32)
    marks = np.frombuffer(chars, np.uint8)[np.repeat(ends - to, n) + np.arange(n.sum())]
    marks = pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], to]).astype(np.int32)), pa.py_buffer(marks))
    body = pc.if_else(pc.match_substring_regex(body, f"^[{LETTERS}]+$"), pc.utf8_lower(body), body)
    return body.dictionary_encode(), marks.dictionary_encode()


def laid(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the units ``at``, one unit after the other, where each ends, 0 first); ``ids`` has ``size`` of each unit."""
    first, n = np.cumsum(size) - size, size[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])], ends


def ids_of(words: pa.ListArray, encode) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's ids end); of the distinct words each distinct part is looked up once."""
    coded = words.flatten().dictionary_encode()
    body, marks = parts_of(coded.dictionary)
    known = encode(body.dictionary.to_pylist() + marks.dictionary.to_pylist())
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    both = np.stack([body.indices.to_numpy(), len(body.dictionary) + marks.indices.to_numpy()], axis=1)
    ids, ends = laid(np.frombuffer(b"".join(known), "<u4"), size, both.ravel())
    ids, ends = laid(ids, np.diff(ends[::2]), coded.indices.to_numpy())
    places = words.offsets.to_numpy()
    return ids, ends[places[1:] - places[0]]


def token_pieces(
    docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    batch_bytes: int = 1 << 21, cache_entries: int = 1 << 20,
) -> DataFrame:
    """(_id, piece, start, length, ids_crc32): each text's token ids and ``end_id``, cut into pieces of ``capacity``.

    The vocabulary is one that lower-cases, drops white space and marks ends of words. A null or empty text is ``end_id`` alone. Repeated rows are packed as often as they come.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_json, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(f"ids {tokenizer_json}", vocabulary.value, id_bytes, cache_entries, batch_bytes, lower=True)
        for batch in by_bytes(batches, "_text", batch_bytes):
            ids, ends = ids_of(words_of(batch.column(1)), encode)
            row, start, length, crc, first = [], [], [], [], 0
            for i, last in enumerate(ends.tolist()):
                whole, first = ids[first:last].tobytes() + end, last
                for at in range(0, len(whole), 4 * capacity):
                    part = whole[at : at + 4 * capacity]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            own = batch.column(0).take(pa.array(row, pa.int64()))
            at = pa.array(start, pa.int64())
            piece = pa.array([s // capacity for s in start], pa.int32())
            yield pa.RecordBatch.from_arrays([own, piece, at, pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(column(id_col).alias("_id"), text(text_col).alias("_text"))
    return rows.mapInArrow(pieces, f"_id {kind}, piece int, start long, length long, ids_crc32 long")


#: Sizes are swept in so many ranges, and documents take part from the longest down, in groups of lengths over these shares of the capacity.
RANGES, SHARES = 16, (1 / 2, 1 / 3, 1 / 4, 1 / 8, 1 / 16, 0.0)
DOCS, GAPS, PLACED = "docs", "gaps", "placed"
STATE = "kind string, size long, rank long, n long, sequence long, each long"


def fit_range(rows: list[tuple[str, int, int, int, int]], new: int | None = None, capacity: int = 0) -> list[tuple]:
    """One range of sizes: runs of documents, the longest first, take the tightest gaps that hold them.

    rows: (kind, size, rank, n, sequence); a run of gaps is n sequences of
    one gap from ``sequence`` on. Gives (kind, size, rank, n, sequence, each,
    gap) of what was placed and of what is left. What a document leaves of a
    gap is for the next round; but documents that no gap of any range holds
    (``new``: the first number of a sequence to open) share those they open.
    """
    docs = sorted(((s, r, n) for k, s, r, n, _ in rows if k == DOCS), reverse=True)
    pools: dict[int, list[tuple[int, int]]] = {}
    sizes, out, later = [], [], []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in pools:
                pools[gap] = []
                bisect.insort(sizes, gap)
            pools[gap].append((first, n))

    for k, s, _, n, q in sorted(rows, reverse=True):
        if k == GAPS:
            put(s, q, n)
    for length, rank, n in docs:
        while n:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, m = pools[gap].pop()
                if not pools[gap]:
                    del pools[gap], sizes[at]
            elif new is not None:
                gap, first, m = capacity, new, -(-n // (capacity // length))
                new += m
            else:
                out.append((DOCS, length, rank, n, 0, 0, 0))
                break
            each = min(gap // length, n)
            full = min(m, n // each)
            out.append((PLACED, length, rank, full, first, each, gap))
            rank, n = rank + full * each, n - full * each
            put(gap, first + full, m - full)
            if new is not None:
                put(gap - each * length, first, full)
            elif gap > each * length:
                later.append((gap - each * length, first, full))
    left = [*later, *((gap, first, n) for gap, pool in pools.items() for first, n in pool)]
    return [*out, *((GAPS, gap, 0, n, first, 0, 0) for gap, first, n in left)]


def swept(state: DataFrame, tops: list[tuple[int, int]], floor: int, used: int, capacity: int) -> DataFrame:
    """One round: documents longer than ``floor`` go to the range of sizes where the tightest gap that holds them lies, each range matches its own by rank, and gaps are updated.

    tops: (range, largest gap) of the ranges that hold gaps, by size. The
    sweep for a document's range takes the first whose largest gap holds it.
    Documents without one open sequences, numbered from ``used`` on.
    """
    active = (F.col("kind") == DOCS) & (F.col("size") > floor)
    to = F.coalesce(*[F.when(F.col("size") <= top, F.lit(r)) for r, top in tops], F.lit(-1))
    names = ["kind", "size", "rank", "n", "sequence", "each", "gap"]

    def match(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in names[:5]), strict=True))
        out = fit_range(rows, used, capacity) if table.column("range")[0].as_py() < 0 else fit_range(rows)
        return pa.table([pa.array([r[i] for r in out], pa.string() if i == 0 else pa.int64()) for i in range(len(names))], names)

    both = state.where(active | (F.col("kind") == GAPS)).withColumn("range", F.when(F.col("kind") == GAPS, size_range(capacity)).otherwise(to))
    fitted = both.groupBy("range").applyInArrow(match, STATE + ", gap long")
    return fitted.unionByName(state.where((F.col("kind") == DOCS) & ~active).withColumn("gap", F.lit(0).cast("long")))


def size_range(capacity: int) -> Column:
    return F.floor((F.col("size") - 1) / -(-capacity // RANGES)).cast("int")


def best_fit(lengths: DataFrame, capacity: int = 4096) -> DataFrame:
    """(length, rank, n, sequence, each, gap) from (length, n): runs of documents placed by bulk-synchronous best fit.

    Documents of one length are interchangeable, so a run of them, by rank, is
    one row, and so are sequences with one gap: what is sorted by size, swept,
    matched and updated has about ``capacity`` rows, however many documents
    there are. Rounds repeat until nothing is left of a group of lengths; then
    the next shorter group takes part, so that short documents fill what long
    ones leave. n sequences from ``sequence`` on get ``each`` documents of the
    length, from ``rank`` on, behind the offset capacity - gap. The driver
    sees the largest size of each range after a round.
    """
    zero = F.lit(0).cast("long")
    state = durable(lengths.select(F.lit(DOCS).alias("kind"), F.col("length").alias("size"), zero.alias("rank"), "n", zero.alias("sequence"), zero.alias("each"), zero.alias("gap")))
    placed, used, shares = [], 0, list(SHARES)
    while True:
        told = state.groupBy("kind", size_range(capacity).alias("range")).agg(F.max("size").alias("top"), F.max(F.col("sequence") + F.col("n")).alias("used")).collect()
        used = max([used, *(r["used"] for r in told if r["kind"] == PLACED)])
        longest = max((r["top"] for r in told if r["kind"] == DOCS), default=0)
        placed.append(state.where(F.col("kind") == PLACED).select(F.col("size").alias("length"), "rank", "n", "sequence", "each", "gap"))
        if not longest:
            return reduce(DataFrame.unionByName, placed)
        while longest <= int(capacity * shares[0]):
            shares.pop(0)
        tops = sorted((r["range"], r["top"]) for r in told if r["kind"] == GAPS)
        state = durable(swept(state.where(F.col("kind") != PLACED).drop("gap"), tops, int(capacity * shares[0]), used, capacity))


def pack(pieces: DataFrame, capacity: int = 4096, id_col: str = "_id") -> DataFrame:
    """Adds sequence_id and offset to pieces of length 1 to ``capacity``; each sequence is gapless from 0 and holds ``capacity`` at most.

    Ranks within a length are made without gathering a length's pieces in one
    task; a piece finds its run by length and by its block of ranks.
    """
    pieces = durable(pieces)
    with scratch(pieces.sparkSession):
        lengths = durable(pieces.groupBy("length").agg(F.count("*").alias("n")))
        most = lengths.agg(F.max("n")).first()[0] or 0
        runs = durable(best_fit(lengths, capacity), keep=True)
    ranked = salted_prefix(pieces, ["length"], [F.col(id_col), F.col("piece"), F.col("ids_crc32")], F.lit(1), F.xxhash64(id_col, "piece"), "_rank", buckets_for(most))
    names = [c for c in ranked.columns if c != "_rank"]
    last = F.col("rank") + F.col("n") * F.col("each") - 1
    blocks = F.explode(F.sequence(F.floor(F.col("rank") / RANK_BLOCK), F.floor(last / RANK_BLOCK))).alias("_block")
    runs = runs.select("length", F.col("rank").alias("_first"), last.alias("_last"), "sequence", "each", "gap", blocks)
    found = ranked.withColumn("_block", F.floor(F.col("_rank") / RANK_BLOCK)).join(runs, ["length", "_block"]).where(F.col("_rank").between(F.col("_first"), F.col("_last")))
    i = F.col("_rank") - F.col("_first")
    place = [(F.col("sequence") + F.floor(i / F.col("each"))).alias("sequence_id"), (F.lit(capacity) - F.col("gap") + i % F.col("each") * F.col("length")).cast("long").alias("offset")]
    return found.select(*[column(c) for c in names], *place)


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every row's tokens, packed. An empty table gives an empty result."""
    packed = pack(token_pieces(docs, tokenizer_json, capacity, id_col=id_col, text_col=text_col), capacity)
    return packed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
