"""Importance resampling towards a target distribution over hashed n-grams.

In every task DuckDB unnests the words of a batch of texts, forms n-grams with
window functions, hashes distinct ones with a registered CRC-32 and counts
buckets by text. The counts are written as Parquet once; Spark merges them
into two tables of one row for each bucket, scores the texts and ranks them.
"""

from __future__ import annotations

import math
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeframe.llm.common import by_bytes, column, durable, one_thread, partitions, scratch, text

#: Runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DUCKDB_MEMORY = "300MB"


def lowered_crc(features: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of the UTF-8 bytes, A-Z lower-cased (which leaves the other bytes as they are)."""
    return pa.array([zlib.crc32(x.encode().lower()) for x in features.to_pylist()], pa.int64())


def counting_sql(most: int, buckets: int) -> str:
    """From ``batch`` (row, body): row, n_words, and the lists of its buckets and their counts, by row."""
    if most == 1:
        features = "select row, unnest(words) as feature from listed"
    else:
        placed = "select row, unnest(words) as word, generate_subscripts(words, 1) as place from listed"
        grams = [f"(select row, concat_ws(' ', {', '.join(f'lead(word, {k}) over w' if k else 'word' for k in range(n))}) as feature, lead(place, {n - 1}) over w as ends from placed window w as (partition by row order by place))" for n in range(1, most + 1)]
        features = f"with placed as ({placed}) select row, feature from ({' union all '.join(grams)}) where ends is not null"
    return f"""
    with listed as (select row, regexp_extract_all(body, '{WORD}') as words from batch),
    counted as (select row, feature, count(*) as n from ({features}) group by row, feature),
    hashed as (select feature, lowered_crc(feature) % {buckets} as bucket from (select distinct feature from counted)),
    merged as (select row, bucket, sum(n)::bigint as n from counted join hashed using (feature) group by row, bucket),
    gathered as (select row, list(bucket::integer order by bucket) as buckets, list(n order by bucket) as counts from merged group by row)
    select len(words)::bigint as n_words, coalesce(buckets, []) as buckets, coalesce(counts, []) as counts from listed left join gathered using (row) order by row"""


def bucket_counts(docs: DataFrame, id_col: str, text_col: str, most: int = 1, buckets: int = 10_000, batch_bytes: int = 4 << 20) -> DataFrame:
    """(_id, n_words, buckets, counts) for every row: in which of ``buckets`` its runs of 1 to ``most`` words fall, and how often.

    Batches hold about ``batch_bytes`` of text (one text at least); DuckDB
    keeps to its memory limit by spilling into a folder of the task, which is
    gone when the task ends. Null texts are empty and have empty lists.
    """
    sql = counting_sql(most, buckets)
    out = pa.schema([("n_words", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": folder}) as con:
            con.create_function("lowered_crc", lowered_crc, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in by_bytes(batches, "_text", batch_bytes):
                con.register("batch", pa.table([pa.array(range(batch.num_rows), pa.int64()), batch.column(1)], ["row", "body"]))
                got = con.sql(sql).to_arrow_table().cast(out).combine_chunks()
                con.unregister("batch")
                yield pa.RecordBatch.from_arrays([batch.column(0), *[c.chunk(0) for c in got.columns]], ["_id", *out.names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(column(id_col).alias("_id"), text(text_col).alias("_text"))
    return rows.mapInArrow(count, f"_id {kind}, n_words long, buckets array<int>, counts array<long>")


def merged(counts: DataFrame) -> DataFrame:
    """(bucket, n) over all rows; one row for each bucket and task is shuffled."""
    return counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of target share over corpus share) of each bucket, one added to every count. The driver sees ``buckets`` pairs of numbers, whatever the corpus."""
    found = merged(corpus).withColumnRenamed("n", "s").join(merged(target).withColumnRenamed("n", "t"), "bucket", "full").collect()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in found:
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(scale * math.log((float(b + 1) * all_s) / (float(a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def with_weights(counts: DataFrame, gains: np.ndarray, most: int) -> DataFrame:
    """(_id, n_words, n_features, weight): the sum of the gains of a row's features, repeats counted."""
    given = counts.sparkSession.sparkContext.broadcast(gains)  # one number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            ids, words, lists, ns = batch.columns
            total = np.concatenate([[0], np.cumsum(given.value[lists.flatten().to_numpy(zero_copy_only=False)] * ns.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
            n = words.to_numpy(zero_copy_only=False)
            features = sum(np.maximum(n - k, 0) for k in range(most))
            yield pa.RecordBatch.from_arrays([ids, words, pa.array(features, pa.int64()), pa.array(np.diff(total[ends]), pa.int64())], ["_id", "n_words", "n_features", "weight"])

    kind = counts.schema["_id"].dataType.simpleString()
    return counts.mapInArrow(weigh, f"_id {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int, scale: int = 1000) -> Column:
    """A draw of the Gumbel distribution for each id: the first 32 bits of SHA-256 of ``seed:id`` as a uniform number. A null id reads as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``rows``, written, with their place from 1 in ``order`` over the whole table.

    Rows are sorted by ranges, Spark numbers them within each range, and each
    range is shifted by the number of rows before it: a list as long as there
    are partitions. Rows that tie are cut among ranges by their place in the
    table, so that many equal rows don't meet in one task.
    """
    spark = rows.sparkSession
    keys = [*order, F.col("_tie")]
    cut = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    cut = durable(cut.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part, within = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = cut.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return cut.withColumn("_part", part).join(before, "_part").withColumn(out, within + F.col("_before") + 1).drop("_part", "_before", "_at")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
    most: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of ``docs``; rank is null where a row isn't drawn.

    A row's weight is the log of how much likelier its features are under the
    target, by bucket; its score adds Gumbel noise that depends on seed and id
    alone, so that the highest scores are a draw without replacement by
    weight. Of the N rows with at least ``least_words`` words the highest
    floor(percent * N / 100) are drawn, ties to the smaller id (null last).

    Null and empty texts have no features and weigh 0; repeated rows are rows
    of their own; an empty target or corpus leaves the added ones; an empty
    table gives an empty one; other columns aren't read.
    """
    spark = docs.sparkSession
    with scratch(spark):
        counts = durable(bucket_counts(docs, id_col, text_col, most, buckets))
        wanted = durable(bucket_counts(target, target_id, target_text, most, buckets))
        gains = bucket_gains(counts, wanted, buckets)
        scored = durable(with_weights(counts, gains, most).withColumn("score", F.col("weight") + noise(F.col("_id"), seed)))
        drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
        enough = ranked(scored.where(F.col("n_words") >= least_words), [F.col("score").desc(), F.col("_id").asc_nulls_last()])
        enough = enough.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
        short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
        result = durable(enough.unionByName(short).select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank"), keep=True)
    return result
