"""Mixing sources to target weights: fixed blocks of words, multinomial source counts per shard, pseudorandom block orders, a join by index."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import buckets_for, column, durable, salted_prefix, text

SPACE = r"[\x20\x09-\x0D]+"
ROUNDS = 12


def word_count(col: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    bare = F.regexp_replace(col, r"^[\x20\x09-\x0D]+", "")
    parts = F.split(bare, SPACE)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("long")


def targets(sizes: list[float], weights: tuple[float, ...], most: float) -> list[float]:
    """Shares of sum(sizes) by weight (repeating, in the order given), none above ``most`` times its size; the excess is shared again by weight."""
    total, w = float(sum(sizes)), [weights[i % len(weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        share = left / sum(w[i] for i in free)
        over = [i for i in free if w[i] * share > most * sizes[i]]
        for i in over or free:
            out[i] = most * sizes[i] if over else w[i] * share
        if not over:
            break
        free -= set(over)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, by swap-or-not rounds keyed by ``key``."""

    def swap(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, y)).bitwiseAND(F.lit(1)) == 1, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


@dataclass
class Mix:
    """rows: (row, id, _none, _src, size, start) with start the words before in the source; sources: one row each; slots: (shard, _none, _src, k, block)."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """(row, block, first, words, times): the part of each row in each block, first from the row's start, and how often the mix takes it."""
        b = F.explode(F.sequence(F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block)))
        cut = self.rows.where("size > 0").select("row", "_none", "_src", "start", "size", b.alias("block"))
        low = F.greatest(F.col("start"), F.col("block") * self.block)
        high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block)
        cut = cut.select("row", "_none", "_src", "block", (low - F.col("start")).alias("first"), (high - low).alias("words"))
        times = self.slots.groupBy("_none", "_src", "block").agg(F.count("*").alias("times"))
        return cut.join(times, ["_none", "_src", "block"]).select("row", "block", "first", "words", "times")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, block: int = 64, slots: int = 1024, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None,
) -> Mix:
    """Plan a mix of as many words as ``docs`` has, by source.

    Sources in code point order (null last) weigh ``weights``, repeating. A
    source's words, in a hashed order of its documents, are packed into blocks
    of ``block`` words (its last may be shorter). Every output shard has the
    same number of slots, about ``slots``: the whole parts of the sources'
    expectations, and for the rest a multinomial draw, so that totals stay
    within a block or so for each shard of their targets. A source's slots go
    through its blocks in one pseudorandom order after another, so that no
    block comes up more than ``most`` times.

    Null texts have no words; a null source is a source; repeated rows are
    separate rows; texts without words take part with size 0; an empty table
    gives empty results. The table of sources, one row each, passes the
    driver; documents don't.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), column(id_col).alias("_id"), column(source_col).isNull().cast("int").alias("_none"),
        F.coalesce(column(source_col).cast("string"), F.lit("")).alias("_src"), word_count(text(text_col)).alias("size"), *[column(c).alias(f"_keep_{i}") for i, c in enumerate(keep or [])],
    )
    rows = durable(rows)
    by_source = rows.groupBy("_none", "_src").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    by_source.sort(key=lambda r: (r["_none"], r["_src"]))
    goal = targets([r["s"] for r in by_source], weights, most)
    full = [-(-r["s"] // block) for r in by_source]
    want = [g * n / r["s"] if r["s"] else 0.0 for g, n, r in zip(goal, full, by_source, strict=True)]
    each = max(slots, 16 * len(want))
    shards = max(1, math.ceil(sum(want) / each))
    per_shard = round(sum(want) / shards)
    expected = [q * per_shard / sum(want) if sum(want) else 0.0 for q in want]
    sure = [math.floor(e) for e in expected]
    rest, cdf, so_far = per_shard - sum(sure), [], 0.0
    for e, s in zip(expected, sure, strict=True):
        so_far += e - s
        cdf.append(so_far)
    cdf = [c / so_far if so_far else 1.0 for c in cdf]
    table = [(i, r["_none"], r["_src"], int(r["s"]), float(g), n, s) for i, (r, g, n, s) in enumerate(zip(by_source, goal, full, sure, strict=True))]
    sources = spark.createDataFrame(table, "_at int, _none int, _src string, source_size long, target double, blocks long, sure long")

    # the draws that are left in each shard: a uniform number, and the source in whose part of the cumulative shares it falls
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "shard", "draw"), 11) * F.lit(2.0**-53)
    steps = max(1, len(cdf)).bit_length()
    shares = F.split(F.lit(",".join(map(repr, cdf))), ",").cast("array<double>")
    search = F.aggregate(
        F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)), F.lit(0),
        lambda low, k: F.when(F.coalesce(F.get(shares, low + F.pow(F.lit(2), k).cast("int") - 1) <= F.col("u"), F.lit(False)), low + F.pow(F.lit(2), k).cast("int")).otherwise(low),
    )
    drawn = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(1), F.lit(max(rest, 1)))).alias("draw")).where(F.lit(rest > 0))
    drawn = drawn.withColumn("u", u).select("shard", F.least(search, F.lit(max(len(cdf) - 1, 0))).alias("_at"), F.lit(1).cast("long").alias("c"))
    granted = sources.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "_at", F.col("sure").alias("c"))
    counts = granted.unionByName(drawn).groupBy("shard", "_at").agg(F.sum("c").alias("c"))
    first = salted_prefix(counts, ["_at"], [F.col("shard")], F.col("c"), F.xxhash64("shard"), "first", buckets_for(shards))
    slot = first.where("c > 0").select("shard", "_at", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("c") - 1)).alias("k"))
    slot = slot.join(sources.select("_at", "_none", "_src", "blocks"), "_at").where(F.col("k") < F.col("blocks") * most)
    key = F.xxhash64(F.lit(seed), "_at", F.floor(F.col("k") / F.col("blocks")))
    slot = slot.withColumn("key", key).select("shard", "_none", "_src", "k", permuted(F.pmod("k", "blocks"), F.col("blocks"), F.col("key")).alias("block"))

    order = F.xxhash64(F.lit(seed), "_id")
    placed = salted_prefix(rows, ["_none", "_src"], [order, F.col("_id"), F.col("row")], F.col("size"), order, "start", buckets_for(max([0, *(r["n"] for r in by_source)])))
    return Mix(placed, sources, slot, block)


def mixed_sizes(m: Mix) -> DataFrame:
    """(_id, size, source_size, target, taken) for every row."""
    taken = m.pieces().groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = m.rows.join(m.sources, ["_none", "_src"]).join(taken, "row", "left")
    return rows.select("_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The mix as documents: for each time up to ``most``, a row with the words of the document that are taken at least so often.

    A document whose blocks are all taken keeps its whole text, white space
    included; of others the words of the blocks that aren't taken go, with the
    white space after them. Other columns keep their values. ``n_chars``, where
    there is one, is counted again.
    """
    docs = docs.withColumn(text_col, text(text_col))
    m = mix(docs, id_col=id_col, text_col=text_col, keep=docs.columns, **more)
    spans = m.pieces().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("spans"))
    kept = m.rows.join(spans, "row").withColumn("time", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("spans", lambda s: s["times"])).cast("int"))))
    kept_text = f"_keep_{docs.columns.index(text_col)}"
    body = F.col(kept_text)
    # units: a word and the white space after it; leading white space goes with the first
    lead = F.regexp_extract(body, r"^[\x20\x09-\x0D]*", 0)
    units = F.split(F.substr(body, F.length(lead) + 1), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    kept = kept.withColumn("units", units).withColumn("mine", F.filter("spans", lambda s: s["times"] >= F.col("time")))
    some = F.array_join(F.flatten(F.transform("mine", lambda s: F.slice("units", (s["first"] + 1).cast("int"), s["words"].cast("int")))), "")
    whole = F.aggregate("mine", F.lit(0).cast("long"), lambda a, s: a + s["words"]) == F.col("size")
    out = kept.withColumn(kept_text, F.when(whole, body).otherwise(some))
    out = out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)])
    return out.withColumn("n_chars", F.length(column(text_col)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
