"""Document fingerprints by I-Match: terms of a band of inverse document frequencies, sorted, hashed over randomised lexicon subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from galeframe.llm.common import column, partitions, text

#: Subsets of the lexicon: (bits a term's hash must have at 0, subsets). A subset of b bits keeps a 2^-b share of the lexicon.
LEVELS = ((2, 10), (4, 10), (6, 10), (9, 7))


def terms(col: Column) -> Column:
    """Sorted hashes of the distinct lower-case runs of letters and digits."""
    words = F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = 1.386, high: float = 4.606) -> list[int]:
    """Hashes of the terms with ln(rows / rows that have the term) in [low, high].

    A term in at least a share exp(-high) of the rows is one of at most
    exp(high) times the mean number of distinct terms of a row: with the
    defaults a hundred times that, however many rows there are.
    """
    each = docs.select(F.explode(terms(text(text_col))).alias("t"))
    rows = docs.count()
    if not rows:
        return []
    idf = F.log(F.lit(float(rows)) / F.col("n"))
    return sorted(r["t"] for r in each.groupBy("t").agg(F.count("*").alias("n")).where(idf.between(low, high)).select("t").collect())


def _kept(ts: Column, lexicon_hashes: list[int]) -> Column:
    known = F.split(F.lit(",".join(map(str, lexicon_hashes))), ",").cast("array<bigint>") if lexicon_hashes else F.expr("cast(array() as array<bigint>)")
    return F.array_intersect(ts, known)


def with_fingerprint(df: DataFrame, source: Column, lexicon_hashes: list[int], out: str) -> DataFrame:
    """Adds ``out``, an array of hashes: of all kept terms, and of the kept terms of each lexicon subset (null where it has none).

    Where a text has no kept term, the first hash is of all its terms, so that
    unlike texts differ there too.
    """
    df = df.withColumn("_terms", terms(source)).withColumn("_kept", _kept(F.col("_terms"), lexicon_hashes))
    marked = F.transform("_kept", lambda t: F.struct(t.alias("a"), F.xxhash64(t).alias("b"), F.xxhash64(t, F.lit(1)).alias("c")))
    df = df.withColumn("_marked", marked)

    def subsets(field: str, bits: int, first: int, count: int) -> Column:
        def one(k: Column) -> Column:
            shift = k * bits + first
            some = F.filter("_marked", lambda m: F.call_function("shiftrightunsigned", m[field], shift).bitwiseAND(F.lit((1 << bits) - 1)) == 0)
            return F.when(F.size(some) > 0, F.xxhash64(F.transform(some, lambda m: m["a"])))

        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), one)

    whole = F.xxhash64(F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_terms")))
    fields = (("a", 0), ("a", 20), ("b", 0), ("c", 0))
    parts = [subsets(field, bits, first, count) for (bits, count), (field, first) in zip(LEVELS, fields, strict=True)]
    return df.withColumn(out, F.concat(F.array(whole), *parts)).drop("_terms", "_kept", "_marked")


def as_text(fp: Column) -> Column:
    """16 hexadecimal digits for all kept terms and 8 for each subset, - for an empty one."""
    rest = F.transform(F.slice(fp, 2, sum(n for _, n in LEVELS)), lambda h: F.coalesce(F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), F.lit("-")))
    return F.concat(F.lpad(F.lower(F.hex(F.get(fp, F.lit(0)))), 16, "0"), F.lit(":"), F.array_join(rest, ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among those that either fingerprint has."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False)).cast("double")))
    some = F.filter(both, lambda e: e.isNotNull())
    return F.aggregate(some, F.lit(0.0), lambda s, e: s + e) / F.size(some)


def with_next(df: DataFrame, id_col: str, cols: list[str], buckets: int) -> DataFrame:
    """Adds ``next_<col>`` of the row that follows in descending id order (null last); the first row follows the last.

    Rows are windowed in ranges of ids; each range also gets the first row of
    the one below, and the lowest range the very first row: two short passes
    over ids tell which. The driver holds one id for each range.
    """
    kind = df.schema[id_col].dataType
    if kind.simpleString() == "bigint":
        shares = [i / buckets for i in range(1, buckets)]
        cuts = sorted(set(df.agg(F.percentile_approx(id_col, shares, 10 * buckets).alias("c")).first()["c"] or []))
    else:  # ids that have no percentiles: those of a sample of ``buckets`` rows that hash lowest
        some = df.where(F.col(id_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(buckets)
        cuts = sorted({r[0] for r in some.collect()}, key=lambda v: v.encode() if isinstance(v, str) else v)
    listed = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if kind.simpleString() == "bigint" else F.array(*map(F.lit, cuts))
    df = df.withColumn("_range", F.size(F.filter(listed, lambda c: c <= F.col(id_col))) if cuts else F.lit(0))
    tops = {r["_range"]: r["top"] for r in df.groupBy("_range").agg(F.max(id_col).alias("top")).collect()}
    order = sorted(tops, reverse=True)
    guest_of = {tops[below]: above for above, below in zip(order, [*order[1:], *order[:1]], strict=True)} if order else {}
    null_guest = guest_of.pop(None, None)
    to = F.lit(null_guest).cast("int")
    found = F.col(id_col).isNull() if null_guest is not None else F.lit(False)
    if guest_of:
        spark = df.sparkSession
        table = spark.createDataFrame(list(guest_of.items()), StructType([StructField("_top", kind), StructField("_to", IntegerType())]))  # a row for each range
        guests = df.where(found | F.col(id_col).isin(list(guest_of))).join(F.broadcast(table), F.col(id_col) == F.col("_top"), "left")
        guests = guests.withColumn("_range", F.coalesce("_to", to)).drop("_top", "_to")
    else:
        guests = df.where(found).withColumn("_range", to)
    both = df.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    w = Window.partitionBy("_range").orderBy("_guest", F.col(id_col).desc_nulls_last(), *cols)
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols}).where("_guest = 0").drop("_guest", "_range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 1.386, high: float = 4.606) -> DataFrame:
    """(id, text, fp): the fingerprint of every row's whole text under the table's own lexicon.

    Null and empty texts have the fingerprint of no terms; equal texts have
    equal ones; repeated rows give repeated results; an empty table gives an
    empty result; other columns are not read.
    """
    known = lexicon(docs, text_col, low, high)
    return with_fingerprint(docs.select(column(id_col), text(text_col).alias("text")), F.col("text"), known, "fp")


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 1.386, high: float = 4.606) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses.

    The edited text has its last half (rounded down, in code points) replaced
    by the first as many code points, or all, of the text that follows in
    descending id order.
    """
    known = lexicon(docs, text_col, low, high)
    own = with_fingerprint(docs.select(column(id_col).alias("_id"), text(text_col).alias("t")), F.col("t"), known, "fp")
    pairs = with_next(own, "_id", ["t", "fp"], 4 * partitions(docs.sparkSession))
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("t", F.lit(1), n - half), F.substr("next_t", F.lit(1), half))
    pairs = pairs.select("_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    pairs = with_fingerprint(pairs, F.col("edited"), known, "edited_fp")
    return pairs.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
