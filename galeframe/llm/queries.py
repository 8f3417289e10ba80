"""The queries of the corpus operators, with their production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm import fingerprints, jaccard, licenses, lm, media, mixing, negatives, packing, resampling, sharding, tokens, toxicity, urls
from galeframe.llm.common import fold, read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.lm_scores(read(spark, sf_dir, "documents"), fold("doc_id") != 1)
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_probe(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(mixing.mix(read(spark, sf_dir, "documents"))).withColumnRenamed("_id", "doc_id")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_join(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.held_out_fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs, model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op8_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op8_licenses`` and its SQL leave out: runs of words anywhere, and whole licences."""
    return licenses.license_spans(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_avi(read(spark, sf_dir, "documents"))
    features = media.media_features(stored.select(F.struct("doc_id", "n_bytes").alias("key"), "media"), id_col="key")
    return features.select("key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("clips").alias("n_clips"))


#: Rules of op11 (host and path, verdict): fixed values.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Patterns that decide where no rule fits: names of hosts that sell or spam.
URL_PATTERNS = ("||spam-farm.", "||cheap-pills.", "||casino-win.", "||free-bets.")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule decides, else a pattern (block), else the url is allowed; ``pattern`` is the one that fits, if any."""
    rules = urls.rules_table(spark, [*[(r, f"||{r}", v, 1) for r, v in URL_RULES], *[(p, p, "block", 2) for p in URL_PATTERNS]])
    fit = urls.url_verdicts(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    rule, verdict = F.when(F.col("fit.tier") == 1, F.col("fit.rule_id")), F.coalesce("fit.verdict", F.lit("allow"))
    return fit.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("fit.pattern").alias("pattern"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.hard_negatives(v, F.col("vec_id") % 100 == 0)


def _templates() -> str:
    return ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in licenses.TEMPLATES.items())


def _bigrams(col: str) -> str:
    ws = f"list_filter(regexp_split_to_array(lower({col}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(list_transform(range(1, len({ws})), lambda i: ({ws})[i] || ' ' || ({ws})[i + 1]))"


LICENSES_SQL = f"""
with t as (select license, {_bigrams("body")} as g from (values {_templates()}) v(license, body)),
d as (select doc_id, coalesce(text, '') as body from documents),
u as (select doc_id, -1 as unit, body from d
      union all select doc_id, unnest(range(0, len(string_split(body, chr(10))))) as unit, unnest(string_split(body, chr(10))) as body from d),
w as (select doc_id, unit, list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda w: w <> '') as ws from u),
s as (select doc_id, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as g from w where len(ws) >= 2),
m as (select doc_id, unit, license, 2.0::double * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) as dice
      from s, t where len(s.g) between len(t.g) * 2 / 3.0 and len(t.g) * 1.5)
select doc_id, license, cast(arg_max(unit, {{'a': dice, 'b': -unit}}) as integer) as unit, max(dice) as dice
from m where dice >= 0.8 group by doc_id, license
"""

_URL_RULES = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in URL_RULES)
_URL_PATTERNS = ", ".join(f"('{p}', '.{p[2:]}')" for p in URL_PATTERNS)
URLS_SQL = f"""
with u as (select page_id, coalesce(url, '') as url from pages),
p as (select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') as host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from u),
f as (select distinct host, path, {{'t': 1, 'n': -length(rule), 'k': rule}} as place, rule, v.verdict, '||' || rule as pattern from p, (values {_URL_RULES}) v(rule, rh, rp, verdict)
      where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
      union all
      select distinct host, path, {{'t': 2, 'n': -length(v.pattern), 'k': v.pattern}}, null, 'block', v.pattern from p, (values {_URL_PATTERNS}) v(pattern, label) where contains('.' || host, label)),
b as (select host, path, arg_min({{'rule': rule, 'verdict': verdict, 'pattern': pattern}}, place) as b from f group by host, path)
select page_id, p.host, p.path, b.rule as rule, coalesce(b.verdict, 'allow') as verdict, b.pattern as pattern from p left join b on p.host = b.host and p.path = b.path
"""

_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _listed(table: str, key: str) -> str:
    return f"select {key} as k, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{_WORDS}') as ws from {table}"


RESAMPLING_SQL = f"""
with recursive step as (select range as b, range as c, 0 as k from range(256) union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
crc_table as (select list(c order by b) as c from step where k = 8),
d as ({_listed("documents", "doc_id")}), t as ({_listed("benchmark", "item_id")}),
words as (select distinct w from (select unnest(ws) as w from d union all select unnest(ws) from t)),
bytes as (select w, list_transform(range(1, length(hex(encode(w))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::bigint) as bs from words),
hashed as (select w, xor(list_reduce(list_prepend(4294967295, bs), lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, crc_table),
du as (select k, unnest(ws) as w from d), df as (select k, bucket from du join hashed using (w)),
tu as (select unnest(ws) as w from t), tf as (select bucket from tu join hashed using (w)),
s as (select bucket, count(*) as s from df group by bucket), g as (select bucket, count(*) as t from tf group by bucket),
gains as (select range as bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from df) + 10000)::double) / ((coalesce(s, 0) + 1)::double * ((select count(*) from tf) + 10000)::double)))::bigint as gain
          from range(10000) left join s on range = s.bucket left join g on range = g.bucket),
weighed as (select k, count(*) as n, sum(gain)::bigint as weight from df join gains using (bucket) group by k),
scored as (select d.k as doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || d.k), 1, 8))::bigint::double as h from d left join weighed on d.k = weighed.k),
noisy as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from scored),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place from noisy where n_features >= 20)
select noisy.doc_id, n_features, weight, score, case when place <= (select count(*) from placed) * 10 // 100 then place end as rank from noisy left join placed on noisy.doc_id = placed.doc_id
"""

NEGATIVES_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = v.label as alike, v.vec_id as id, list_inner_product(a.x, v.x)::bigint as score from v a, v where a.vec_id % 100 = 0 and a.vec_id <> v.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where alike qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id)::integer as rank
      from p join s on p.anchor_id = s.anchor_id and not alike and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
"""

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_fingerprints, op3_mixing, op4_jaccard_join, op5_packing, op6_sharding, op7_toxicity, op8_licenses, op8_license_spans, op9_token_counts, op10_media, op11_url_filters, op12_importance_resampling, op13_hard_negatives)}
SQL = {"op8_licenses": LICENSES_SQL, "op11_url_filters": URLS_SQL, "op12_importance_resampling": RESAMPLING_SQL, "op13_hard_negatives": NEGATIVES_SQL}
