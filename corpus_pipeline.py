"""A corpus in four stages: toxic documents go, one of each group of near copies stays, sources are mixed to target weights, the mix is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs; all but the last return the
columns of documents. An empty table stays empty through all stages; nulls,
empty texts and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm import jaccard, mixing, packing, queries, toxicity
from galeframe.llm.common import delete, read, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score under 0.5; learns from the labels of the stage's own documents outside the held-out fold."""
    model = toxicity.held_out_fit(docs, read(spark, sf_dir, "labels"))
    score = "_toxicity" + "_" * max(map(len, docs.columns))  # no column of documents is as long
    return toxicity.toxicity_scores(docs, model, keep=docs.columns, out_col=score).where(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: five-word shingles, Jaccard similarity 0.8."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes blocks of words by source towards the target weights; a document comes as often as its words are taken, at most three times."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of 4,096 tokens at most."""
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: A learned model, hashed orders and a tokenizer aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet in the shared folder and read again, and goes when the next one is written."""
    docs = read(spark, sf_dir, "documents")
    shared, before = shared_folder(spark), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                delete(spark, before)
            before = path
    return docs
