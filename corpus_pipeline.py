"""A training corpus from raw documents: five stages, each written and read again.

toxicity (rejected documents go) - exact dedup - n-gram Jaccard join (one document of
each group stays) - mixing sources to target weights - BPE encoding and decoding.
Each stage calls one operator of ``twinlens.llm`` and works on all that its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinlens.llm import bpe, exact_dedup, jaccard_join, mixing, queries, toxicity
from twinlens.llm._store import Scratch
from twinlens.sources.workers import ship_package

#: Four fifths of the tokens that are left, sources by equal weights within their language and domain.
MIXTURE = mixing.Plan(share=0.8, max_epochs=2)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = queries.learnable(queries.table(spark, sf_dir, "labels"), 3, 1)
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select_mixture(docs, MIXTURE).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(docs, queries.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: The scores of a fitted model and the seeded order are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the table documents."""
    ship_package(spark)
    store = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
