"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what goes on; its result is written as
Parquet in the shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from funnelweir.llm import bpe_codec, mixing, pii, quality, simhash
from funnelweir.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: SimHash, five words, similarity 0.8."""
    return simhash.without_near_copies(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to surrogates; ``n_chars`` is left as it was."""
    return pii.pseudonymized(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the chance that their rate gives; rates above 1 keep a document once."""
    mixer, _ = mixing.fit(docs, mixing.label_domains(table(spark, sf_dir, "labels")), mixing.MIX, "good")
    return mixing.sampled(docs, mixer)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the packed ids of each document that is left."""
    return bpe_codec.encode(docs, keep=False)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("surrogates", surrogates), ("mixture", mixture), ("token_ids", token_ids)]

#: SQL cannot express suffix arrays, fingerprints, keyed surrogates, fitted rates or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
