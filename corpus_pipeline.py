"""A corpus pipeline over the training-data operators: filter, deduplicate, mix, tokenise.

Every stage takes all that its predecessor kept, is written as Parquet and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motorlens.llm import byte_bpe, exact_dedup, ngram_join, quality_classifier, source_mix
from motorlens.llm.shared import Scratch, documents, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text, the largest doc_id."""
    return exact_dedup.keep(docs, "max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the smallest doc_id."""
    return ngram_join.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those not taken go."""
    return source_mix.resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and the digests of the ids and of what they decode to, for each row."""
    both = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), byte_bpe.default_ranks())
    n_tokens, ids_sha, decoded_sha = byte_bpe.digests()
    return both.select("doc_id", "source", n_tokens, "ids", ids_sha, decoded_sha)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("source mix", mix), ("byte BPE", tokens)]

#: The first stage learns a model and the last runs a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
