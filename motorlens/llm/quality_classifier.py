"""Operator 4, quality classifier: hashed word n-grams, FTRL logistic regression, sparse dot products.

Tokens are runs of letters/digits (non-ASCII included) and runs of other visible ASCII, case kept; features are
their 1- and 2-grams hashed into ``2**bits`` buckets, valued 1 + log(count) and scaled to unit length per text.
NULL and empty texts have no features and score as the bias alone. Repeated rows score alike. Only ``doc_id`` and
``text`` are read; other columns pass through :func:`score`, and an input column named as the output is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.llm import ftrl
from motorlens.llm.shared import TOKEN_CLASS, Scratch, crc_remainder, fresh, hashes, ngram_hashes, segments, sized

BITS = 18
MAX_ROWS = 20_000
THRESHOLD = 0.3


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = segments(data, off, TOKEN_CLASS)
    h = hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    pair, same = ngram_hashes(h, 2), doc[1:] == doc[:-1]
    shift = np.uint64(64 - bits)
    ptr, at, n = ftrl.by_document(np.concatenate([doc, doc[1:][same]]), np.concatenate([h, pair[same]]) >> shift, len(off) - 1, bits)
    x = 1.0 + np.log(n)
    norm = np.zeros(len(x) + 1)
    np.cumsum(x * x, out=norm[1:])
    return ptr, at, x / np.repeat(np.sqrt(norm[ptr[1:]] - norm[ptr[:-1]]), np.diff(ptr))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights learnt from labels.quality of rows whose crc32 remainder by 5 is not 0."""
    ids = ftrl.training_ids(labels, "quality", 5, 0, max_rows)
    return ftrl.fit(docs, ids, features, BITS, epochs=3, alpha=1.0, l1=0.05, l2=0.01)


def score(docs: DataFrame, w: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out: 0 to 1, higher means better quality."""
    return docs.withColumn(out, ftrl.scorer(docs.sparkSession, w, features)(F.col(text)))


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. A NULL doc_id is held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs, whatever their names.

    Scores depend on the text alone, so rows are told apart by doc_id where it identifies them: only doc_id and text go
    through Python, and the rejected ids are taken off. Where ids are NULL or repeated, whole rows are scored."""
    scratch = Scratch(docs.sparkSession, "quality-keep")
    w = train(docs, labels)
    scored = scratch.save(score(docs.select("doc_id", "text"), w, out="score").select("doc_id", (F.col("score") >= threshold).alias("good")), "scored")
    rows, ids, named = scored.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_if(~F.col("good"))).first()
    if ids == rows and scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rejected = scored.where("not good").select("doc_id")
        return docs.join(sized(rejected, named), "doc_id", "left_anti").select(docs.columns)
    name = fresh("quality", docs)
    return score(docs, w, out=name).where(F.col(name) >= threshold).drop(name)
