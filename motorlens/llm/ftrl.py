"""Logistic regression with follow-the-regularised-leader (FTRL-proximal) updates on hashed sparse rows.

The model is fitted on a bounded sample of labelled rows (``max_rows``, a documented parameter): the
labelled ids with the smallest hashes. Everything else, scoring included, covers all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlens.llm.shared import chunks, crc_remainder, release, small_batches

#: Features of documents: (bytes, offsets) -> (row pointer, bucket of each feature, value of each feature).
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Ftrl:
    """Per-coordinate FTRL-proximal. The last weight is the bias, which is not regularised."""

    def __init__(self, bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        b = self.bias()
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x + b, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        g, n = p - y, self.n[-1]
        self.z[-1] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * b
        self.n[-1] = n + g * g


def pack_row(at: np.ndarray, x: np.ndarray) -> bytes:
    """A sparse row in few bytes: steps between its ascending buckets, its distinct values, and which value each has."""
    steps, (values, which) = np.diff(at, prepend=0), np.unique(x.astype("<f4"), return_inverse=True)
    kinds = ["<u2" if (n := int(v.max(initial=0))) < 1 << 16 else "<u4" for v in (steps, which)]
    if len(values) <= 256:
        kinds[1] = "u1"
    head = np.array([len(at), len(values), *(np.dtype(k).itemsize for k in kinds)], "<u4")
    return head.tobytes() + values.tobytes() + steps.astype(kinds[0]).tobytes() + which.astype(kinds[1]).tobytes()


def unpack_row(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k, a, b = np.frombuffer(raw, "<u4", 4).tolist()
    values, mid = np.frombuffer(raw, "<f4", k, 16), 16 + 4 * k
    at = np.cumsum(np.frombuffer(raw, f"<u{a}", n, mid), dtype=np.int64)
    return at, values[np.frombuffer(raw, f"<u{b}", n, mid + a * n)] if n else np.zeros(0, "<f4")


def training_ids(labels: DataFrame, label: str, modulus: int, held: int, max_rows: int) -> DataFrame:
    """(doc_id, y, turn): at most max_rows labelled ids outside the held-out remainder, smallest hashes first.

    NULL ids or labels are left out; an id labelled twice counts once, with its larger label.
    """
    turn = F.xxhash64(F.col("doc_id"), F.lit(17))
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (crc_remainder("doc_id", modulus) != held))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .withColumn("turn", turn).orderBy("turn", "doc_id").limit(max_rows)
    )


def fit(docs: DataFrame, ids: DataFrame, features: Features, bits: int, epochs: int = 2, **rates: float) -> np.ndarray:
    """Weights (float32, bias last). docs has doc_id and text; ids is what training_ids gives, so its size is bounded.

    Features are made where the texts are; one task then learns from the bounded sample, in hash order, so that
    neither the number of partitions nor their order changes the model. No labelled row: zero weights, bias 0.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                ptr, at, x = features(data, off)
                yield pa.RecordBatch.from_arrays([
                    b.column("turn").slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo),
                    pa.array([pack_row(at[i:j], x[i:j]) for i, j in zip(ptr, ptr[1:])], pa.binary()),
                ], ["turn", "doc_id", "y", "row"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(bits, **rates)
        rows = [(y, row) for b in batches for y, row in zip(b.column("y").to_pylist(), b.column("row").to_pylist())]
        for _ in range(epochs):
            for y, row in rows:
                model.learn(*unpack_row(row), y)
        del rows
        release()
        w = model.weights().astype(np.float32)
        w[-1] = model.bias()
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    small_batches(docs.sparkSession)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = sample.select("doc_id", "text", "y", "turn").mapInArrow(make, "turn long, doc_id long, y int, row binary")
    got = rows.repartition(1).sortWithinPartitions("turn", "doc_id").mapInArrow(learn, "w binary").collect()
    w = [np.frombuffer(r["w"], np.float32) for r in got]
    return max(w, key=lambda v: float(np.abs(v).sum())) if w else np.zeros((1 << bits) + 1, np.float32)


def dot(w: np.ndarray, ptr: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sigmoid of sparse dot products, one for each row."""
    total = np.zeros(len(at) + 1)
    np.cumsum(w[at].astype(np.float64) * x, out=total[1:])
    return 1.0 / (1.0 + np.exp(-np.clip(total[ptr[1:]] - total[ptr[:-1]] + float(w[-1]), -35, 35)))


def scorer(spark, w: np.ndarray, features: Features):
    """Arrow UDF text -> score; w is broadcast (its size is fixed by the number of buckets)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(w)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [dot(shared.value, *features(data, off)) for _, _, data, off in chunks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def by_document(doc: np.ndarray, bucket: np.ndarray, n_docs: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bucket) with counts, as (row pointer, buckets, counts)."""
    keys, counts = np.unique((doc.astype(np.uint64) << np.uint64(bits)) | bucket, return_counts=True)
    ptr = np.searchsorted(keys, np.arange(n_docs + 1, dtype=np.uint64) << np.uint64(bits))
    return ptr, (keys & np.uint64((1 << bits) - 1)).astype(np.int64), counts
