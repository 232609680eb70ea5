"""Operator 13, vector code compression: every vector becomes one byte for each of its parts.

Components become integers floor(scale * x), and a vector is cut into ``parts`` equal parts. Each part position has a codebook
of at most ``entries`` entries, which starts as that part of the vectors with the smallest ids. A round sends every part to its
nearest entry and moves each entry to the floored mean of its parts; after the rounds all parts are assigned once more.

Codebooks are broadcast (parts * entries * width integers, whatever the table's size). Arrow batches compute the distances
as |x|^2 - 2 x.c + |c|^2 with int64 matrix products; int64 wraps, so the sum is right whenever the distance itself fits. The
first least entry wins. Sums and counts of a task's parts are added up in the task and merged by a shuffle on (part, entry).

Odd input: a vector that is NULL or holds NULL, NaN or an infinity is dropped. Values too large for int64 distances are
computed with Python's integers; an error or a sum of errors beyond a long is NULL. Vectors are compared at the commonest
length (the shortest of several): the others come back with NULL code and error. A length that ``parts`` does not divide is
filled up with zeros at the end. Rows that share an id are separate rows, by vector among themselves; a NULL id counts as the
largest. With fewer vectors than entries the codebooks are smaller. An empty table gives no rows. NULL labels are one label.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.llm.shared import Scratch, fresh, plain_reads, sized

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers up to this size have distances in int64 (for parts of up to 32 components), and sums of 2^35 rows.
NARROW = 1 << 28
#: Vectors that are worked on at once.
BLOCK = 512


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(flat: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) as int64, or as Python's integers."""
    if wide:
        return np.array([math.floor(Fraction(x) * scale) for x in flat.tolist()], dtype=object)
    return np.floor(flat.astype(np.float64) * scale).astype(np.int64)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part: x is vector, part, component; books is part, entry, component."""
    xs = x.transpose(1, 0, 2)
    d = (xs * xs).sum(2)[:, :, None] - 2 * np.matmul(xs, books.transpose(0, 2, 1)) + (books * books).sum(2)[:, None, :]
    at = d.argmin(2)
    return at.T, np.take_along_axis(d, at[:, :, None], 2)[:, :, 0].T


class Coder:
    """Codebooks over vectors of one length."""

    def __init__(self, length: int, parts: int, scale: int, wide: bool):
        self.length, self.parts, self.scale, self.width = length, parts, scale, -(-length // parts)
        self.wide = wide or self.width > 32

    def cut(self, vectors: pa.Array) -> Iterator[np.ndarray]:
        """Blocks of vectors as integers: vector, part, component."""
        for lo in range(0, len(vectors), BLOCK):
            block = vectors.slice(lo, BLOCK)
            flat = integers(block.flatten().to_numpy(zero_copy_only=False), self.scale, self.wide).reshape(len(block), self.length)
            out = np.zeros((len(block), self.parts * self.width), flat.dtype)
            out[:, : self.length] = flat
            yield out.reshape(len(block), self.parts, self.width)

    def first_books(self, rows: list) -> np.ndarray:
        vectors = pa.array([r[0] for r in rows], pa.list_(pa.float64()))
        return np.concatenate(list(self.cut(vectors))).transpose(1, 0, 2)

    def totals(self, vectors: DataFrame, books: np.ndarray) -> DataFrame:
        """part, entry, n and the sums s0, s1, ... of the parts assigned to each entry (as text for wide integers)."""
        shared, (parts, entries, width) = vectors.sparkSession.sparkContext.broadcast(books), books.shape
        names = [f"s{j}" for j in range(width)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros(books.shape, books.dtype), np.zeros((parts, entries), np.int64)
            for b in batches:
                for x in self.cut(b.column(0)):
                    codes, _ = nearest(x, shared.value)
                    for p in range(parts):
                        order = np.argsort(codes[:, p], kind="stable")
                        found, starts, counts = np.unique(codes[order, p], return_index=True, return_counts=True)
                        n[p, found] += counts
                        if width:
                            sums[p, found] += np.add.reduceat(x[order, p], starts, axis=0)
            p, e = np.nonzero(n)
            got = sums[p, e]
            columns = [pa.array(list(map(str, got[:, j])) if self.wide else got[:, j]) for j in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), *columns], ["part", "entry", "n", *names])

        kind = "string" if self.wide else "long"
        schema = ", ".join(["part int, entry int, n long", *(f"{c} {kind}" for c in names)])
        each = vectors.mapInArrow(run, schema)
        if not self.wide:
            return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))

        def add(rows: pd.DataFrame) -> pd.DataFrame:  # one row for each task
            return pd.DataFrame({"part": rows["part"][:1], "entry": rows["entry"][:1], "n": [rows["n"].sum()], **{c: [str(sum(map(int, rows[c])))] for c in names}})

        return each.groupBy("part", "entry").applyInPandas(add, schema)

    def moved(self, vectors: DataFrame, books: np.ndarray) -> np.ndarray:
        """The codebooks after one round; unused entries stay."""
        out = books.copy()
        for r in self.totals(vectors, books).collect():  # parts * entries rows at most
            out[r["part"], r["entry"]] = [int(s) // r["n"] for s in r[3:]]
        return out

    def encode(self, spark: SparkSession, books: np.ndarray):
        """A function of sound vectors of the length: hexadecimal code and error."""
        shared, most = spark.sparkContext.broadcast(books), (1 << 63) - 1

        @F.arrow_udf("code string, error long")
        def run(vectors: pa.Array) -> pa.Array:
            codes, errors = [], []
            for x in self.cut(vectors):
                at, d = nearest(x, shared.value)
                raw = at.astype(np.uint8).tobytes().hex()
                codes += [raw[i : i + 2 * self.parts] for i in range(0, len(raw), 2 * self.parts)]
                errors += [e if e <= most else None for e in d.sum(1).tolist()]
            return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["code", "error"])

        return run


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry, component."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(the sound rows of vectors with columns code and error, in place of columns of these names; the codebooks as an
    array of part, entry, component)."""
    if not (0 < entries <= 256 and parts > 0):
        raise ValueError("a code is one byte for each part")
    spark = vectors.sparkSession
    plain_reads(spark)
    rows = vectors.where(sound(F.col(vector)))
    largest = F.coalesce(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    found = rows.select(F.size(vector).alias("length"), largest.alias("largest")).groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.max("largest").alias("largest")).orderBy(F.desc("n"), "length").first()
    rest = [F.col(f"`{c}`") for c in vectors.columns if c.lower() not in ("code", "error")]
    if found is None:
        return rows.select(*rest, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    coder = Coder(found["length"], parts, scale, found["largest"] * scale >= NARROW)
    alike = F.size(vector) == found["length"]
    mine = rows.where(alike).select(vector)
    first = rows.where(alike).orderBy(F.col(key).asc_nulls_last(), vector).select(vector).limit(entries).collect()
    books = coder.first_books(first)
    for _ in range(rounds):
        books = coder.moved(mine, books)
    got = fresh("coded", vectors)
    run = coder.encode(spark, books)
    same = rows.where(alike).withColumn(got, run(F.col(vector)))
    out = same.select(*rest, F.col(f"{got}.code").alias("code"), F.col(f"{got}.error").alias("error"))
    others = rows.where(~alike)
    if not others.isEmpty():
        out = out.unionByName(others.select(*rest, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    return out, books


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    out, books = compress(vectors.select("vec_id", "embedding", "label"))
    coded = Scratch(spark, "vector-codes").save(out.select("vec_id", "label", "code", "error"), "coded")
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    each = labels.select("of", F.expr("try_cast(total AS long)").alias("label_error"))
    joined = coded.join(sized(each, each.count()), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    distance = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps, book = [], "b0"
    for r in range(1, ROUNDS + 2):
        steps.append(f"""
d{r} AS (SELECT p.r, p.part, b.entry, {distance} AS d FROM p JOIN {book} b USING (part)),
a{r} AS (SELECT r, part, entry, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)""")
        if r <= ROUNDS:
            steps.append(f"""
s{r} AS (SELECT part, entry, j, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(range(len(p.x))) AS j, unnest(p.x) AS v FROM a{r} a JOIN p USING (r, part)) GROUP BY ALL),
m{r} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM s{r} GROUP BY part, entry),
b{r} AS (SELECT part, entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN m{r} m USING (part, entry))""")
            book = f"b{r}"
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM e),
p AS (SELECT r, vec_id, i AS part, x[i * len(x) // {PARTS} + 1 : (i + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) t(i)),
b0 AS (SELECT part, k - 1 AS entry, x FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id, r) AS k FROM p) WHERE k <= {ENTRIES}),
{",".join(steps)},
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS + 1} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {book})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h
"""


SQL = _sql()
