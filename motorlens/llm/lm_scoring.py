"""Operator 10, language-model scoring by cross-entropy difference.

Two bigram models, of target texts and of the background (all texts), share one vocabulary, one order and one smoothing, so
they differ in counts alone:

    p(w | c) = (n(c, w) + MU * p(w)) / (n(c) + MU)        p(w) = (n(w) + ADD) / (N + ADD * (V + 1))

A text's score is the mean over its words of -log p_target + log p_background: below 0, the text is closer to the target.
A text is never scored by what it has itself put into a model: its own counts are taken out of every n before (leaving one
out), so targets have no advantage from having been seen, and a text that occurs twice differs from one that occurs once.

The model grows with the corpus: every word and every pair of words counts, however rare, and nothing is cut off. Nothing
that grows with the vocabulary comes to the driver or is broadcast. Counting and looking up are one exchange there and one
back: each batch of texts sends its distinct keys with their counts, cut in ranges of keys; the task of a range adds up the
counts of all batches and answers each batch with the totals of its own keys, in the same order; the answers meet the
batch's texts, which are then scored. A common word or pair is one entry for each batch, so it makes no task large. Keys
carry 20 bits more than the corpus has words, so that one meets another with a probability below one in a million.

Target texts are documents labelled quality 1 and not toxic. Texts that are NULL, empty or without words have no words and
score 0. Repeated rows count as often as they occur and score alike. Without target texts, both models are the
background's and all scores are 0. Rows that are not ``counted`` are scored by the models of the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlens.llm.shared import chunks, hashes, pack, pack_sorted, release, segments, sized, small_batches, unpack, unpack_sorted

MU, ADD = 4.0, 0.5
#: Hash of the text's beginning, and what tells keys of pairs from those of words.
BEGIN, PAIR = 0x1F83D9ABFB41BD6B, 0x3C6EF372FE94F82B
#: Bytes of text of one batch, and bytes of the corpus for each range of keys at most.
BATCH, RANGE_BYTES = 4 << 20, 48 << 20
#: Ranges for each shuffle partition: several, so that hashing them to partitions comes out even.
RANGES_EACH = 3


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = segments(data, off)
    return hashes(data, starts, ends, lower=True), first


def contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word, or BEGIN."""
    context = np.empty(len(h), np.uint64)
    context[1:] = h[:-1]
    context[first[:-1][first[:-1] < first[1:]]] = BEGIN
    return context


class Batch:
    """The distinct keys of a batch of texts: words (even, the text's beginning among them) and pairs (odd), ascending.

    word, context, pair: the place of each occurrence's keys among them; doc: its text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, bits: int):
        h, first = _words(data, off)
        self.sizes, self.doc = np.diff(first), np.repeat(np.arange(len(off) - 1), np.diff(first))
        context = contexts(h, first)
        pairs = ((context << np.uint64(17)) | (context >> np.uint64(47))) ^ h ^ np.uint64(PAIR)
        with np.errstate(over="ignore"):
            pairs = pairs * np.uint64(0xD6E8FEB86659FD93)
        shift, one = np.uint64(65 - bits), np.uint64(1)
        full = self.sizes > 0
        begin = np.full(int(full.sum()), BEGIN, np.uint64)
        keys = np.concatenate([(h >> shift) << one, (begin >> shift) << one, ((pairs >> shift) << one) | one])
        self.keys, at = np.unique(keys, return_inverse=True)
        n = len(h)
        self.word, self.pair, self.begins, self.begin_doc = at[:n], at[n + len(begin) :], at[n : n + len(begin)], np.flatnonzero(full)
        self.context = np.empty(n, np.int64)
        self.context[1:] = self.word[:-1]
        self.start = np.zeros(n, bool)
        self.start[first[:-1][full]] = True
        self.context[self.start] = self.begins

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """Occurrences of each key, weighted by text."""
        w = weight[self.doc]
        n = np.bincount(self.word, weights=w, minlength=len(self.keys)) + np.bincount(self.pair, weights=w, minlength=len(self.keys))
        return (n + np.bincount(self.begins, weights=weight[self.begin_doc], minlength=len(self.keys))).astype(np.uint32)

    def own(self, at: np.ndarray) -> np.ndarray:
        """How often the text of each occurrence has the key at its place."""
        _, inverse, n = np.unique(self.doc * len(self.keys) + at, return_inverse=True, return_counts=True)
        return n[inverse].astype(np.float64)


def begin_key(bits: int) -> int:
    return (BEGIN >> (65 - bits)) << 1


def losses(b: Batch, n: np.ndarray, t: np.ndarray, corpus: tuple[int, int, int], counted: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """-log p summed over each text, background and target. n, t: totals of the batch's keys. corpus: V, N, N of targets."""
    word, pair = b.own(b.word), b.own(b.pair)
    context = np.empty(len(word))
    context[1:] = word[:-1]
    context[b.start] = 1.0
    out = []
    for total, size, took in ((n, corpus[1], counted), (t, corpus[2], counted & target)) if corpus[2] else ((n, corpus[1], counted),) * 2:
        mine = took[b.doc].astype(np.float64)
        uni = (total[b.word] - mine * word + ADD) / (size - mine * b.sizes[b.doc] + ADD * (corpus[0] + 1))
        p = (total[b.pair] - mine * pair + MU * uni) / (total[b.context] - mine * context + MU)
        out.append(np.bincount(b.doc, weights=-np.log(p), minlength=len(b.sizes)).astype(np.float64))
    return out


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about size bytes."""
    held, n = [], 0
    for rb in batches:
        if held and n + rb.nbytes > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
        if rb.num_rows:
            held.append(rb)
            n += rb.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _asking(others: T.StructType) -> T.StructType:
    blob = T.BinaryType()
    head = [T.StructField("rows", T.ArrayType(others)), *[T.StructField(c, blob) for c in ("texts", "offsets", "flags")]]
    return T.StructType([T.StructField("batch", T.LongType()), T.StructField("p", T.IntegerType()), *[T.StructField(c, blob) for c in ("a", "b", "c")], *head])


def score(docs: DataFrame, text: str = "text", target: str = "target", counted: str | None = None, out: str = "lm") -> DataFrame:
    """docs without text, target and counted, with struct out (n_words, background, target): words, sums of losses in nats.

    An input column named as out is replaced. target: boolean, whether the row is a target text. counted: boolean, whether the row counts in the models (all do)."""
    spark, flags = docs.sparkSession, [target, *([counted] if counted else [])]
    small_batches(spark)
    others = T.StructType([f for f in docs.schema if f.name not in (text, out, *flags)])
    schema = _asking(others)
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).head()[0] or 0
    ranges = RANGES_EACH * max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    bits = min(64, 20 + max(20, math.ceil(math.log2(size + 1))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 32
        edges = (np.arange(1, ranges, dtype=np.float64) * (2.0**bits / ranges)).astype(np.uint64)
        for rb in gathered(batches, BATCH):
            rest = pa.StructArray.from_arrays([rb.column(c) for c in others.names], others.names) if others.names else pa.nulls(rb.num_rows)
            marks = [rb.column(c).fill_null(False).to_numpy(zero_copy_only=False) for c in flags]
            for lo, hi, data, off in chunks(rb.column(text), BATCH):
                of_target = marks[0][lo:hi]
                of_count = marks[1][lo:hi] if counted else np.ones(hi - lo, bool)
                b = Batch(data, off, bits)
                n, t = b.counts(of_count.astype(float)), b.counts((of_count & of_target).astype(float))
                cuts = [0, *np.searchsorted(b.keys, edges).tolist(), len(b.keys)]
                cells = [[pack_sorted(b.keys[i:j]), pack(n[i:j]), pack(t[i:j])] for i, j in zip(cuts, cuts[1:])]
                rows = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(ranges + 1, np.int32), np.int32(hi - lo))), rest.slice(lo, hi - lo))
                only = lambda x: pa.array([None] * ranges + [x], pa.binary())
                columns = [pa.array([batch] * (ranges + 1), pa.int64()), pa.array([*range(ranges), batch % ranges], pa.int32())]
                columns += [pa.array([*(c[k] for c in cells), None], pa.binary()) for k in range(3)]
                raw = data.tobytes()
                columns += [rows, only(pa.compress(raw, codec="zstd", asbytes=True)), only(off.astype(np.int64).tobytes()), only(np.stack([of_target, of_count]).tobytes())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                batch += 1
            release()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's rows come one after another: totals of its keys, then the share of each batch. Texts pass through."""
        first = np.uint64(begin_key(bits))

        def close(p: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            keys = [unpack_sorted(a) for _, a, _, _ in held]
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            n, t = (np.bincount(at, weights=np.concatenate([unpack(r[k], "<u4") for r in held]), minlength=len(known)).astype(np.int64) for k in (2, 3))
            words = (known & np.uint64(1) == 0) & (known != first) & (n > 0)
            about = np.array([words.sum(), n[words].sum(), t[words].sum()], np.int64).tobytes()
            ends = np.cumsum([len(k) for k in keys])
            done = [(pack(n[at[e - len(k) : e]]), pack(t[at[e - len(k) : e]])) for k, e in zip(keys, ends)]
            columns = [pa.array([r[0] for r in held], pa.int64()), pa.array([p] * len(held), pa.int32()), *[pa.array([d[k] for d in done], pa.binary()) for k in range(2)], pa.array([about] * len(held), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(held), f.type) for f in arrow[5:]]], schema.names)

        last, held = None, []
        for rb in batches:
            arrow = rb.schema
            arrow = [arrow.field(k) for k in range(len(arrow))]
            head = pc.is_valid(rb.column("texts"))
            if (heads := rb.filter(head)).num_rows:
                yield pa.RecordBatch.from_arrays([heads.column(0), pa.array([-1] * heads.num_rows, pa.int32()), *heads.columns[2:]], schema.names)
            asked = rb.filter(pc.invert(head))
            for i, p, *cells in zip(*(asked.column(k).to_pylist() for k in range(5))):
                if p != last and held:
                    yield from close(last, held)
                    held = []
                last = p
                held.append((i, *cells))
        if held:
            yield from close(last, held)

    names = [*others.names, out]
    result = T.StructType([*others.fields, T.StructField(out, T.StructType([T.StructField("n_words", T.LongType()), T.StructField("background", T.DoubleType()), T.StructField("target", T.DoubleType())]))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's rows come one after another: its texts, then the answers in the order of its keys."""

        def close(head: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
            off = np.frombuffer(head.column("offsets")[0].as_py(), np.int64)
            data = np.frombuffer(pa.decompress(head.column("texts")[0].as_py(), int(off[-1]), codec="zstd", asbytes=True), np.uint8)
            of_target, of_count = np.frombuffer(head.column("flags")[0].as_py(), bool).reshape(2, -1)
            b = Batch(data, off, bits)
            n, t = (np.concatenate([unpack(r[k], "<i8") for r in held]) for k in (0, 1))
            corpus = np.sum([np.frombuffer(r[2], np.int64) for r in held], axis=0)
            both = losses(b, n, t, tuple(corpus.tolist()), of_count, of_target)
            lm = pa.StructArray.from_arrays([pa.array(b.sizes.astype(np.int64)), *map(pa.array, both)], ["n_words", "background", "target"])
            rows = head.column("rows")[0].values
            return pa.RecordBatch.from_arrays([*(rows.flatten() if others.names else []), lm], names)

        last, head, held = None, None, []
        for rb in batches:
            for k, (i, p) in enumerate(zip(rb.column(0).to_pylist(), rb.column(1).to_pylist())):
                if i != last and head is not None:
                    yield close(head, held)
                if i != last:
                    last, head, held = i, None, []
                if p < 0:
                    head = rb.slice(k, 1)
                else:
                    held.append(tuple(rb.column(c)[k].as_py() for c in (2, 3, 4)))
        if head is not None:
            yield close(head, held)

    asked = docs.select(*others.names, text, *flags).mapInArrow(ask, schema)
    answered = asked.repartition("p").sortWithinPartitions("p").mapInArrow(answer, schema)
    return answered.repartition("batch").sortWithinPartitions("batch", "p").mapInArrow(gather, result)


def targeted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, target of every row of docs."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id", F.lit(True).alias("good")).distinct()
    return docs.select("doc_id", "text").join(sized(good, good.count()), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("target"))


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, target_nats, background_nats (sums over the text), score (difference for each word)."""
    lm = score(targeted(docs, labels))
    difference = F.when(F.col("lm.n_words") > 0, (F.col("lm.target") - F.col("lm.background")) / F.col("lm.n_words")).otherwise(0.0)
    return lm.select("doc_id", F.col("lm.n_words").alias("n_words"), F.col("lm.target").alias("target_nats"), F.col("lm.background").alias("background_nats"), difference.alias("score"))
