"""Operator 11, filter interaction audit: what each filter removes in every order of filters.

Five conditions make a mask for each document. Four read its text alone; the fifth, "copy of an earlier document", comes from
partition refinement: documents are split by code-point length, then by the hashes of successive blocks of growing length;
after each split, classes of one document drop out. One pass over the texts takes length and block hashes, so that the
splits move some fifty bytes a document. Texts of the classes that survive are read again and compared in full: they are grouped by
class *and text* with map-side combining, so that a hot text is one row for each task before anything is shuffled. Copies
with another than the smallest id are marked. Different texts with equal class (none, for sound hashes) are told apart by joining
on the text itself.

All counts follow from the number of documents of each (part, mask), at most 32 rows a part: a filter behind a set of
earlier filters removes the masks that have its bit and none of theirs, so 80 sums a part serve all 120 orders.

A NULL text is an empty one; a NULL lang is the part ''. A NULL doc_id is no copy of an earlier document, and no document is
a copy of it. Rows that share id and text count each and are not earlier than one another. A doc_id labelled twice counts
as good or toxic if one of its labels says so; labels without document count nothing. No documents give no rows. Only
doc_id, text, lang and doc_id, quality, toxic are read.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motorlens.llm.shared import Scratch, chunks, sized, small_batches

LETTERS = "ABCDE"
#: Code points where blocks end; the last block takes the rest.
BLOCKS = (64, 1024, 16384)

_UPPER, _SIGNS, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def failures(raw: bytes) -> int:
    """Bits 1 to 8: A under 200 words; B distinct words under half; C capitals over 3 in 100 code points; D a sign."""
    words = raw.split()  # of bytes: at exactly the ASCII white space that separates words
    points = len(raw.translate(None, _INNER))
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    signs = len(raw) != len(raw.translate(None, _SIGNS))
    return (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * capitals > 3 * points) + 8 * signs


def text_mask(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, data, off in chunks(texts):
            raw, at = data.tobytes(), off.tolist()
            out += [failures(raw[i:j]) for i, j in zip(at, at[1:])]
        return pa.array(out, pa.int32())

    return F.arrow_udf(run, "int")(text)


def classes(text: Column) -> list[Column]:
    """k0, k1, ...: the class of a text after each split, by length and then by one block more."""
    ends = [0, *BLOCKS]
    blocks = [F.substring(text, a + 1, b - a) for a, b in zip(ends, ends[1:])] + [F.substring(text, ends[-1] + 1, (1 << 31) - 2 - ends[-1])]
    keys = [F.char_length(text).cast("long")]
    for b in blocks:
        keys.append(F.xxhash64(keys[-1], b))
    return [k.alias(f"k{i}") for i, k in enumerate(keys)]


def refine(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The last classes (key) that hold several of rows (k0, k1, ...), and how many they are."""
    splits = len(BLOCKS) + 2
    for i in range(splits):
        held = scratch.save(rows.groupBy(f"k{i}").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(f"k{i}"), f"split{i}")
        n = held.count()
        rows = rows.join(sized(held, n), f"k{i}", "left_semi")
    return held.select(F.col(f"k{splits - 1}").alias("key")), n


def marked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part, mask for every row of docs, with bit 16 for copies of a text that a smaller doc_id has."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    last = f"k{len(BLOCKS) + 1}"
    coded = scratch.save(plain.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), *classes(F.col("text"))), "coded")
    shared, n = refine(coded, scratch)
    rows = coded.select("doc_id", "part", "mask", F.col(last).alias("key"))
    if not n:
        return rows.drop("key")
    again = plain.withColumn("key", classes(F.col("text"))[-1]).join(sized(shared, n), "key", "left_semi")
    texts = scratch.save(again.groupBy("key", "text").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).select("key", "low", "n"), "texts")
    mixed = scratch.save(texts.groupBy("key").agg(F.count(F.lit(1)).alias("different")).where("different > 1").select("key"), "mixed")
    bad = mixed.count()
    copies = texts.where("n > 1").select("key", "low")
    flag = lambda df: df.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("low"), 16).otherwise(0)).select("doc_id", "part", "mask")
    if not bad:
        return flag(rows.join(sized(copies, n), "key", "left"))
    sound = flag(rows.join(sized(mixed, bad), "key", "left_anti").join(sized(copies, n), "key", "left"))
    odd = plain.withColumn("key", classes(F.col("text"))[-1]).join(sized(mixed, bad), "key", "left_semi")
    lows = odd.groupBy(F.col("text").alias("same")).agg(F.min("doc_id").alias("low"))
    return sound.unionByName(flag(odd.withColumn("mask", text_mask(F.col("text"))).join(lows, F.col("text") == F.col("same"))))


def counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask, and those labelled quality 1 and toxic 1."""
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic")).where("good OR toxic")
    both = rows.join(known, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of letters and step, from part, mask, n, good, toxic."""
    k, factorial = len(letters), [1]
    for i in range(1, len(letters) + 1):
        factorial.append(factorial[-1] * i)
    pairs = [(prior, bit, factorial[prior.bit_count()] * factorial[k - 1 - prior.bit_count()]) for prior in range(1 << k) for bit in (1 << i for i in range(k)) if not prior & bit]
    behind = F.array(*[F.struct(F.lit(p).alias("prior"), F.lit(b).alias("bit"), F.lit(w).cast("long").alias("orders")) for p, b, w in pairs])
    each = masks.select("*", F.inline(behind))
    free, fails = F.col("mask").bitwiseAND(F.col("prior")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    sums = each.groupBy("part", "prior", "bit", "orders").agg(
        total(free & ~fails).alias("kept"), total(free & fails).alias("removed"), total(~free & fails).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(free & fails, "good").alias("good_lost"), total(free & fails, "toxic").alias("toxic_lost"),
    )
    sums = sums.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "bit")))
    bit = {c: 1 << i for i, c in enumerate(letters)}
    steps = [("".join(order), s + 1, sum(bit[c] for c in order[:s]), bit[order[s]]) for order in permutations(letters) for s in range(k)]
    orders = masks.sparkSession.createDataFrame(steps, "filter_order string, step int, prior int, bit int")
    return sums.join(F.broadcast(orders), ["prior", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "filter-audit")
    rows = marked(docs.select("doc_id", "text", "lang"), scratch)
    return audit(scratch.save(counts(rows, labels.select("doc_id", "quality", "toxic")), "masks"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda w: w <> '') AS words FROM d),
m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
b(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM b a, b b, b c, b d, b e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS prior FROM o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step::INT AS step, bit,
             sum(CASE WHEN mask & prior = 0 AND mask & bit = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & prior <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM h, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
