"""Operator 8, mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash and laid end to end, up to ``max_repeats`` times over. An entry's virtual
finish time is the cumulative words of its source up to its end, divided by the source's target. Entries go by finish
time over all sources, and the mix is the longest prefix whose words fit the total budget.

Cumulative words come from distributed prefix sums (hash ranges of each source, then within a range), so that a source
with a third of all rows is spread over as many tasks as it has ranges. The cut is found on a histogram of finish times of
bounded size, then exactly inside the one range in which it falls.

Size: words `[^\\x20\\x09-\\x0D]+`; NULL and empty texts have size 0 and are never taken. A NULL source is a source of its
own, last in order. Repeated rows each count; ties of the hash go by id, then size. Reruns agree, whatever the partitions.
Empty input gives no rows. Only doc_id, source and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlens.llm.shared import Scratch, fresh, sized

WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
#: Ranges of finish time for each unit, and the last range, which is open.
RANGES, LAST = 1 << 14, 4 << 14
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 50_000
#: Rows aimed at in a hash range of a source.
RANGE_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, fraction: float = 1.0) -> DataFrame:
    """source, source_size, rank, target of each source: shares by weight, none above max_repeats times its size.

    Sources stand by cap / weight; with all before i at their caps, the level is what is left of the budget for each unit
    of weight. The first i that stays under its own cap ends the filling. One row for each source goes to one task."""
    by_rank, fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_rank)).withColumn("w", w.cast("long"))
    each = each.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("w"))
    each = each.select("*", F.row_number().over(fill).alias("i"), (F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1))).alias("capped"), F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("rest"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    budget = F.col("total") if fraction == 1.0 else F.floor(F.col("total") * fraction)
    each = each.withColumn("level", (budget - F.coalesce("capped", F.lit(0))) / F.col("rest"))
    stop = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("i", "level"))).over(Window.partitionBy())
    each = each.withColumn("stop", stop)
    target = F.when(F.col("stop").isNull() | (F.col("i") < F.col("stop.i")), F.col("cap").cast("double")).otherwise(F.col("stop.level") * F.col("w"))
    return each.select("source", "source_size", "rank", target.alias("target"), budget.cast("long").alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, fraction: float = 1.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, source, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "source-mix")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")).cast("binary"))
    sizes = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "sizes")
    sources = scratch.save(targets(sizes, weights, max_repeats, fraction), "sources")
    few = sources.count() <= BROADCAST_SOURCES
    most = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 1
    digits = max(1, math.ceil(math.log(most / RANGE_ROWS + 1, 16)))
    s = F.broadcast(sources) if few else sources
    rows = sizes.withColumnRenamed("source", "own").join(s, F.col("own").eqNullSafe(F.col("source"))).drop("own").withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("rank", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("rank", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = scratch.save(rows.withColumn("inside", F.sum("size").over(inside)).join(bases, ["rank", "range"]).withColumn("cumulative", F.col("base") + F.col("inside")).drop("base", "inside", "range"), "laid")
    scratch.drop(sizes)

    finish = lambda e: (F.col("cumulative") + e * F.col("source_size")) / F.col("target")
    place = lambda f, e: F.struct(f.alias("finish"), F.col("rank"), F.col("key"), F.col("doc_id"), F.col("size"), e.cast("int").alias("e"))
    taking = laid.where((F.col("target") > 0) & (F.col("size") > 0))
    entries = taking.withColumn("e", F.explode(F.array(*[F.lit(e) for e in range(max_repeats)]))).withColumn("finish", finish(F.col("e")))
    entries = entries.withColumn("slot", F.least(F.floor(F.col("finish") * RANGES), F.lit(LAST)).cast("long"))
    slots = entries.groupBy("slot").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    running = slots.withColumn("through", F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    cut = running.where("through > budget").orderBy("slot").select("slot", (F.col("through") - F.col("words")).alias("before")).head()
    if cut is None:  # all fit
        copies = F.when((F.col("target") > 0) & (F.col("size") > 0), F.lit(max_repeats)).otherwise(0)
        return laid.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).alias("taken"))
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    near = entries.where(F.col("slot") == cut["slot"]).select(place(F.col("finish"), F.col("e")).alias("place"), "size", "budget")
    out = near.withColumn("through", F.sum("size").over(order) + cut["before"]).where("through > budget").agg(F.min("place").alias("place"))
    # The first entry that does not fit: one row.
    fits = lambda e: F.when((F.col("target") > 0) & (F.col("size") > 0) & (place(finish(F.lit(e)), F.lit(e)) < F.col("place")), 1).otherwise(0)
    copies = sum((fits(e) for e in range(1, max_repeats)), fits(0))
    return laid.crossJoin(F.broadcast(out)).withColumn("copies", copies.cast("int")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def resample(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, with the columns of docs.

    doc_id should identify rows; rows that share an id, a source and a text are alike in the mix but for their copies,
    which are dealt to them by rank."""
    i, z, nth, mine, copies, copy = (fresh(c, docs) for c in ("id", "size", "nth", "mine", "copies", "copy"))
    scratch = Scratch(docs.sparkSession, "source-mix-copies")
    took = mix(docs.select("doc_id", "source", "text"), **options).where("copies > 0")
    took = scratch.save(took.select(F.col("doc_id").alias(i), F.col("source").alias(nth + "s"), F.col("size").alias(z), F.col("copies").alias(copies)), "copies")
    n = took.count()
    if took.select(i).distinct().count() == n and took.where(F.col(i).isNull()).isEmpty():
        out = docs.join(sized(took.select(F.col(i).alias("doc_id"), copies), n), "doc_id")
    else:
        took = took.withColumn(nth, F.row_number().over(Window.partitionBy(i, nth + "s", z).orderBy(F.desc(copies))))
        rows = docs.withColumn(z + "_", word_count(F.col("text")))
        rows = rows.withColumn(mine, F.row_number().over(Window.partitionBy("doc_id", "source", z + "_").orderBy("text")))
        out = rows.join(took, F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(nth + "s")) & (F.col(z + "_") == F.col(z)) & (F.col(mine) == F.col(nth)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS key,
                  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, (rank - 1) % 3 + 1 AS w, 3 * source_size AS cap, (3 * source_size) / ((rank - 1) % 3 + 1) AS ratio FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY ratio, rank) AS i,
              coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
              (sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest,
              (sum(source_size) OVER ())::BIGINT AS total FROM s2),
s4 AS (SELECT *, (total - capped) / rest AS level FROM s3),
s5 AS (SELECT min(i) AS stop, arg_min(level, i) AS lambda_level FROM s4 WHERE level * w <= cap),
s AS (SELECT source, source_size, rank, total, CASE WHEN i < stop THEN cap::DOUBLE ELSE lambda_level * w END AS target FROM s4, s5),
x AS (SELECT d.doc_id, d.size, d.key, s.*, sum(d.size) OVER (PARTITION BY s.rank ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cumulative
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
e AS (SELECT x.*, e, (cumulative + e * source_size)::BIGINT / target AS finish FROM x, (VALUES (0), (1), (2)) v(e) WHERE target > 0 AND size > 0),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, size, e ROWS UNBOUNDED PRECEDING) AS through FROM e),
t AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM q WHERE through <= total GROUP BY doc_id)
SELECT x.doc_id, x.size, x.source_size, x.target, coalesce(t.taken, 0)::BIGINT AS taken FROM x LEFT JOIN t USING (doc_id)
"""
