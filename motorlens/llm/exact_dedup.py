"""Operator 7, exact dedup over a log-structured merge index of text digests.

1. Memtables gather digest -> (smallest id, largest id, rows) and flush as sorted runs.
2. Compaction merges the runs, range by range of digests: Spark's sort brings equal digests together, and one pass over the
   sorted entries joins neighbours into one, with the smallest and largest identifier.
3. A Bloom filter of the digests that have several rows, of bounded size, tells which texts to look at again. Those are
   grouped by digest *and whole text* with map-side combining: this is the byte verification, and one hot group becomes
   one row for each map task before anything is shuffled. Only digests that several different texts share (none, for a
   sound digest) take the slower path that joins on the text itself.

:class:`Index` keeps what was compacted, batch after batch: each table of a level has a Bloom filter, a new batch looks only
into tables whose filters admit its digests, and a level with ``fanout`` tables is compacted into one of the next.

A NULL text counts as empty; every row comes back, repeated rows included, and group_size counts rows. Rows repeated with
the same id and text are all marked kept in the membership; :func:`keep` returns one of them. A NULL id never becomes
keep_id while the group has another id; if all are NULL, keep_id is NULL and those rows are kept.
Other columns pass through :func:`keep` unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.llm.shared import Scratch, fresh, sized

#: Entries of a memtable before it flushes a run.
MEMTABLE = 200_000
#: Bits of the Bloom filter of repeated digests at most (16 MB), and bits for each digest below that.
FILTER_BITS, BITS_EACH, PROBES = 1 << 27, 16, 4
RUNS = "digest binary, low long, high long, n long"


class Memtable:
    """digest -> [smallest id, largest id, rows]"""

    def __init__(self):
        self.rows: dict[bytes, list] = {}

    def add(self, digest: bytes, i: int | None) -> None:
        e = self.rows.get(digest)
        if e is None:
            self.rows[digest] = [i, i, 1]
            return
        e[2] += 1
        if i is not None:
            e[0] = i if e[0] is None or i < e[0] else e[0]
            e[1] = i if e[1] is None or i > e[1] else e[1]

    def flush(self) -> pa.RecordBatch:
        keys = sorted(self.rows)
        values = [self.rows[k] for k in keys]
        self.rows = {}
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([v[j] for v in values], pa.int64()) for j in range(3))], ["digest", "low", "high", "n"])


def sorted_runs(digests: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Memtable()
        for b in batches:
            for i, d in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist()):
                table.add(d, i)
                if len(table.rows) >= memtable:
                    yield table.flush()
        if table.rows:
            yield table.flush()

    return digests.select(F.col("doc_id").cast("long").alias("doc_id"), "digest").mapInArrow(run, RUNS)


def _joined(b: pa.RecordBatch) -> pa.RecordBatch:
    """Entries of sorted digests with equal neighbours joined. A NULL id yields to any other."""
    digest = b.column("digest")
    starts = np.flatnonzero(np.r_[True, pc.not_equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False)])
    out = [digest.take(pa.array(starts))]
    for name, least, missing in (("low", np.minimum, np.iinfo(np.int64).max), ("high", np.maximum, np.iinfo(np.int64).min)):
        c = b.column(name)
        none = np.logical_and.reduceat(c.is_null().to_numpy(zero_copy_only=False), starts)
        out.append(pa.array(least.reduceat(c.fill_null(missing).to_numpy(), starts), pa.int64(), mask=none))
    out.append(pa.array(np.add.reduceat(b.column("n").to_numpy(), starts)))
    return pa.RecordBatch.from_arrays(out, ["digest", "low", "high", "n"])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges one range of sorted entries as a stream; only the last entry of a batch waits for the next one."""
    waiting = None
    for b in batches:
        if not b.num_rows:
            continue
        b = _joined(b if waiting is None else pa.concat_batches([waiting, b]))
        if b.num_rows > 1:
            yield b.slice(0, b.num_rows - 1)
        waiting = b.slice(b.num_rows - 1)
    if waiting is not None:
        yield waiting


def compact(runs: DataFrame) -> DataFrame:
    """One entry for each digest of all runs, sorted in ranges of digests."""
    return runs.select("digest", "low", "high", "n").repartitionByRange("digest").sortWithinPartitions("digest").mapInArrow(merge, RUNS)


def _places(digests: list[bytes], bits: int) -> np.ndarray:
    """PROBES bit numbers for each digest."""
    raw = np.frombuffer(b"".join(d.ljust(32, b"\0")[:32] for d in digests), np.uint64).reshape(-1, 4)
    base, step = raw[:, 0], raw[:, 1] | np.uint64(1)
    if not raw[:, 1].any():  # short digests: derive the step
        step = (base * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (base[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def bloom(index: DataFrame, n: int) -> np.ndarray:
    """Bloom filter (bit bytes) of the digests of index. Tasks return the bit numbers they set, once each."""
    bits = 1 << max(10, min(FILTER_BITS, n * BITS_EACH).bit_length())
    bits = min(bits, FILTER_BITS)
    slab = max(bits // 64, 1024)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places(b.column(0).to_pylist(), bits)).astype(np.int64))], ["bit"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [b.column(0).to_numpy() for b in batches]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        for s in np.unique(at // slab).tolist():
            flags = np.zeros(slab, np.uint8)
            flags[at[at // slab == s] - s * slab] = 1
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["slab", "bytes"])

    slabs = index.select("digest").mapInArrow(places, "bit long").repartition((F.col("bit") / slab).cast("long")).mapInArrow(pack, "slab long, bytes binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in slabs.toLocalIterator():  # bits / 8 bytes in all
        part = np.frombuffer(r["bytes"], np.uint8)
        out[r["slab"] * slab // 8 :][: len(part)] |= part
    return out


def may_contain(spark: SparkSession, filter_bytes: np.ndarray):
    shared, bits = spark.sparkContext.broadcast(filter_bytes), len(filter_bytes) * 8

    @F.arrow_udf("boolean")
    def probe(digests: pa.Array) -> pa.Array:
        at = _places(digests.to_pylist(), bits).astype(np.int64)
        hit = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return pa.array(hit.all(axis=1))

    return probe


def membership(docs: DataFrame, keep: str = "min", digest_bytes: int = 32, memtable: int = MEMTABLE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    keep: which id of equal texts stays, "min" or "max". digest_bytes: index on a shorter digest (tests of collisions).
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep is min or max, not {keep!r}")
    spark, pick = docs.sparkSession, "low" if keep == "min" else "high"
    scratch = Scratch(spark, "exact-dedup")
    plain = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sha = F.unhex(F.sha2(plain, 256))
    digests = scratch.save(docs.select("doc_id", sha.alias("sha")), "digests").withColumn("digest", F.substring("sha", 1, digest_bytes))
    runs = scratch.save(sorted_runs(digests, memtable), "runs")
    level = scratch.save(compact(runs).where("n > 1"), "compacted")
    scratch.drop(runs)
    n = level.count()
    if not n:
        return digests.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    probe = may_contain(spark, bloom(level, n))
    hits = docs.select("doc_id", plain.alias("bytes"), F.substring(sha, 1, digest_bytes).alias("digest")).where(probe("digest"))
    verified = hits.groupBy("digest", "bytes").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    groups = scratch.save(verified.withColumn("sha", F.unhex(F.sha2("bytes", 256))).drop("bytes"), "verified")
    collided = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    shape = ["doc_id", F.expr(f"if(n is null, doc_id, {pick})").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "sha"]
    if collided.isEmpty():
        out = digests.drop("digest").join(groups.where("n > 1").drop("digest"), "sha", "left").select(*shape)
    else:
        bad = scratch.save(collided, "collided")
        sound = digests.join(bad, "digest", "left_anti").join(groups.where("n > 1").drop("sha"), "digest", "left").select(*shape)
        mixed = docs.select("doc_id", plain.alias("bytes"), sha.alias("sha")).withColumn("digest", F.substring("sha", 1, digest_bytes)).join(bad, "digest", "left_semi")
        texts = mixed.groupBy("bytes").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
        out = sound.unionByName(mixed.drop("digest").join(texts, "bytes").select(*shape))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


class Index:
    """A log-structured index that grows batch by batch.

    levels: for each level its tables (digest, low, high, n) and their filters. A batch enters level 0 as one table of merged
    runs; ``fanout`` tables of a level become one of the next, so that n batches leave some fanout * log(n) tables to look
    into. A filter has 16 MB at most: beyond some ten million digests it admits ever more, and the join with its table decides
    alone. An empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, digest_bytes: int = 32, memtable: int = MEMTABLE):
        self.spark, self.fanout, self.digest_bytes, self.memtable = spark, fanout, digest_bytes, memtable
        self.scratch, self.levels = Scratch(spark, "exact-index"), [[]]

    def _coded(self, docs: DataFrame) -> DataFrame:
        plain = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        return docs.select("doc_id", plain.alias("bytes"), F.substring(F.unhex(F.sha2(plain, 256)), 1, self.digest_bytes).alias("digest"))

    def _enter(self, level: int, entries: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        table = self.scratch.save(entries, f"level{level}")
        if n := table.count():
            self.levels[level].append((table, bloom(table, n)))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = [t for t, _ in self.levels[level]], []
            self._enter(level + 1, compact(reduce(DataFrame.unionByName, full)))
            self.scratch.drop(*full)

    def known(self, digests: DataFrame) -> DataFrame:
        """Those of digests (distinct) that a table has: filters first, then the tables that they leave."""
        found = digests.limit(0)
        for table, bits in (t for level in self.levels for t in level):
            found = found.unionByName(table.select("digest").join(digests.where(may_contain(self.spark, bits)("digest")), "digest", "left_semi"))
        return found.distinct()

    def add(self, batch: DataFrame, earlier: DataFrame) -> DataFrame:
        """doc_id, keep_id (the smallest id of equal texts in batch and earlier) and known (whether earlier has the text) for
        each row of batch, which then belongs to the index. earlier: the rows of all batches before, read for hits alone."""
        coded = self._coded(batch)
        entries = self.scratch.save(compact(sorted_runs(coded, self.memtable)), "batch")
        hits = self.scratch.save(self.known(entries.select("digest")), "hits")
        rows = hits.count()
        old = self._coded(earlier).join(sized(hits, rows), "digest", "left_semi").withColumn("old", F.lit(True))
        both = old.unionByName(coded.join(sized(hits, rows), "digest", "left_semi").withColumn("old", F.lit(False)))
        texts = both.groupBy("digest", "bytes").agg(F.min("doc_id").alias("keep_id"), F.bool_or("old").alias("known"))
        own = membership(batch, "min", self.digest_bytes, self.memtable).withColumn("digest", F.substring(F.unhex("text_sha256"), 1, self.digest_bytes))
        new = own.join(sized(hits, rows), "digest", "left_anti").select("doc_id", "keep_id", F.lit(False).alias("known"))
        seen = coded.join(sized(hits, rows), "digest", "left_semi").join(texts, ["digest", "bytes"]).select("doc_id", "keep_id", "known")
        out = self.scratch.save(new.unionByName(seen), "added")
        self._enter(0, entries)
        self.scratch.drop(entries, hits)
        return out


def keep(docs: DataFrame, which: str = "min") -> DataFrame:
    """One row of docs for each distinct text, with the columns of docs. doc_id should identify rows; where it does
    not, one row of each (doc_id, text) remains."""
    scratch = Scratch(docs.sparkSession, "exact-dedup-keep")
    members = scratch.save(membership(docs.select("doc_id", "text"), which), "members")
    dropped = scratch.save(members.where("not kept").select("doc_id").distinct(), "dropped")
    ids = members.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = ids.where("n > 1").select("doc_id").unionByName(dropped.join(ids.select("doc_id"), "doc_id", "left_semi")).distinct()
    if shared.isEmpty() and members.where("doc_id is null").isEmpty():
        return docs.join(sized(dropped, dropped.count()), "doc_id", "left_anti").select(docs.columns)
    sha, (key, kept_id, kept_sha) = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), (fresh(c, docs) for c in ("sha", "kept_id", "kept_sha"))
    chosen = members.where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    rows = docs.withColumn(key, sha)
    return rows.join(chosen, rows["doc_id"].eqNullSafe(chosen[kept_id]) & (rows[key] == chosen[kept_sha]), "left_semi").dropDuplicates(["doc_id", key]).drop(key)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return membership(docs.select("doc_id", "text"), "max")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

