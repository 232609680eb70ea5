"""Operator 2, n-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A text's set holds the hashes (64 bits) of its distinct 5-word shingles, of words `[^\\x20\\x09-\\x0D]+` with A-Z in lower
case; a text of one to four words has its whole sequence as one shingle; a text without words, or NULL, has the empty set
and links with nothing. Two texts link when 100 * |intersection| >= 80 * |union|.

1. Equal sets form a class (by a 128-bit digest of the set); one document, the smallest id, stands for it.
2. Shingles are counted over all documents. The frequent ones (a bounded number, found exactly) are ordered by frequency;
   all others are rarer and go first, by hash. The order decides cost, never the result.
3. Each class files its prefix, rare shingles first, of length n - ceil(0.8 n) + 1. Two sets that link share a shingle of
   both prefixes, so lists of equal shingles hold all candidates.
4. Only the links that join components are needed. In a short list all pairs are candidates. In a long list (a common
   shingle, a large group of near copies) a pivot of each size band is paired with its band; verified links then join
   components, and lists that lie in one component are finished. Rounds go on with other pivots while they join
   components and many pairs are open; what then remains is paired completely across components, so no link between
   components is lost and no group is expanded into all its pairs.
5. Pairs pass the length and positional filters where they are made, in the complete pairing also a suffix filter on
   sketches (counts of shingles by hash range); each pair that is left is verified once, on whole texts, after the
   suffix filter.

Rows that share an id are one document, which links as each of its texts does; each row is reported with its own text's set. A NULL id never names a component.
Only doc_id and text are read by :func:`components_of`; :func:`keep` passes other columns through.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.llm.shared import BROADCAST_ROWS, Scratch, chunks, hashes, mix64, ngram_hashes, pack, pack_sorted, segments, semi_join_sized, sized, small_batches, unpack, unpack_sorted

WORDS = 5
#: Frequent shingles at most (12 bytes each, broadcast), and documents that make a shingle frequent.
FREQUENT, FREQUENT_FROM = 1 << 20, 5
#: Keys are the upper 40 bits of a hash: equal keys of different shingles only add candidates.
KEY_SHIFT = np.uint64(24)
#: Lists up to this length are paired completely at once; entries of a long list that one task takes.
SHORT, LIST_ROWS = 6, 50_000
#: Pivots of a band in one round, and rounds at most before what is left is paired completely; that is also done once
#: there are few pairs across components for each entry of an open list and a round has joined few components.
PIVOTS, PIVOT_ROUNDS, CROSS_EACH = 3, 8, 256
#: Ranges of a sketch.
SKETCH = 256
#: Edges that a task holds while it contracts them; entries and pairs that it gathers before it goes on.
STAR_ROWS, CELL_BLOCK, FLUSH_PAIRS = 500_000, 100_000, 500_000


# ---------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each text."""
    starts, ends, first = segments(data, off)
    h = hashes(data, starts, ends, lower=True)
    grams, out = ngram_hashes(h, WORDS), []
    for i, j in zip(first.tolist(), first[1:].tolist()):
        n = j - i
        if n >= WORDS:
            out.append(np.unique(grams[i : j - WORDS + 1]))
        elif n:
            out.append(mix64(ngram_hashes(h[i:j], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Order:
    """Rare first: shingles that are not frequent by hash, then the frequent ones by count and hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def frequency(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def arrange(self, s: np.ndarray) -> np.ndarray:
        n = self.frequency(s >> KEY_SHIFT)
        return s[np.argsort(n, kind="stable")] if n.any() else s


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def needed(a: int, b: int) -> int:
    """Smallest intersection with which sets of a and b shingles link."""
    return (4 * (a + b) + 8) // 9


def suffix_distance(x: np.ndarray, y: np.ndarray, most: int, depth: int = 1) -> int:
    """A lower bound of the symmetric difference of two sorted sets, by halving around a pivot; any common order of the
    shingles will do, and that of their hashes needs no frequencies."""
    if depth > 3 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    mid = y[len(y) // 2]
    k = int(np.searchsorted(x, mid))
    same = k < len(x) and x[k] == mid
    xl, xr, yl, yr = x[:k], x[k + same :], y[: len(y) // 2], y[len(y) // 2 + 1 :]
    low = abs(len(xl) - len(yl)) + abs(len(xr) - len(yr)) + (not same)
    if low > most:
        return low
    left = suffix_distance(xl, yl, most - abs(len(xr) - len(yr)) - (not same), depth + 1)
    if (low := left + abs(len(xr) - len(yr)) + (not same)) > most:
        return low
    return left + (not same) + suffix_distance(xr, yr, most - left - (not same), depth + 1)


def links(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link, after the length and suffix filters."""
    a, b = len(x), len(y)
    if not a or not b or 5 * min(a, b) < 4 * max(a, b):
        return False
    need = needed(a, b)
    if suffix_distance(x, y, a + b - 2 * need) > a + b - 2 * need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def buckets_for(entries: int) -> int:
    """A power of two, so that a bucket has about 100,000 entries."""
    return 1 << min(20, max(4, int(entries // 100_000).bit_length()))


# ---------------------------------------------------------------- steps


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                sets = shingle_sets(data, off)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())], ["doc_id", "n_shingles", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary")


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id, text, digest of the rows of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in shingle_sets(data, off)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("text").slice(lo, hi - lo), pa.array(digests, pa.binary())], ["doc_id", "text", "digest"])

    return docs.mapInArrow(run, "doc_id long, text string, digest binary")


def first_of_classes(docs: DataFrame, rows: DataFrame, copied: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The rows of docs that stand for their class, and id, comp of documents that join others because rows of one id are
    in several classes. copied: digest, id of classes of several rows."""
    others = scratch.save(rows.where("n_shingles > 0").join(copied, "digest").where("doc_id <> id").select("doc_id", "digest", "id").distinct(), "others")
    n = others.count()
    chosen = docs.where("doc_id is not null")
    if not n:
        return chosen, None
    ids = others.select("doc_id").distinct()
    several = rows.where("n_shingles > 0").join(sized(ids, n), "doc_id", "left_semi").groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("several")).where("several").select("doc_id")
    several = scratch.save(several, "several")
    m = several.count()
    alone = chosen.join(sized(ids, n), "doc_id", "left_anti")
    moved = None
    if m:  # of such an id only the rows that are copies go
        mixed = others.join(sized(several, m), "doc_id", "left_semi")
        rest = with_digest(chosen.join(sized(several, m), "doc_id", "left_semi")).join(mixed.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
        alone = alone.unionByName(rest.select("doc_id", "text"))
        moved = join_components(mixed.select(F.col("doc_id").alias("a"), F.col("id").alias("b")), scratch)
    if n > BROADCAST_ROWS or m:  # one shuffle of the texts, not one for each pass over them
        alone = scratch.save(alone, "chosen")
    return alone, moved


def frequent(docs: DataFrame, buckets: int, scratch: Scratch) -> Order:
    """The order of the most frequent shingles, counted over all rows of docs."""
    shift = np.uint64(40 - (buckets.bit_length() - 1))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            at = np.flatnonzero(np.diff(keys >> shift, prepend=np.uint64(1 << 63)))
            ends = np.append(at[1:], len(keys))
            return pa.RecordBatch.from_arrays([pa.array((keys[at] >> shift).astype(np.int32)), pa.array([pack_sorted(keys[i:j]) for i, j in zip(at, ends)], pa.binary()), pa.array([pack(n[i:j].astype("<u4")) for i, j in zip(at, ends)], pa.binary())], ["bucket", "keys", "n"])

        for b in batches:
            for _, _, data, off in chunks(b.column(0)):
                held += [np.unique(s >> KEY_SHIFT) for s in shingle_sets(data, off) if len(s)]
            if sum(map(len, held)) > 1_000_000:
                yield flush()
        if held:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
            many = n >= FREQUENT_FROM
            return pa.RecordBatch.from_arrays([pa.array(k[many].astype(np.int64)), pa.array(n[many])], ["key", "n"])

        last, keys, counts = None, [], []
        for b in batches:
            for k, a, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != last and keys:
                    yield close(keys, counts)
                    keys, counts = [], []
                last = k
                keys.append(unpack_sorted(a))
                counts.append(unpack(n, "<u4"))
        if keys:
            yield close(keys, counts)

    parts = docs.select("text").mapInArrow(local, "bucket int, keys binary, n binary")
    many = scratch.save(parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, "key long, n long"), "frequent")
    # The smallest count that leaves at most FREQUENT keys; one row for each count, counts above 2^16 together.
    sizes = sorted((r["n"], r["m"]) for r in many.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("m")).collect())
    left, least = 0, 1 << 62
    for n, m in reversed(sizes):
        if left + m > FREQUENT:
            break
        left, least = left + m, n
    got = many.where(F.col("n") >= least).toArrow()
    scratch.drop(many)
    keys, n = got.column("key").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    order = np.argsort(keys)
    return Order(keys[order], n[order])


LISTS = "token long, id long, size int, pos int"


def prefix_lists(docs: DataFrame, order: Order, buckets: int) -> DataFrame:
    """Entries (token, id, size, pos) of the lists that have two entries or more. docs: one row for each class."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    shift = np.uint64(40 - (buckets.bit_length() - 1))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        spread = buckets + TaskContext.get().partitionId() % buckets

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _, _ in held])
            sizes = np.array([len(t) for t, _, _ in held])
            ids = np.repeat(np.array([i for _, i, _ in held], np.int64), sizes)
            full = np.repeat(np.array([n for _, _, n in held], np.int64), sizes)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held.clear()
            # Entries of frequent shingles are known to have company and need no list to be gathered for that.
            bucket = np.where(shared.value.frequency(tokens) > 0, spread, (tokens >> shift).astype(np.int64))
            by = np.lexsort((tokens, bucket))
            bucket, tokens, ids, full, pos = bucket[by], tokens[by], ids[by], full[by], pos[by]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            cuts = list(zip(at, np.append(at[1:], len(bucket))))
            columns = [pa.array(bucket[at].astype(np.int32)), pa.array([pack_sorted(tokens[i:j]) for i, j in cuts], pa.binary())]
            columns += [pa.array([pack(v[i:j].astype(t)) for i, j in cuts], pa.binary()) for v, t in ((ids, "<i8"), (full, "<u4"), (pos, "<u4"))]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "tokens", "ids", "sizes", "pos"])

        n = 0
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, _, data, off in chunks(b.column("text")):
                for d, s in enumerate(shingle_sets(data, off)):
                    if len(s):
                        p = shared.value.arrange(s)[: prefix_length(len(s))] >> KEY_SHIFT
                        held.append((p, ids[lo + d], len(s)))
                        n += len(p)
                if n > 500_000:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(k: int, rows: list[tuple]) -> pa.RecordBatch:
            tokens = np.concatenate([unpack_sorted(r[0]) for r in rows])
            ids, sizes, pos = (np.concatenate([unpack(r[c], t) for r in rows]) for c, t in ((1, "<i8"), (2, "<u4"), (3, "<u4")))
            if k < buckets:
                by = np.argsort(tokens, kind="stable")
                t = tokens[by]
                same = t[1:] == t[:-1]
                by = by[np.append(same, False) | np.append(False, same)]
                tokens, ids, sizes, pos = tokens[by], ids[by], sizes[by], pos[by]
            return pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(ids), pa.array(sizes.astype(np.int32)), pa.array(pos.astype(np.int32))], ["token", "id", "size", "pos"])

        last, rows = None, []
        for b in batches:
            for k, *values in zip(*(b.column(c).to_pylist() for c in range(5))):
                if rows and (k != last or k >= buckets):
                    yield close(last, rows)
                    rows = []
                last = k
                rows.append(values)
        if rows:
            yield close(last, rows)

    parts = docs.select("doc_id", "text").mapInArrow(local, "bucket int, tokens binary, ids binary, sizes binary, pos binary")
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, LISTS)


def _survive(size, pos, i, j) -> np.ndarray:
    """Length and positional filters on entries i and j of one list."""
    a, b = size[i], size[j]
    need = (4 * (a + b) + 8) // 9
    return (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (np.minimum(a - pos[i], b - pos[j]) >= need)


def _pairs_of(v: dict[str, np.ndarray], turn: int, complete: bool) -> Iterator[np.ndarray]:
    """Pairs across components (a, b, comp of a, comp of b; a < b) of whole cells, whose entries stand by token, cell, size, id."""
    token, cell, ids, size, pos, comp = (v[c] for c in ("token", "cell", "id", "size", "pos", "comp"))
    new = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])))
    lens = np.diff(np.append(new, len(token)))
    held, n = [], 0

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal n
        ok = (comp[i] != comp[j]) & _survive(size, pos, i, j)
        if complete:  # majors meet minors, then blocks of minors each other
            ok &= np.where(v["kind"][i] == 0, v["minor"][i] != v["minor"][j], (v["kind"][i] == 1) | (v["block"][i] != v["block"][j]))
        i, j = i[ok], j[ok]
        if complete and len(i):
            ok = may_share(v["sketch"][i], v["sketch"][j], (4 * (size[i] + size[j]) + 8) // 9)
            i, j = i[ok], j[ok]
        turned = ids[i] > ids[j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        held.append(np.stack([ids[i], ids[j], comp[i], comp[j]], 1))
        n += len(i)

    def flush() -> np.ndarray:
        nonlocal n
        out = np.unique(np.concatenate(held), axis=0)
        held.clear()
        n = 0
        return out

    if not complete:
        which = np.repeat(np.arange(len(new)), lens)
        short = lens[which] <= SHORT
        for k in range(1, SHORT):
            if len(which) > k:
                i = np.flatnonzero(short[:-k] & (which[:-k] == which[k:]))
                add(i, i + k)
    for s, m in zip(new.tolist(), lens.tolist()):
        e = s + m
        if complete:
            last = np.searchsorted(size[s:e], size[s:e] * 5 // 4, side="right") + s
            for i in range(s, e - 1):
                if last[i - s] > i + 1:
                    j = np.arange(i + 1, last[i - s])
                    add(np.full(len(j), i), j)
                if n > FLUSH_PAIRS:
                    yield flush()
        elif m > SHORT:
            i = s
            while i < e:  # a band: sizes up to 5/4 of its smallest
                top = s + int(np.searchsorted(size[s:e], size[i] * 5 // 4, side="right"))
                for p in (i + np.argsort(mix64(ids[i:top].astype(np.uint64) + np.uint64(turn)))[:PIVOTS]).tolist():
                    j = np.arange(s + int(np.searchsorted(size[s:e], -(-size[p] * 4 // 5))), s + int(np.searchsorted(size[s:e], size[p] * 5 // 4, side="right")))
                    add(np.full(len(j), p), j)
                i = top
        if n > FLUSH_PAIRS:
            yield flush()
    if held:
        yield flush()


def sketch(x: np.ndarray) -> np.ndarray:
    """How many of a set's shingles lie in each of SKETCH equal ranges; 255 stands for 255 or more."""
    return np.minimum(np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8)


def may_share(x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The suffix filter with fixed pivots: whether sketches x[k] and y[k] allow an intersection of need[k]."""
    low = np.minimum(x, y)
    return (low.sum(axis=1, dtype=np.int64) >= need) | ((low == 255).any(axis=1))


def sketches(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """id, sketch of the documents of ids. texts: doc_id, text of one row for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([sketch(x).tobytes() for x in shingle_sets(data, off)], pa.binary())], ["id", "sketch"])

    rows = semi_join_sized(texts, ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id").mapInArrow(run, "id long, sketch binary")
    # Rows that share an id are one document: of their sketches, the larger counts bound them all.
    return rows.groupBy("id").agg(F.collect_set("sketch").alias("sketches"))


def candidate_pairs(cells: DataFrame, turn: int, complete: bool) -> DataFrame:
    """Distinct pairs a < b across components, with their components. Tasks take cells as they come, never a partition whole."""
    names = cells.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def table() -> dict[str, np.ndarray]:
            return {c: np.concatenate([x[c] for x in held]) for c in names}

        def out(v: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for pairs in _pairs_of(v, turn, complete):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(4)], ["a", "b", "ca", "cb"])

        def column(batch: pa.RecordBatch, c: str) -> np.ndarray:
            if c != "sketch":
                return batch.column(c).to_numpy().astype(np.int64)
            each = [np.frombuffer(b"".join(x), np.uint8).reshape(-1, SKETCH).max(axis=0) for x in batch.column(c).to_pylist()]
            return np.stack(each) if each else np.zeros((0, SKETCH), np.uint8)

        for batch in batches:
            held.append({c: column(batch, c) for c in names})
            n += batch.num_rows
            if n > CELL_BLOCK:  # all cells but the last are whole
                v = table()
                cut = int(np.flatnonzero((v["token"] != v["token"][-1]) | (v["cell"] != v["cell"][-1]))[-1] + 1) if v["token"][0] != v["token"][-1] or v["cell"][0] != v["cell"][-1] else 0
                if cut:
                    yield from out({c: x[:cut] for c, x in v.items()})
                held = [{c: x[cut:] for c, x in v.items()}]
                n = len(v["token"]) - cut
        if n:
            yield from out(table())

    return cells.repartition("token", "cell").sortWithinPartitions("token", "cell", "size", "id").mapInArrow(run, "a long, b long, ca long, cb long").distinct()


def pivot_cells(lists: DataFrame, turn: int) -> DataFrame:
    """The entries of lists (with n, the length of their list), long lists dealt to several cells, otherwise in each round."""
    cell = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("n") / LIST_ROWS)).cast("int")
    return lists.select("token", cell.alias("cell"), "id", "size", "pos", "comp")


def complete_cells(lists: DataFrame) -> DataFrame:
    """Cells in which every two entries of different components of a list meet.

    Entries outside the list's largest component are minors. Kind 0: a part of the majors with all minors. Kinds 1 and 2:
    minors alone, a block with itself or two blocks. A list whose entries are all apart has minors alone, on a grid of cells."""
    parts = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
    shape = parts.groupBy("token").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"))
    shape = shape.select("token", F.col("top.comp").alias("top"), F.ceil(F.col("top.m") / LIST_ROWS).cast("int").alias("cuts"), F.ceil((F.col("all") - F.col("top.m")) / LIST_ROWS).cast("int").alias("blocks"))
    rows = lists.join(shape, "token").withColumn("minor", (F.col("comp") != F.col("top")).cast("int"))
    rows = rows.withColumn("block", F.when(F.col("minor") == 1, F.pmod(F.xxhash64("id", F.lit(1)), "blocks")).otherwise(0).cast("int"))
    cell = lambda c, kind: F.struct(c.cast("int").alias("cell"), F.lit(kind).alias("kind"))
    major = F.array(cell(F.pmod(F.xxhash64("id", F.lit(2)), "cuts"), 0))
    with_majors = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda c: cell(c, 0))
    # Cells behind those of the majors: block x with block y >= x has the number x * blocks + y.
    at = lambda x, y: F.col("cuts") + x * F.col("blocks") + y
    grid = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(at(F.least(F.col("block"), y), F.greatest(F.col("block"), y)).cast("int").alias("cell"), F.when(F.col("block") == y, 1).otherwise(2).alias("kind")))
    cells = F.when(F.col("minor") == 1, F.concat(with_majors, grid)).otherwise(major)
    return rows.withColumn("at", F.explode(cells)).select("token", "at.cell", "id", "size", "pos", "comp", "minor", "block", "at.kind", F.col("sketches").alias("sketch"))


def still_open(lists: DataFrame, moved: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """The entries of lists that hold several components, with n, the length of their list; how many they are; and the
    pairs across components in them. moved: id, comp of components that have joined others."""
    lists = lists.drop("n")
    if moved is not None:
        lists = lists.join(sized(moved.select(F.col("id").alias("comp"), F.col("comp").alias("new")), moved.count()), "comp", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new")
    parts = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).cast("double").alias("m"))
    each = parts.groupBy("token").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.count(F.lit(1)).alias("k"))
    each = scratch.save(each.where("k > 1").select("token", F.col("n").cast("long").alias("n"), ((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("cross")), "open")
    tokens, entries, cross = each.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("cross"), F.lit(0.0))).first()
    return scratch.save(lists.join(sized(each.select("token", "n"), tokens), "token"), "lists"), entries, int(cross)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The components (a, b) of the pairs whose texts link. texts: doc_id, text of one row for each class."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    mine = semi_join_sized(texts, ids, "doc_id")
    near = mine.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    far = mine.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(near, "b").join(far, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[tuple, np.ndarray] = OrderedDict()

        def of(i: int, text: str) -> np.ndarray:
            key = (i, len(text))  # an id may stand for several texts; the text itself is compared below
            got = held.get(key)
            if got is None or got[0] != text:
                raw = np.frombuffer(text.encode(), np.uint8)
                got = held[key] = (text, shingle_sets(raw, np.array([0, len(raw)]))[0])
                if len(held) > 64:
                    held.popitem(last=False)
            return got[1]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = [links(of(i, s), of(j, t)) for i, j, s, t in zip(a, b, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("ca").filter(keep), batch.column("cb").filter(keep)], ["a", "b"])

    return rows.select("a", "b", "ca", "cb", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) of every node of edges (a, b) that isn't the smallest itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            break
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contract_parts(edges: DataFrame) -> DataFrame:
    """The edges (id, comp) of each partition as stars around its own components' smallest ids: never more edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["id", "comp"])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if len(a) + sum(len(x) for x, _ in held) > STAR_ROWS:
                a, b = contract(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
                held.clear()
                if 2 * len(a) > STAR_ROWS:  # what is left over joins in the next round
                    yield row()
                    a, b = a[:0], b[:0]
        a, b = contract(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
        if len(a):
            yield row()

    return edges.mapInArrow(run, "id long, comp long")


def join_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, comp: the smallest id that edges (a, b) reach, for each id in edges that isn't the smallest itself.

    Edges are contracted in partitions of STAR_ROWS. If that leaves several partitions, rounds of stars follow: larger
    neighbours of a node go to its smallest neighbour, then each node's smaller neighbours are joined, where edges are
    contracted in their partitions before and after they are dealt out by node. A round whose every node has either one
    smaller neighbour or only larger ones is the last."""
    stars = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("comp")).distinct(), "edges")
    parts = -(-stars.count() // STAR_ROWS)
    if parts <= 1:
        return scratch.save(contract_parts(stars.coalesce(1)), "stars")
    while True:
        stars = scratch.save(contract_parts(contract_parts(stars.coalesce(parts)).repartition("id")), "stars")
        both = stars.select(F.col("id").alias("u"), F.col("comp").alias("v")).union(stars.select("comp", "id"))
        near = both.groupBy("u").agg(F.min("v").alias("lo"), F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("below"), F.max("v").alias("hi"))
        near = scratch.save(near.select("u", F.least("lo", "u").alias("lo"), F.expr("lo < u and (below <> lo or hi > u)").alias("open")), "near")
        if near.where("open").isEmpty():
            return near.where("lo < u").select(F.col("u").alias("id"), F.col("lo").alias("comp"))
        stars = stars.join(near.select(F.col("u").alias("comp"), "lo"), "comp").select("id", F.col("lo").alias("comp"))


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ngram-join")
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.save(describe(docs), "rows")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("m"))
    copied = scratch.save(classes.where("m > 1").drop("m"), "copied")
    chosen, moved = first_of_classes(docs, rows, copied, scratch)
    total = rows.agg(F.sum("n_shingles")).head()[0] or 0
    buckets = buckets_for(total)
    order = frequent(chosen, buckets, scratch)
    lists = scratch.save(prefix_lists(chosen, order, buckets_for(total // 4)).withColumn("comp", F.col("id")), "lists")

    comps, done = moved, None
    for turn in range(PIVOT_ROUNDS + 1):
        lists, entries, cross = still_open(lists, moved, scratch)
        if not cross:
            break
        joined = moved.count() if moved is not None else 0
        complete = turn == PIVOT_ROUNDS or turn > 0 and (not joined or cross <= entries or cross <= CROSS_EACH * entries and joined <= entries // 1000)
        if complete:
            known = scratch.save(sketches(lists, chosen), "sketches")
            cells = complete_cells(lists.join(known, "id"))
        else:
            cells = pivot_cells(lists, turn)
        pairs = candidate_pairs(cells, turn, complete)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs{turn}")
        done = pairs.select("a", "b") if done is None else done.union(pairs.select("a", "b"))
        new = scratch.save(verify(pairs, chosen), f"links{turn}")
        moved = None if new.isEmpty() else join_components(new, scratch)
        if moved is not None:
            old = comps
            if comps is not None:
                to = sized(moved.select(F.col("id").alias("comp"), F.col("comp").alias("new")), moved.count())
                moved_on = comps.join(to, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp"))
                comps = scratch.save(moved_on.unionByName(moved), "comps")
                scratch.drop(old)
            else:
                comps = moved
        if complete:
            break
        if not turn:  # short lists have been paired completely
            lists = lists.where(F.col("n") > SHORT)
    named = rows.join(copied, "digest", "left").withColumn("id", F.coalesce("id", "doc_id"))
    if comps is None:
        return named.select("doc_id", "n_shingles", F.col("id").alias("component_id"))
    return named.join(comps, "id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("comp", "id")).alias("component_id"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their component, and all rows without shingles, with the columns of docs."""
    scratch = Scratch(docs.sparkSession, "ngram-join-keep")
    members = scratch.save(components_of(docs), "members")
    dropped = scratch.save(members.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return docs.join(sized(dropped, dropped.count()), "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return components_of(docs)


