"""Operator 6, byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become classes; a short look-ahead (array shifts) refines apostrophes and white space; what remains is a
finite automaton that only looks back. Its transition functions form a small monoid, so composing them is a table
lookup and associative, and a blocked prefix scan gives the state before every character at once. Piece starts follow
from (state, class). No regular expression runs. Pieces then go through cached pair merging.

NULL and empty texts encode to no ids and decode to no bytes. Whole texts are encoded, whatever their length; a long
piece merges in O(n log n). Repeated rows encode alike. Only the named text column is read.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlens.llm.shared import chunks, small_batches

# ---------------------------------------------------------------- automaton

#: Character classes; A1 and A2: an apostrophe before s, t, m, d or before re, ve, ll.
LETTER, NUMBER, OTHER, A1, A2, SPACE_LAST, WHITE_LAST, WHITE = range(8)
#: States: FRESH (a new piece must start), in a run of letters, numbers or others, after a space that joins what
#: follows, in white space, one or two characters of a contraction to go.
FRESH, IN_L, IN_N, IN_O, JOIN, IN_W, ONE, TWO = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this character."""
    if state == TWO:
        return ONE, False
    if state == ONE:
        return FRESH, False
    if kind in (LETTER, NUMBER, OTHER):
        run = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O}[kind]
        return run, state not in (run, JOIN)
    if kind in (A1, A2):
        return (IN_O, False) if state in (IN_O, JOIN) else (ONE if kind == A1 else TWO, True)
    if kind == SPACE_LAST:
        return JOIN, True
    if kind == WHITE_LAST:
        return FRESH, True
    return IN_W, state != IN_W


STARTS = np.array([[_step(s, k)[1] for k in range(8)] for s in range(8)])


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(generators, products, action): numbers of the functions of the 8 classes and of the 8 classes at the start of
    a text, the product table "first a, then b", and what each function does to each state."""
    plain = [tuple(_step(s, k)[0] for s in range(8)) for k in range(8)]
    reset = [(f[FRESH],) * 8 for f in plain]
    number: dict[tuple[int, ...], int] = {}
    todo = [tuple(range(8)), *plain, *reset]
    while todo:
        f = todo.pop(0)
        if f not in number:
            number[f] = len(number)
            todo += [tuple(g[x] for x in f) for g in (*plain, *reset)]
    every = list(number)
    products = np.array([[number[tuple(g[x] for x in f)] for g in every] for f in every], np.uint16)
    return np.array([number[f] for f in (*plain, *reset)], np.uint16), products, np.array(every, np.uint8)


def scan(f: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of function numbers: a blocked scan."""
    _, products, _ = monoid()
    n, flat, k = len(f), products.ravel(), len(products)
    if n <= 64:
        out = f.copy()
        for i in range(1, n):
            out[i] = products[out[i - 1], f[i]]
        return out
    width = max(8, int(n**0.5) // 4)
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.int32)  # 0 is the identity
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for j in range(1, width):
        grid[j] = flat[grid[j - 1] * k + grid[j]]
    before = np.zeros(rows, np.int32)
    before[1:] = scan(grid[-1].astype(np.uint16))[:-1]
    for j in range(width):
        grid[j] = flat[before * k + grid[j]]
    return grid.T.reshape(-1)[:n].astype(np.uint16)


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE for each code point, from the general category and the White_Space property."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            kinds[c] = LETTER
        elif g == "N":
            kinds[c] = NUMBER
    # The code points with the property White_Space.
    kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    return kinds


def piece_starts(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Indices at which pieces start. points: code points of texts laid end to end; off: where each text starts, and the total."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = code_point_classes()[points]
    starts, lens = off[:-1], np.diff(off)
    first = starts[lens > 0]
    last = first + lens[lens > 0] - 1
    white = kind == WHITE
    solid_next = np.zeros(n, bool)  # a character of the same text follows, and it is not white
    solid_next[:-1] = ~white[1:]
    solid_next[last] = False
    ends_run = white & solid_next
    kind[ends_run] = WHITE_LAST
    kind[ends_run & (points == 32)] = SPACE_LAST
    quote = np.flatnonzero((points == 39) & solid_next)
    if len(quote):
        stop = off[np.searchsorted(off, quote, side="right")]
        a = points[quote + 1]
        short = np.isin(a, [ord(c) for c in "stmd"])
        b = np.where(quote + 2 < stop, points[np.minimum(quote + 2, n - 1)], 0)
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        kind[quote[short]] = A1
        kind[quote[long]] = A2
    generators, _, action = monoid()
    g = generators[kind]
    g[first] = generators[8:][kind[first]]
    state = np.zeros(n, np.uint8)
    state[1:] = action[scan(g)[:-1], FRESH]
    state[first] = FRESH
    return np.flatnonzero(STARTS[state, kind])


# ---------------------------------------------------------------- merging


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Cached pair merging by rank; of equal ranks the leftmost pair merges first."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 100_000):
        self.ranks, self.limit = ranks, limit
        self.cache, self.old = {}, {}  # this generation and the one before

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != e:
                continue
            j = end[i]
            alive[j], end[i] = False, e
            if e < n:
                prev[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each piece."""
        cache = self.cache
        if len(cache) > self.limit:
            self.old, self.cache = cache, (cache := {})
        old = self.old
        out = list(map(cache.get, pieces))
        for i, x in enumerate(out):
            if x is None:
                piece = pieces[i]
                if (x := cache.get(piece)) is None:
                    x = old.get(piece) or np.array(self.merge(piece.encode()), "<u4").tobytes()
                    if len(piece) <= 64:
                        cache[piece] = x
                out[i] = x
        return out


@lru_cache(4)
def merger(path: str) -> Merger:
    return Merger(load_ranks(path))


@lru_cache(4)
def vocabulary(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    words = [b""] * (max(ranks.values(), default=-1) + 1)
    for w, i in ranks.items():
        words[i] = w
    return words


def encode_texts(texts: pa.Array, m: Merger) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """Of each text: ids (uint32 bytes), where its pieces start in characters, and the ids before each piece."""
    out = []
    for lo, hi, data, _ in chunks(texts):
        text = data.tobytes().decode()
        lens = pc.utf8_length(pc.fill_null(texts.slice(lo, hi - lo), "")).to_numpy(zero_copy_only=False)
        off = np.zeros(hi - lo + 1, np.int64)
        np.cumsum(lens, out=off[1:])
        at = piece_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), off)
        ends = np.append(at[1:], len(text))
        got = m.ids([text[i:j] for i, j in zip(at.tolist(), ends.tolist())])
        sizes = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        bounds = np.searchsorted(at, off)
        for d in range(hi - lo):
            i, j = bounds[d], bounds[d + 1]
            out.append((b"".join(got[i:j]), at[i:j] - off[d], np.cumsum(sizes[i:j]) - sizes[i:j]))
    return out


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


def encode(text: Column, ranks_path: str) -> Column:
    """ids array<int> of a text column."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        return _lists([np.frombuffer(ids, "<u4").astype(np.int32) for ids, _, _ in encode_texts(texts, merger(ranks_path))], pa.int32())

    return run(text)


def encode_with_offsets(text: Column, ranks_path: str) -> Column:
    """struct(ids array<int>, piece_start array<int>, piece_token array<int>): for each piece the character at which
    it starts in the text and the index of its first id, so that any id range maps back to the text."""
    kind = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "piece_start", "piece_token")])

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        got = encode_texts(texts, merger(ranks_path))
        return pa.StructArray.from_arrays([
            _lists([np.frombuffer(a, "<u4").astype(np.int32) for a, _, _ in got], pa.int32()),
            _lists([b.astype(np.int32) for _, b, _ in got], pa.int32()),
            _lists([c.astype(np.int32) for _, _, c in got], pa.int32()),
        ], ["ids", "piece_start", "piece_token"])

    return run(text)


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes that an array of ids stands for; NULL gives no bytes."""

    @F.arrow_udf(T.BinaryType())
    def run(lists: pa.Array) -> pa.Array:
        words = vocabulary(ranks_path)
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        return pa.array([b"".join(map(words.__getitem__, flat[i:j].tolist())) for i, j in zip(off, off[1:])], pa.binary())

    return run(F.coalesce(ids, F.array().cast("array<int>")))


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def round_trip(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """docs without text, with ids array<int> and bytes, what the ids decode to. One worker encodes and decodes a batch."""
    others = [f for f in docs.schema if f.name not in (text, "ids", "bytes")]
    names = [f.name for f in others]
    out = T.StructType([*others, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = merger(ranks_path), vocabulary(ranks_path)
        for b in batches:
            for lo, hi, part in ((lo, hi, b.column(text).slice(lo, hi - lo)) for lo, hi, _, _ in chunks(b.column(text))):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x, _, _ in encode_texts(part, m)]
                raw = pa.array([b"".join(map(words.__getitem__, x.tolist())) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in names), _lists(ids, pa.int32()), raw], out.names)

    small_batches(docs.sparkSession)
    return docs.select(*names, text).mapInArrow(run, out)


def digests() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of columns ids and bytes."""
    written = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")]


def query(spark: SparkSession, docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs."""
    both = round_trip(docs.select("doc_id", "text"), ranks_path or default_ranks())
    return both.select("doc_id", *digests())
