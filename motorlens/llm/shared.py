"""What several operators need: the shared scratch folder, Arrow text access, vectorised words.

Words are found on UTF-8 bytes: a byte of 0x80 or more is never ASCII white space, so byte-level
segmentation equals code-point segmentation for the classes used here.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


# ---------------------------------------------------------------- scratch


def shared_root(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir, or, in local mode only, a folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="motorlens-")
        atexit.register(_remove_local, _OWN[app])
    return _OWN[app]


def _remove_local(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


def plain_reads(spark: SparkSession) -> None:
    """Read Parquet column chunks as streams from here on, unless the session says otherwise: vectored reads of texts keep
    a direct buffer of a whole column chunk in every reading thread, some 200 MB in an executor of two cores."""
    if spark.conf.get(key := "parquet.hadoop.vectored.io.enabled", None) is None:
        spark.conf.set(key, "false")


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        plain_reads(spark)
        self.spark, self.root = spark, f"{shared_root(spark)}/motorlens/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df once and read it back."""
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete saved tables that no later plan reads."""
        for df in frames:
            if found := self.paths.pop(id(df), None):
                remove(self.spark, found[1])


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a narrow table (an id, a number or two) is broadcast, at some 60 bytes each; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has no more rows than may be."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def semi_join_sized(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct)."""
    return df.join(sized(ids, ids.count()), key, "left_semi")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like name that none of frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def crc_remainder(col: str, modulus: int):
    """crc32 of the id as text, modulo; NULL ids give NULL."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(modulus)


# ---------------------------------------------------------------- text in Arrow


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 2 << 20) -> None:
    """Arrow batches of at most so many rows and about so many bytes from here on: texts are long, and workers hold a batch whole."""
    plain_reads(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, and holds what it once needed."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: Bytes of text that are worked on at once: NumPy arrays take some 60 to 100 bytes for each of them.
CHUNK = 1 << 18


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about limit bytes; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    if off[-1] - off[0] > CHUNK:
        release()


# ---------------------------------------------------------------- words and hashes

_SPACE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
#: 1 for every byte of a word `[^\x20\x09-\x0D]+`.
WORD_CLASS = np.ones(256, np.uint8)
WORD_CLASS[_SPACE] = 0
#: 1: letters, digits and bytes of non-ASCII characters; 2: other visible ASCII; 0: space.
TOKEN_CLASS = np.full(256, 2, np.uint8)
TOKEN_CLASS[_SPACE] = 0
TOKEN_CLASS[0x80:] = 1
TOKEN_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE[LOWER]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse; tables for more than a chunk are not kept."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (_P, _PINV):
        a = np.full(1 << int(n - 1).bit_length(), base, np.uint64)
        a[0] = 1
        made.append(np.multiply.accumulate(a))
    if n <= 2 * CHUNK:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def segments(data: np.ndarray, off: np.ndarray, classes: np.ndarray = WORD_CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first segment of each document and the total) of maximal runs of one non-zero class."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    c = classes[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(c[1:], c[:-1], out=change[1:n])
    change[off] = True
    at = np.flatnonzero(change)
    keep = c[at[:-1]] != 0
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each segment: differences of one running polynomial, shifted back to the segment's start. A long
    text goes in blocks of whole segments, which change no hash."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = len(starts) if len(data) <= 2 * CHUNK else max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        power, inverse = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        at, to = starts[i:j] - lo, ends[i:j] - lo
        with np.errstate(over="ignore"):
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[data[lo:hi]] * power[: hi - lo], out=total[1:])
            out[i:j] = mix64((total[to] - total[at]) * inverse[at] + (to - at).astype(np.uint64))
        i = j
    return out


# ---------------------------------------------------------------- packed columns


def pack(v: np.ndarray) -> bytes:
    """Byte planes: equal high bytes lie together, and shuffles compress them away."""
    return np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def unpack(raw: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).view(dtype).ravel()


def pack_sorted(v: np.ndarray) -> bytes:
    return pack(np.diff(v, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, "<u8"), dtype=np.uint64)


# ---------------------------------------------------------------- n-grams

_ORDER = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16)]


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of h (ignoring document ends)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += h[i : i + m] * np.uint64(_ORDER[i])
    return mix64(out)
