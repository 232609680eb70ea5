"""Photos of adverts made ready for a reader: the first usable ones of each advert, shrunk, with the place they have there.

Files are a table (url, status, content), read from a folder or filled by a crawl. Each wanted file is judged once: by its
status, then by its first bytes (sites answer 200 with an error page), all in the JVM; only images go to Python, where they
are shrunk in batches of bounded size. Adverts then choose among the facts of the files, so that contents are not shuffled
with the choice: write what :func:`prepared` gives once, choose from it, and join the contents of the chosen.

An advert that names a file twice has it once, at its first place. Files that are missing, empty, no images or too large
after shrinking do not count towards the limit, and later photos keep their own place. A NULL list, NULL entries and adverts
without usable photos give no rows. A file that is there twice counts once: the copy of the longest content, then the smallest.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlens.functions import urls as ul

# Bytes that one image may have, bytes up to which a small image stays as it is, photos and pixels of an edge.
MAX_BYTES, SMALL_BYTES, LIMIT, MAX_EDGE = 4_500_000, 1_500_000, 8, 1024
#: Bytes of shrunk images in one batch that leaves Python, and pixels above which an image is not opened.
BATCH, MAX_PIXELS = 8 << 20, 1 << 26

_SIGN = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


# ---------------------------------------------------------------- images


def decode_png(content: bytes) -> np.ndarray | None:
    """Rows, columns and channels of a PNG of 8 bits a channel; None for palettes, other depths and interlacing."""
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", content[16:29])
    if depth != 8 or laced or colour not in _CHANNELS or not 0 < width * height <= MAX_PIXELS:
        return None
    at, packed = 8, []
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        if kind == b"IDAT":
            packed.append(content[at + 8 : at + 8 + size])
        at += size + 12
    n = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)[: height * (width * n + 1)].reshape(height, width * n + 1)
    out, above = np.empty((height, width, n), np.uint8), np.zeros((width, n), np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:].reshape(width, n), above)
    return out


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A line of a PNG without its filter (0 none, 1 left, 2 above, 3 mean of both, 4 nearest of left, above and corner)."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + above
    out, up = line.astype(np.int64), above.astype(np.int64)
    left = corner = np.zeros(line.shape[1], np.int64)
    for x in range(len(out)):
        if kind == 3:
            near = (left + up[x]) // 2
        else:
            far = np.abs(np.stack([up[x] - corner, left - corner, left + up[x] - 2 * corner]))
            near = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up[x], corner))
        left, corner = (out[x] + near) % 256, up[x]
        out[x] = left
    return out.astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of rows, columns and 1 to 4 channels."""
    height, width, n = pixels.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.zeros((height, width * n + 1), np.uint8)
    lines[:, 1:] = pixels.reshape(height, width * n)
    head = struct.pack(">IIBBBBB", width, height, 8, {v: k for k, v in _CHANNELS.items()}[n], 0, 0, 0)
    return _SIGN + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def box(pixels: np.ndarray, max_edge: int) -> np.ndarray:
    """pixels with max_edge as the longer edge, each pixel the mean of those it stands for; smaller images stay."""
    height, width = pixels.shape[:2]
    longer = max(height, width)
    if longer <= max_edge:
        return pixels
    new = [max(1, (2 * e * max_edge + longer) // (2 * longer)) for e in (height, width)]
    rows, columns = (np.arange(m + 1) * e // m for m, e in zip(new, (height, width)))
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), rows[:-1], axis=0), columns[:-1], axis=1)
    area = np.diff(rows)[:, None, None] * np.diff(columns)[None, :, None]
    return ((2 * sums + area) // (2 * area)).astype(np.uint8)


def shrink_png(content: bytes, media_type: str, max_edge: int) -> tuple[bytes, str]:
    """A PNG with at most max_edge pixels an edge; other types, and a PNG that cannot be opened, as they are."""
    if media_type != "image/png":
        return content, media_type
    try:
        pixels = decode_png(content)
    except (ValueError, struct.error, zlib.error):
        return content, media_type
    if pixels is None or max(pixels.shape[:2]) <= max_edge and len(content) < SMALL_BYTES:
        return content, media_type
    return encode_png(box(pixels, max_edge)), media_type


def shrink(content: bytes, media_type: str, max_edge: int) -> tuple[bytes, str]:
    """As shrink_png, and for every type a JPEG by Pillow where that is installed."""
    try:
        from PIL import Image
    except ImportError:
        return shrink_png(content, media_type, max_edge)
    try:
        image = Image.open(io.BytesIO(content))
        if max(image.size) <= max_edge and len(content) < SMALL_BYTES:
            image.load()
            return content, media_type
        image.thumbnail((max_edge, max_edge))
        out = io.BytesIO()
        image.convert("RGB").save(out, "JPEG", quality=82, optimize=True)
        return out.getvalue(), "image/jpeg"
    except Exception:  # a broken image stays as it is
        return content, media_type


# ---------------------------------------------------------------- tables


def from_folder(spark: SparkSession, path: str) -> DataFrame:
    """url (the path), status, content of the files of a folder and its folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), F.lit(200).alias("status"), "content")


def references(adverts: DataFrame, photos: str = "photos") -> DataFrame:
    """id, url, pos (from 0, the first place where the advert names it)."""
    each = adverts.select("id", F.posexplode(photos).alias("pos", "url")).where("url is not null")
    return each.groupBy("id", "url").agg(F.min("pos").alias("pos"))


def prepared(files: DataFrame, max_edge: int = MAX_EDGE, max_bytes: int = MAX_BYTES, run: Callable[[bytes, str, int], tuple[bytes, str]] = shrink) -> DataFrame:
    """url, media_type, bytes, width, height (of PNGs), content of every usable file, shrunk by run."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["url", "media_type", "content"])
        held, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                url, kind, content = (b.column(c)[k].as_py() for c in range(3))
                small, kind = run(content, kind, max_edge)
                held.append((url, kind, small))
                size += len(small)
                if size >= BATCH:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    kind = ul.media_type(F.col("content"))
    usable = files.where((F.col("status") == 200) & kind.isNotNull() & F.col("url").isNotNull())
    small = usable.select("url", kind.alias("media_type"), "content").mapInArrow(each, "url string, media_type string, content binary")
    small = small.withColumn("bytes", F.length("content").cast("long")).where(F.col("bytes") <= max_bytes)
    one = small.groupBy("url").agg(F.min_by(F.struct("media_type", "bytes", "content"), F.struct(-F.col("bytes"), F.col("content"))).alias("f")).select("url", "f.*")
    edge = lambda start: F.when(F.col("media_type") == "image/png", F.conv(F.hex(F.substring("content", start, 4)), 16, 10).cast("int"))
    return one.select("url", "media_type", "bytes", edge(17).alias("width"), edge(21).alias("height"), "content")


def chosen(adverts: DataFrame, ready: DataFrame, limit: int = LIMIT, photos: str = "photos") -> DataFrame:
    """id, pos, url, media_type, bytes, width, height: the first limit usable photos of each advert. ready: as from prepared."""
    both = references(adverts, photos).join(ready.drop("content"), "url")
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("_n") <= limit)
    return first.select("id", "pos", "url", "media_type", "bytes", "width", "height")


def blocks(picked: DataFrame, ready: DataFrame) -> DataFrame:
    """id, photos: what a model is sent for each advert, as (pos, media_type, data in base64), in the advert's order."""
    photo = F.struct("pos", "media_type", F.base64("content").alias("data"))
    return picked.select("id", "pos", "url").join(ready.select("url", "media_type", "content"), "url").groupBy("id").agg(F.array_sort(F.collect_list(photo)).alias("photos"))
