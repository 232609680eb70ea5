"""Photos: PNGs by every filter, shrinking, choice, places."""

import base64
import struct
import zlib

import numpy as np
import pytest

from motorlens.sources import photos

JPEG = b"\xff\xd8\xff\xe0 not opened"


def png(height, width, channels=3, seed=0):
    return photos.encode_png(np.random.default_rng(seed).integers(0, 256, (height, width, channels)).astype(np.uint8))


def filtered(pixels, kind):
    """A PNG whose lines all have one filter, made pixel by pixel."""
    height, width, n = pixels.shape
    at = lambda y, x, c: int(pixels[y, x, c]) if y >= 0 and x >= 0 else 0
    body = bytearray()
    for y in range(height):
        body.append(kind)
        for x in range(width):
            for c in range(n):
                a, b, d = at(y, x - 1, c), at(y - 1, x, c), at(y - 1, x - 1, c)
                nearest = min((a, b, d), key=lambda v: abs(a + b - d - v))
                body.append((at(y, x, c) - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
    whole = photos.encode_png(pixels)
    data = zlib.compress(bytes(body))
    return whole[:33] + struct.pack(">I", len(data)) + b"IDAT" + data + struct.pack(">I", zlib.crc32(b"IDAT" + data)) + whole[-12:]


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_filters(kind, channels):
    pixels = np.random.default_rng(kind).integers(0, 256, (7, 9, channels)).astype(np.uint8)
    assert (photos.decode_png(filtered(pixels, kind)) == pixels).all()


def test_box_takes_means():
    pixels = np.random.default_rng(1).integers(0, 256, (11, 23, 3)).astype(np.uint8)
    small = photos.box(pixels, 10)
    assert small.shape == (5, 10, 3)
    for y in range(5):
        for x in range(10):
            part = pixels[y * 11 // 5 : (y + 1) * 11 // 5, x * 23 // 10 : (x + 1) * 23 // 10].astype(float)
            assert np.abs(part.mean(axis=(0, 1)) - small[y, x]).max() <= 0.5
    assert photos.box(pixels, 23) is pixels
    assert photos.box(np.zeros((1, 5000, 1), np.uint8), 10).shape == (1, 10, 1)


def test_what_cannot_be_opened_stays():
    for broken in (JPEG, png(40, 40)[:60], b"\x89PNG\r\n\x1a\n"):
        kind = "image/jpeg" if broken is JPEG else "image/png"
        assert photos.shrink_png(broken, kind, 8) == (broken, kind)
    assert photos.decode_png(png(40, 30)[:24] + b"\x10" + png(40, 30)[25:]) is None


def table(spark, rows):
    return spark.createDataFrame(rows, "url string, status int, content binary")


def test_choice_keeps_places(spark):
    files = table(spark, [("missing", 404, JPEG), ("page", 200, b"<html>404</html>"), ("empty", 200, b""), ("none", 200, None), ("large", 200, png(30, 60)), ("small", 200, png(4, 6)), ("jpeg", 200, JPEG), ("jpeg", 200, JPEG), (None, 200, JPEG)])
    adverts = spark.createDataFrame([(1, ["missing", "small", "page", None, "large", "small", "jpeg"]), (2, ["page", "empty", "none", "unknown"]), (3, None), (4, []), (5, ["jpeg"] * 5)], "id long, photos array<string>")
    ready = photos.prepared(files, max_edge=20, run=photos.shrink_png)
    got = photos.chosen(adverts, ready, 8)
    assert sorted((r.id, r.pos, r.url, r.width, r.height) for r in got.collect()) == [(1, 1, "small", 6, 4), (1, 4, "large", 20, 10), (1, 6, "jpeg", None, None), (5, 0, "jpeg", None, None)]
    assert sorted((r.id, r.pos) for r in photos.chosen(adverts, ready, 2).collect()) == [(1, 1), (1, 4), (5, 0)]
    sent = {r.id: r.photos for r in photos.blocks(got, ready).collect()}
    assert [p.pos for p in sent[1]] == [1, 4, 6] and base64.b64decode(sent[5][0].data) == JPEG
    assert photos.decode_png(base64.b64decode(sent[1][1].data)).shape == (10, 20, 3)


def test_too_large_after_shrinking_goes(spark):
    files = table(spark, [("a", 200, JPEG + b"x" * 500), ("b", 200, JPEG)])
    assert [r.url for r in photos.prepared(files, max_bytes=400).collect()] == ["b"]
    assert photos.prepared(table(spark, [])).count() == 0


def test_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(30, 30))
    (tmp_path / "b.jpg").write_bytes(b"<html>")
    got = photos.prepared(photos.from_folder(spark, str(tmp_path)), max_edge=10, run=photos.shrink_png).collect()
    assert [(r.url.rsplit("/", 1)[1], r.media_type, r.width, r.height) for r in got] == [("a.png", "image/png", 10, 10)]
