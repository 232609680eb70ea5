"""Queries over photos: each order is an advert and has a file of its own, made from its key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.sources import photos
from motorlens.sources.fixtures import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Longest edge and photos of an advert here, and which neighbours' files an advert names, one of them twice.
_EDGE, _LIMIT, _NAMES = 16, 3, (0, 1, 0, 2, 3, 4, 5, 6, 7)


def _content(k: int) -> bytes:
    """An error page, a missing file, a large PNG, a JPEG, a PNG whose pixels are cut off, a small PNG, an empty file."""
    shape = {2: (10 + k % 5, 20 + k % 13, 3), 4: (30, 40, 1), 5: (4, 8, 4)}.get(k % 7)
    if shape:
        png = photos.encode_png(np.arange(k % 251, k % 251 + np.prod(shape)).astype(np.uint8).reshape(shape))
        return png[:45] if k % 7 == 4 else png
    return {0: b"<html>404</html>", 1: b"", 3: b"\xff\xd8\xff\xe0" + str(k).encode(), 6: b""}[k % 7]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    made = F.arrow_udf(lambda keys: pa.array([_content(x) for x in keys.to_pylist()], pa.binary()), "binary")
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    return orders.select(F.concat(F.lit("https://p.de/"), k).alias("url"), F.when(k % 7 == 1, 404).otherwise(200).alias("status"), made(k.cast("long")).alias("content"))


def photos_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three usable photos of every advert; places count what was left out."""
    ready = photos.prepared(_files(spark, sf_dir), max_edge=_EDGE, run=photos.shrink_png)
    named = F.array(*[F.concat(F.lit("https://p.de/"), F.col("o_orderkey") + n) for n in _NAMES])
    adverts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), named.alias("photos"))
    return photos.chosen(adverts, ready, _LIMIT).select("id", "pos", "url", "media_type", "width", "height")


QUERIES["photos_prepared"] = photos_prepared
ORACLES["photos_prepared"] = f"""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 7 AS kind, 20 + o_orderkey % 13 AS w, 10 + o_orderkey % 5 AS h FROM orders),
g AS (SELECT k, CASE kind WHEN 3 THEN 'image/jpeg' ELSE 'image/png' END AS media_type, CASE kind WHEN 2 THEN {_EDGE} WHEN 4 THEN 40 WHEN 5 THEN 8 END AS width, CASE kind WHEN 2 THEN (2 * h * {_EDGE} + w) // (2 * w) WHEN 4 THEN 30 WHEN 5 THEN 4 END AS height FROM f WHERE kind IN (2, 3, 4, 5)),
r AS (SELECT a.o_orderkey AS id, (CASE WHEN o >= 2 THEN o + 1 ELSE o END)::INT AS pos, 'https://p.de/' || g.k AS url, media_type, width::INT AS width, height::INT AS height, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY o) AS n FROM orders a CROSS JOIN range(8) t(o) JOIN g ON g.k = a.o_orderkey + o)
SELECT id, pos, url, media_type, width, height FROM r WHERE n <= {_LIMIT}"""
