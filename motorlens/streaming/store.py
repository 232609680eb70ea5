"""A stored table that batches change one after the other, each once.

Rows live in Parquet, in buckets by a hash of their key. A manifest names the folder of every bucket and the last batch of
every feed; it is written beside the data and renamed into place, which is the commit. What a failed batch wrote is in no
manifest and is never read. A batch rewrites the buckets of its keys and carries the others over by name. A batch whose
number its feed has already applied changes nothing, so that a feed may be replayed after a failure (``foreachBatch`` does).

One writer at a time: of two that start from the same version, the second to rename fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...], schema: StructType | str, buckets: int = 16):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifest

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[1:-5]) for f in self._fs.listStatus(folder) if f.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, folders (bucket: folder), applied (feed: last batch). version: an earlier one."""
        found = self._versions()
        if not found:
            return {"version": 0, "schema": self.schema.jsonValue(), "folders": {}, "applied": {}}
        lines = self.spark.read.text(f"{self.root}/manifest/v{found[-1] if version is None else version:010d}.json", wholetext=True).collect()  # one file
        return json.loads(lines[0][0])

    def _commit(self, manifest: dict) -> None:
        name = f"v{manifest['version']:010d}.json"
        written, place = self._path(f"{self.root}/manifest/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/{name}")
        out = self._fs.create(written, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(written, place):
            self._fs.delete(written, False)
            raise RuntimeError(f"another writer committed {name}")

    # ------------------------------------------------------------ rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        folders = [f for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def apply(self, feed: str, number: int, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """The table after merge(stored rows of the batch's buckets, batch), unless the feed has applied this batch.

        merge keeps keys unique, and gives the rows of a key from the rows of that key alone. Columns that it adds belong to
        the table from then on."""
        now = self.manifest()
        if number <= now["applied"].get(feed, -1):
            return False
        touched = {r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect()}  # as many as there are buckets at most
        folders, schema = dict(now["folders"]), now["schema"]
        if touched:
            after = merge(self._rows(now, touched), batch)
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            after.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
            kept = {int(s.getPath().getName().partition("=")[2]) for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()}
            folders = {b: f for b, f in folders.items() if int(b) not in touched} | {str(b): f"{folder}/_bucket={b}" for b in kept}
            schema = StructType([f for f in after.schema]).jsonValue()
        self._commit({"version": now["version"] + 1, "schema": schema, "folders": folders, "applied": now["applied"] | {feed: number}})
        return True

    def follow(self, feed: str, stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """All that a stream holds now, batch by batch."""
        query = stream.writeStream.foreachBatch(lambda batch, number: self.apply(feed, number, batch, merge) and None)
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def clean(self, keep: int = 2) -> None:
        """Remove versions before the last ones, and data that the rest do not name. No batch may be under way."""
        found = self._versions()
        for v in found[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:010d}.json"), False)
        named = {f.rpartition("/")[0] for v in found[-keep:] for f in self.manifest(v)["folders"].values()}
        if self._fs.exists(data := self._path(f"{self.root}/data")):
            for s in self._fs.listStatus(data):
                if f"{self.root}/data/{s.getPath().getName()}" not in named:
                    self._fs.delete(s.getPath(), True)
