"""Streams over sightings: the price history, and adverts that are not seen again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from motorlens.operators.history import POINT, recorded_points
from motorlens.operators.state import latest
from motorlens.streaming.store import Store

# ---------------------------------------------------------------- price history


def last_prices(points: DataFrame) -> DataFrame:
    return latest(points.select("listing_id", "seen_at", "event_id", "price_eur"), ("listing_id",), ("seen_at", "event_id")).select("listing_id", "price_eur")


def follow_prices(observations: DataFrame, root: str, feed: str = "observations") -> DataFrame:
    """The points (POINT) that a stream of observations records, all that it holds now; root keeps its state.

    Each batch is folded as a batch is, in ranges of time, from the last recorded prices of its listings: no listing is held
    in one place. Points go to the batch's own folder, then the new last prices are committed with the batch's number; a
    batch that comes again after a failure writes the same folder, or nothing if it was committed. Observations count in the
    order of their batches, and by time within a batch."""
    spark = observations.sparkSession
    store = Store(spark, f"{root}/last", ("listing_id",), "listing_id long, price_eur double")

    def one(batch: DataFrame, number: int) -> None:
        if number <= store.manifest()["applied"].get(feed, -1):
            return
        folder = f"{root}/points/batch={number}"
        recorded_points(batch, store.read()).write.mode("overwrite").parquet(folder)
        points = spark.read.schema(POINT).parquet(folder)
        store.apply(feed, number, last_prices(points), lambda old, new: old.join(new, "listing_id", "left_anti").unionByName(new))

    query = observations.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(POINT).parquet(f"{root}/points")


# ---------------------------------------------------------------- adverts not seen again

ACTIVITY = "listing_id long, last_seen timestamp, active boolean"


class Expiry(StatefulProcessor):
    """Keeps when a listing was last seen, with a timer that ends it; state is one time for each listing."""

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen timestamp, active boolean")

    def _row(self, key: tuple, seen: pd.Timestamp, active: bool) -> pd.DataFrame:
        return pd.DataFrame({"listing_id": [key[0]], "last_seen": [seen], "active": [active]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = max(part["seen_at"].max() for part in rows)  # in any order, and never held together
        known = self.last.get() if self.last.exists() else None
        if known is not None and known[0] is not None:
            seen = max(seen, pd.Timestamp(known[0]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(seen.value // 1_000_000) + self.expire_ms)
        self.last.update((seen.to_pydatetime(), True))
        if known is not None and not known[1]:
            yield self._row(key, seen, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = pd.Timestamp(self.last.get()[0])
        self.last.update((seen.to_pydatetime(), False))
        yield self._row(key, seen, False)

    def close(self) -> None:
        pass


def expire(sightings: DataFrame, expire_after: str, late: str) -> DataFrame:
    """Changes of activity (ACTIVITY) of a stream of sightings (listing_id, seen_at): false once the watermark, which is late
    behind the newest sighting, has passed a listing's last sighting by expire_after; true when it is seen again."""
    ms = int(pd.Timedelta(expire_after).total_seconds() * 1000)
    marked = sightings.select("listing_id", "seen_at").withWatermark("seen_at", late)
    return marked.groupBy("listing_id").transformWithStateInPandas(Expiry(ms), ACTIVITY, "append", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow_activity(sightings: DataFrame, root: str, expire_after: str, late: str = "0 seconds") -> DataFrame:
    """listing_id, last_seen, active: the last change of each listing that has ended at least once, of all that a stream holds now."""
    spark, key = sightings.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)  # timers need it; a query keeps what it was started with
    try:
        changes = expire(sightings, expire_after, late).writeStream.format("parquet").option("path", f"{root}/changes").option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
        changes.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    rows = spark.read.schema(ACTIVITY).parquet(f"{root}/changes")
    return rows.groupBy("listing_id").agg(F.max_by(F.struct("last_seen", "active"), F.struct("last_seen", ~F.col("active"))).alias("r")).select("listing_id", "r.last_seen", "r.active")
