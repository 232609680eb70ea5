"""The price history as a fold over time, in linear time and without holding a listing.

A point is recorded when its price differs from the last *recorded* one by more than a euro, so every step needs the step
before. A listing with many observations is cut into ranges of time all the same. What a range does to the price that comes
in is a function of few pieces: prices that are still held form an interval, which only a new highest or lowest price
shrinks; those that leave it at one point go on together, as all prices do that move at the same point. One pass finds these
functions, range by range; composing them in order gives the price that enters each range; a second pass records the points.
Both passes stream over sorted rows and keep a few prices.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A price has moved when it differs by more than this many euros.
MOVE = 1.0
#: Observations from which a listing is cut, about those in a range, and ranges of a listing at most.
RANGE_ROWS, RANGES = 200_000, 1000
POINT = "listing_id long, price_eur double, seen_at timestamp, event_id long"


class Effect:
    """What a run of prices does to the price that comes in."""

    def __init__(self):
        self.low = self.high = None
        self.pieces: list[tuple[float, float]] = []  # lowest and highest price so far where a held price may leave
        self.now: list[float] = []  # prices that pieces have come to, ascending
        self.of: dict[float, list[int]] = {}  # pieces by such a price

    def add(self, p: float) -> None:
        moved: list[int] = []
        while self.now and abs(p - self.now[0]) > MOVE:
            moved += self.of.pop(self.now.pop(0))
        while self.now and abs(p - self.now[-1]) > MOVE:
            moved += self.of.pop(self.now.pop())
        open_ = self.low is None or abs(self.high - self.low) <= 2 * MOVE + 1e-6
        if open_ and (self.low is None or p < self.low or p > self.high):
            self.low = p if self.low is None else min(p, self.low)
            self.high = p if self.high is None else max(p, self.high)
            moved.append(len(self.pieces))
            self.pieces.append((self.low, self.high))
        if moved:
            if p not in self.of:
                self.now.insert(bisect_left(self.now, p), p)
                self.of[p] = []
            self.of[p] += moved

    def rows(self) -> tuple[list[float], list[float], list[float]]:
        came = [0.0] * len(self.pieces)
        for p, pieces in self.of.items():
            for k in pieces:
                came[k] = p
        return [a for a, _ in self.pieces], [b for _, b in self.pieces], came


def after(price: float | None, lows: list[float], highs: list[float], came: list[float]) -> float:
    """The price that a run leaves, from the one that comes in; None: nothing recorded yet."""
    for low, high, p in zip(lows, highs, came):
        if price is None or abs(high - price) > MOVE or abs(low - price) > MOVE:
            return p
    return price


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows of one listing and range, as they come; a run may come in several pieces."""
    for b in batches:
        keys = list(zip(b.column("listing_id").to_pylist(), b.column("range").to_pylist()))
        lo = 0
        while lo < len(keys):
            hi = lo + 1
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            yield keys[lo], b.slice(lo, hi - lo)
            lo = hi


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, effect = None, Effect()

    def row() -> pa.RecordBatch:
        columns = [pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int32()), *(pa.array([v], pa.list_(pa.float64())) for v in effect.rows())]
        return pa.RecordBatch.from_arrays(columns, ["listing_id", "range", "lows", "highs", "came"])

    for key, piece in _runs(batches):
        if key != last:
            if last is not None:
                yield row()
            last, effect = key, Effect()
        for p in piece.column("price_eur").to_pylist():
            effect.add(p)
    if last is not None:
        yield row()


def _entering(rows: pd.DataFrame) -> pd.DataFrame:
    """The price that enters each range of a listing; rows: one for each range, RANGES at most."""
    rows = rows.sort_values("range")
    price, out = None if pd.isna(rows["before"].iloc[0]) else float(rows["before"].iloc[0]), []
    for lows, highs, came in zip(rows["lows"], rows["highs"], rows["came"]):
        out.append(price)
        price = after(price, lows, highs, came)
    return pd.DataFrame({"listing_id": rows["listing_id"], "range": rows["range"], "entering": pd.Series(out, index=rows.index, dtype="float64")})


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, price = None, None
    for key, piece in _runs(batches):
        if key != last:
            last, price = key, piece.column("entering")[0].as_py()
        keep = []
        for p in piece.column("price_eur").to_pylist():
            keep.append(price is None or abs(p - price) > MOVE)
            if keep[-1]:
                price = p
        kept = piece.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("listing_id", "price_eur", "seen_at", "event_id")], ["listing_id", "price_eur", "seen_at", "event_id"])


def in_ranges(history: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """history with range: the number of its range of time in a listing of many observations, else 0; and cut."""
    at = F.unix_micros("seen_at")
    sizes = history.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > range_rows)
    marks = history.join(sizes, "listing_id").groupBy("listing_id").agg(F.percentile_approx(at, [k / RANGES for k in range(1, RANGES)]).alias("marks"), F.first("n").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(float(RANGES * range_rows)) / F.col("n"))).cast("int")
    cuts = marks.select("listing_id", F.array_distinct(F.filter("marks", lambda m, k: (k + 1) % step == 0)).alias("cuts"))
    return history.join(cuts, "listing_id", "left").withColumn("range", F.coalesce(F.size(F.filter("cuts", lambda c: c < at)), F.lit(0))).withColumn("cut", F.col("cuts").isNotNull()).drop("cuts")


def recorded_points(history: DataFrame, before: DataFrame | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The points of history (listing_id, price_eur, seen_at, event_id) that are recorded, by time and then event_id.

    before: listing_id, price_eur, the price last recorded for each listing that has one. Rows without a price, a time or a
    listing are no observations. Rows of one listing and time are in one range."""
    rows = history.select(F.col("listing_id").cast("long").alias("listing_id"), F.col("price_eur").cast("double").alias("price_eur"), F.col("seen_at").cast("timestamp").alias("seen_at"), F.col("event_id").cast("long").alias("event_id"))
    ranged = in_ranges(rows.where("listing_id is not null and price_eur is not null and seen_at is not null"), range_rows)
    dealt = lambda df: df.repartition("listing_id", "range").sortWithinPartitions("listing_id", "range", "seen_at", "event_id")
    known = before.select(F.col("listing_id").cast("long").alias("listing_id"), F.col("price_eur").cast("double").alias("before")) if before is not None else rows.sparkSession.createDataFrame([], "listing_id long, before double")
    effects = dealt(ranged.where("cut")).select("listing_id", "range", "price_eur").mapInArrow(_effects, "listing_id long, range int, lows array<double>, highs array<double>, came array<double>")
    entering = effects.join(known, "listing_id", "left").groupBy("listing_id").applyInPandas(_entering, "listing_id long, range int, entering double")
    entering = entering.unionByName(known.select("listing_id", F.lit(0).alias("range"), F.col("before").alias("entering"))).groupBy("listing_id", "range").agg(F.max("entering").alias("entering"))
    return dealt(ranged.drop("cut").join(entering, ["listing_id", "range"], "left")).mapInArrow(_points, POINT)
