"""Stored tables, the linear fold, and streams with state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from motorlens.operators import history, state
from motorlens.streaming import prices
from motorlens.streaming.store import Store

T0 = datetime.datetime(2025, 1, 1)


def folded(rows, before=None):
    """The fold, one row after the other."""
    last, out = dict(before or {}), []
    for listing, price, at, event in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[0], r[2], r[3])):
        if last.get(listing) is None or abs(price - last[listing]) > history.MOVE:
            out.append((listing, price, at, event))
            last[listing] = price
    return sorted(out)


def observations(n, seed=1):
    """One listing has most rows; prices wander by cents, some at the same time."""
    r = random.Random(seed)
    rows = [(1 if r.random() < 0.6 else r.randint(2, 9), round(100 + r.gauss(0, 1.5), r.choice([0, 1, 2])), T0 + datetime.timedelta(seconds=r.randint(0, n)), k) for k in range(n)]
    return [*rows, (1, None, T0, n), (None, 5.0, T0, n + 1)]


def test_effect_of_a_run_is_the_fold():
    r = random.Random(4)
    for _ in range(3000):
        run = [round(r.gauss(0, 1.5), r.choice([0, 1, 2, 5])) for _ in range(r.randint(1, 30))]
        effect = history.Effect()
        for p in run:
            effect.add(p)
        for price in [None, *run[:4], *(round(r.gauss(0, 2), 2) for _ in range(8))]:
            now = price
            for p in run:
                if now is None or abs(p - now) > history.MOVE:
                    now = p
            assert history.after(price, *effect.rows()) == now


@pytest.mark.parametrize("range_rows", [10**9, 400, 50])
def test_fold_in_ranges(spark, range_rows):
    rows = observations(3000)
    df = spark.createDataFrame(rows, history.POINT)
    assert sorted(map(tuple, history.recorded_points(df, range_rows=range_rows).collect())) == folded(rows)
    before = {1: 100.5, 3: 90.0, 77: 1.0}
    known = spark.createDataFrame(list(before.items()), "listing_id long, price_eur double")
    assert sorted(map(tuple, history.recorded_points(df, known, range_rows).collect())) == folded(rows, before)


def test_hot_listing_is_cut(spark):
    df = spark.createDataFrame(observations(3000), history.POINT)
    sizes = {r["range"]: r["count"] for r in history.in_ranges(df.where("listing_id = 1 and price_eur is not null"), 200).groupBy("range").count().collect()}
    assert len(sizes) > 5 and max(sizes.values()) < 3 * 200


KEYS, SEEN = ("id",), "id long, last_seen timestamp, price_eur double, title string, turn long"


def batch(spark, *rows):
    return spark.createDataFrame([(i, T0 + datetime.timedelta(hours=h), p, "car", h) for i, h, p in rows], SEEN)


def take(old, new):
    return state.ingest(old, new, KEYS, "last_seen", "turn")


def content(store):
    return {r["id"]: (r["price_eur"], r["first_seen"], r["price_changed_at"]) for r in store.read().collect()}


def test_store_applies_a_batch_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", KEYS, SEEN.replace(", turn long", ""), buckets=4)
    assert store.read().count() == 0
    first, second = batch(spark, (1, 0, 10.0), (2, 0, 20.0), (1, 1, 10.5)), batch(spark, (2, 5, 15.0), (3, 5, 30.0))
    assert store.apply("a", 0, first, take) and not store.apply("a", 0, second, take)
    at = lambda h: T0 + datetime.timedelta(hours=h)
    assert content(store) == {1: (10.5, at(0), at(0)), 2: (20.0, at(0), at(0))}
    assert store.apply("scores", 0, store.read().select("id", F.lit(7).alias("score")), lambda old, new: old.join(new, "id", "left"))
    assert store.apply("a", 1, second, take) and not store.apply("a", 1, second, take)
    assert content(store) == {1: (10.5, at(0), at(0)), 2: (15.0, at(0), at(5)), 3: (30.0, at(5), at(5))}
    assert {r["id"]: r["score"] for r in store.read().collect()} == {1: 7, 2: 7, 3: None}
    assert len(content(store)) == 3 and store.read(1).count() == 2
    store.clean(1)
    assert store.manifest()["version"] == 3 and store.read().count() == 3
    assert store.apply("a", 2, batch(spark).where("false"), take) and store.read().count() == 3


def test_store_after_a_failure_between_write_and_commit(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", KEYS, SEEN.replace(", turn long", ""), buckets=4)
    store.apply("a", 0, batch(spark, (1, 0, 10.0)), take)
    before = content(store)

    def fail(manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", fail)
        with pytest.raises(OSError):
            store.apply("a", 1, batch(spark, (1, 1, 99.0), (2, 1, 5.0)), take)
    assert content(store) == before and store.manifest()["applied"] == {"a": 0}
    again = Store(spark, store.root, KEYS, SEEN)
    assert again.apply("a", 1, batch(spark, (1, 1, 99.0), (2, 1, 5.0)), take) and len(content(again)) == 2
    held = len(list((tmp_path / "s" / "data").iterdir()))
    again.clean(1)
    assert len(list((tmp_path / "s" / "data").iterdir())) < held and len(content(again)) == 2


def test_second_writer_fails(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", KEYS, SEEN)
    store.apply("a", 0, batch(spark, (1, 0, 10.0)), take)
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit({"version": 1, "folders": {}, "applied": {}})


def test_store_follows_a_stream_that_is_replayed(spark, tmp_path):
    """Without its checkpoint a stream starts over with batch 0, which the store has."""
    batch(spark, (1, 0, 10.0), (2, 0, 20.0)).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    store = Store(spark, f"file://{tmp_path}/s", KEYS, SEEN.replace(", turn long", ""))
    stream = lambda: spark.readStream.schema(SEEN).parquet(f"{tmp_path}/in/*")
    store.follow("feed", stream(), f"{tmp_path}/c1", take)
    once = content(store)
    store.follow("feed", stream(), f"{tmp_path}/c2", take)
    assert content(store) == once and store.manifest()["version"] == 1
    batch(spark, (2, 3, 25.0)).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    store.follow("feed", stream(), f"{tmp_path}/c1", take)
    assert content(store)[2][0] == 25.0 and store.manifest()["version"] == 2


def test_stream_of_prices_in_several_batches(spark, tmp_path):
    """Batches come one after the other; each goes on from the prices recorded last, also after a restart."""
    rows = observations(900, seed=5)
    ordered = sorted(rows, key=lambda r: r[2])
    parts = [ordered[:300], ordered[300:600], ordered[600:]]
    got = None
    for k, part in enumerate(parts):
        spark.createDataFrame(part, history.POINT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        got = prices.follow_prices(spark.readStream.schema(history.POINT).parquet(f"{tmp_path}/in/*"), f"file://{tmp_path}/state")
    want, before = [], {}
    for part in parts:
        points = folded(part, before)
        want += points
        before |= {r[0]: r[1] for r in sorted(points, key=lambda r: (r[2], r[3]))}
    assert sorted(map(tuple, got.select("listing_id", "price_eur", "seen_at", "event_id").collect())) == sorted(want)


def test_listings_end_and_come_back(spark, tmp_path):
    """A timer ends a listing, a new sighting brings it back, and it may end again; late rows change nothing."""
    schema = "listing_id long, seen_at timestamp"
    at = lambda h: T0 + datetime.timedelta(hours=h)
    steps = [([(1, at(1)), (1, at(0)), (2, at(0)), (9, at(4))], {}), ([(9, at(20))], {1: False, 2: False}), ([(1, at(22)), (9, at(23))], {1: True, 2: False}), ([(9, at(60))], {1: False, 2: False})]
    for k, (rows, want) in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        got = prices.follow_activity(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"file://{tmp_path}/state", "6 hours")
        assert {r["listing_id"]: r["active"] for r in got.collect() if r["listing_id"] != 9} == want
    assert {r["listing_id"]: r["last_seen"] for r in got.collect()}[1] == at(22)


def test_upsert_keeps_what_the_batch_lacks(spark):
    t = T0
    old = spark.createDataFrame([(1, 10.0, "note", "x", t), (2, 20.0, None, "y", t)], "id long, price double, note string, said string, at timestamp")
    new = spark.createDataFrame([(1, 11.0, None, t), (3, 30.0, "z", t)], "id long, price double, said string, at timestamp")
    got = {r["id"]: (r["price"], r["note"], r["said"]) for r in state.upsert(old, new, ("id",), "at").collect()}
    assert got == {1: (11.0, "note", None), 2: (20.0, None, "y"), 3: (30.0, None, "z")}
