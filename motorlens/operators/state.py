"""Latest state, price history, freshness: the incremental side, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens.operators.history import MOVE

FRESH_HOURS = 24


def admissible(df: DataFrame) -> DataFrame:
    """Adverts worth keeping: a price that is neither missing nor 0, and a title."""
    return df.where(F.col("price_eur").isNotNull() & (F.col("price_eur") != 0) & (F.coalesce(F.col("title"), F.lit("")) != ""))


def latest(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key. max_by combines on the map side, so a hot key shuffles one row for each task."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return got.select(*keys, "_row.*")


def first_and_last(history: DataFrame) -> DataFrame:
    """listing_id, first_price, last_price, dropped: whether the last price is more than a euro under the first."""
    at = F.struct("seen_at", "event_id")
    got = history.groupBy("listing_id").agg(F.min_by("price_eur", at).alias("first_price"), F.max_by("price_eur", at).alias("last_price"))
    return got.withColumn("dropped", F.col("last_price") < F.col("first_price") - MOVE)


def price_changes(history: DataFrame) -> DataFrame:
    """Observations that differ from the one before by more than a euro, or come first."""
    w = Window.partitionBy("listing_id").orderBy("seen_at", "event_id")
    prev = F.lag("price_eur").over(w)
    return history.withColumn("previous", prev).where(F.col("previous").isNull() | (F.abs(F.col("price_eur") - F.col("previous")) > MOVE))


def upsert(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...], at: str) -> DataFrame:
    """Latest state after a batch: rows of incoming replace those of stored; repeats in a batch: the last wins. Columns
    that incoming lacks keep what is stored; its own NULLs count."""
    only = [c for c in stored.columns if c not in incoming.columns]
    rest = [c for c in dict.fromkeys([*stored.columns, *incoming.columns]) if c not in keys and c not in only]
    both = stored.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    order = F.struct("_batch", at)
    kept = [F.max_by(F.struct(*only), F.when(F.col("_batch") == 0, order)).alias("_kept")] if only else []
    got = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"), *kept)
    return got.select(*keys, "_row.*", *(["_kept.*"] if only else []))


def stale(df: DataFrame, hours: Column, touched: Column | None = None, revalue_all: bool = False, repriced: Column | None = None) -> DataFrame:
    """Rows to value again: never analysed, analysed too long ago, priced anew since (repriced), or touched by this run."""
    if revalue_all:
        return df
    ok = hours.isNull() | (hours > FRESH_HOURS)
    for more in (touched, repriced):
        if more is not None:
            ok |= F.coalesce(more, F.lit(False))
    return df.where(ok)


def newest_first(df: DataFrame, at: str, key: str = "id") -> DataFrame:
    """df in the order in which a run takes its rows: those seen last come first."""
    return df.orderBy(F.desc_nulls_last(at), key)


def deactivate(df: DataFrame, source: str, unseen: Column) -> DataFrame:
    """Listings of a source that were not seen again become inactive."""
    return df.withColumn("active", F.when((F.col("source") == source) & unseen & F.col("active"), F.lit(False)).otherwise(F.col("active")))


def protect(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Analyses after a run: one that looked at photos is never replaced by one that did not."""
    o = old.select(key, F.struct(*[c for c in old.columns if c != key]).alias("_old"))
    n = new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("_new"))
    both = o.join(n, key, "full_outer")
    guard = F.col("_new").isNull() | ((F.col("_old.photos") > 0) & (F.col("_new.photos") == 0))
    return both.select(key, F.when(guard & F.col("_old").isNotNull(), F.col("_old")).otherwise(F.coalesce("_new", "_old")).alias("_row")).select(key, "_row.*")


def ingest_stats(seen: DataFrame, stored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """seen, created, updated, price_drops, skipped of a batch against what is stored."""
    s = stored.select(*keys, F.col("price_eur").alias("_stored"), F.lit(True).alias("_known"))
    ok = F.col("price_eur").isNotNull() & (F.col("price_eur") != 0) & (F.coalesce(F.col("title"), F.lit("")) != "")
    j = seen.join(s, list(keys), "left")
    known = F.col("_known").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("seen"), F.count_if(ok & ~known).alias("created"), F.count_if(ok & known).alias("updated"), F.count_if(ok & known & (F.col("price_eur") < F.col("_stored") - MOVE)).alias("price_drops"), F.count_if(~ok).alias("skipped"))


def applied(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...], at: str, turn: str) -> DataFrame:
    """The admissible rows of batch in the order in which they are applied, each with the price it replaces (previous),
    created, and moved: a new advert, or a price more than a euro from the one before. batch may repeat an advert."""
    old = stored.select(*keys, F.col(at), F.lit(None).cast("long").alias(turn), "price_eur", F.lit(0).alias("_new"))
    rows = admissible(batch).withColumn("_new", F.lit(1))
    w = Window.partitionBy(*keys).orderBy("_new", at, turn)
    rows = old.unionByName(rows, allowMissingColumns=True).withColumns({"previous": F.lag("price_eur").over(w), "created": F.row_number().over(w) == 1})
    moved = F.col("created") | F.coalesce((F.col("previous") != 0) & (F.abs(F.col("price_eur") - F.col("previous")) > MOVE), F.lit(False))
    return rows.where("_new = 1").withColumn("moved", moved).drop("_new")


def ingest(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...], at: str, turn: str) -> DataFrame:
    """The stored state after a batch, with first_seen, price_changed_at of the last move, and touched: whether this batch
    moved the price. What the batch does not say of an advert (scores, alerts, first_seen) stays as it is stored."""
    rows = applied(stored, batch, keys, at, turn)
    news = rows.groupBy(*keys).agg(F.max(F.when(F.col("moved"), F.col(at))).alias("_moved_at"), F.min(F.when(F.col("created"), F.col(at))).alias("_created_at"))
    for name in ("first_seen", "price_changed_at"):
        if name not in stored.columns:
            stored = stored.withColumn(name, F.lit(None).cast("timestamp"))
    now = upsert(stored.drop("touched"), rows.drop("previous", "created", "moved", "first_seen", "price_changed_at", turn), keys, at)
    out = now.join(news, list(keys), "left")
    return out.withColumns({
        "first_seen": F.coalesce("first_seen", "_created_at"), "price_changed_at": F.coalesce("_moved_at", "price_changed_at"), "touched": F.col("_moved_at").isNotNull(),
    }).drop("_moved_at", "_created_at")


def price_cuts(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...], at: str, turn: str) -> DataFrame:
    """The price cuts that a batch makes: keys, turn, previous and price_eur, each more than a euro lower."""
    rows = applied(stored, batch, keys, at, turn)
    return rows.where((F.col("previous") != 0) & (F.col("price_eur") < F.col("previous") - MOVE)).select(*keys, turn, "previous", "price_eur")


def seeded(rows: DataFrame, keys: tuple[str, ...], at: str) -> DataFrame:
    """Price points a second before the first sight of new adverts that state a higher price they had before."""
    new = rows.where(F.col("created") & (F.col("previous_price") > F.col("price_eur")))
    return new.select(*keys, F.col("previous_price").alias("price_eur"), (F.col(at) - F.expr("interval 1 second")).alias("seen_at"))
