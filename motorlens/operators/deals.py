"""Serving: one advert for each car, top deals, filters, dashboard figures, cross-posted groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens import schemas as s


def search_filter(df: DataFrame, q: s.SearchQuery) -> DataFrame:
    """Active, priced listings that meet make, model, price, year, km and country criteria (the others are not used here)."""
    ok = F.col("active") & F.col("price_eur").isNotNull()
    for value, test in (
        (q.make, lambda v: F.col("make") == v), (q.model, lambda v: F.col("model") == v), (q.price_max, lambda v: F.col("price_eur") <= v), (q.price_min, lambda v: F.col("price_eur") >= v),
        (q.year_min, lambda v: F.col("year") >= v), (q.km_max, lambda v: F.col("km") <= v), (q.countries, lambda v: F.col("country").isin(*v)),
    ):
        if value:
            ok &= test(value)
    return df.where(ok)


def matches(q: s.SearchQuery) -> Column:
    """The looser match of standing queries: names ignore case, a missing number counts as 0."""
    ok = F.lit(True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    for value, test in (
        (q.make, lambda v: F.lower("make") == v.lower()), (q.model, lambda v: F.lower("model") == v.lower()), (q.price_max, lambda v: zero("price_eur") <= v), (q.price_min, lambda v: zero("price_eur") >= v),
        (q.year_min, lambda v: zero("year") >= v), (q.km_max, lambda v: zero("km") <= v), (q.fuel, lambda v: F.col("fuel") == v), (q.countries, lambda v: F.col("country").isin(*v)),
    ):
        if value:
            ok &= F.coalesce(test(value), F.lit(False))
    return ok


def car_key() -> Column:
    return F.coalesce(F.nullif(F.col("fingerprint"), F.lit("")), F.concat(F.lit("id:"), F.col("id")))


def best_per_vehicle(df: DataFrame) -> DataFrame:
    """The best advert of each car, with others (how many more) and spread_eur (dearest of them less its price)."""
    w = Window.partitionBy("car").orderBy(F.desc("score"), F.asc_nulls_last(F.when(F.col("price_eur") != 0, F.col("price_eur"))), "id")
    every = Window.partitionBy("car")
    ranked = df.withColumn("car", car_key()).withColumns({"_rn": F.row_number().over(w), "others": (F.count(F.lit(1)).over(every) - 1).cast("int"), "_dearest": F.max("price_eur").over(every)})
    return ranked.where("_rn = 1").withColumn("spread_eur", F.greatest(F.lit(0.0), F.col("_dearest") - F.col("price_eur"))).drop("_rn", "_dearest", "car")


def top_deals(df: DataFrame, limit: int = 60, min_score: float = 0, make: str | None = None, verdict: str | None = None) -> DataFrame:
    """Cars first, then the limit, so that cross-posts never crowd out other cars."""
    ok = F.col("active") & F.col("score").isNotNull() & (F.col("score") >= min_score)
    if make:
        ok &= F.col("make") == make
    if verdict:
        ok &= F.col("verdict") == verdict
    return best_per_vehicle(df.where(ok)).orderBy(F.desc("score"), "id").limit(limit)


def dashboard(df: DataFrame, watchlists: int = 0) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score").isNotNull()).alias("analysed"), F.count_if(F.col("score") >= s.GREAT).alias("great")).withColumn("watchlists", F.lit(watchlists))


def distinct_makes(df: DataFrame) -> DataFrame:
    return df.where("make is not null").select("make").distinct().orderBy("make")


def complete(stubs: DataFrame, details: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Stubs with blanks (NULL, empty, unknown) filled from the detail of the same key."""
    d = details.select(key, *[F.col(c).alias(f"_d_{c}") for c in columns])
    blank = lambda c: F.col(c).isNull() | F.col(c).cast("string").isin("", "unknown")
    return stubs.join(d, key, "left").withColumns({c: F.when(blank(c), F.coalesce(F.col(f"_d_{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}).drop(*[f"_d_{c}" for c in columns])


#: Two adverts of one car: km apart at most, and price apart at most as a share of the cheaper.
SAME_KM, SAME_PRICE = 3000, 0.15
#: Km of a cell, in which and beside which near ones are sought, and ids of adverts alike that are joined as one row at most.
CELL_KM, ALIKE = 4 * SAME_KM, 1000


def same_car(df: DataFrame) -> DataFrame:
    """id, twin_id (id < twin_id) of adverts that look like one car though a field differs: equal make, model and year
    (unknown equals unknown); km, power and price near each other where both are known. df: those columns and id.

    Adverts alike in all of that are joined as one row, which holds their ids, and pairs are made of it last. Rows meet by what
    they have: by power and a cell of km, by power where km is open, by make, model and year alone where power is."""
    facts = ("make", "model", "year", "km", "power_hp", "price_eur")
    # Dealt and counted without the price, since what is grouped by a fraction is dealt anew.
    turn = F.row_number().over(Window.partitionBy(*facts[:-1]).orderBy("price_eur", "id"))
    kinds = df.select("id", *facts).withColumn("part", F.floor(turn / F.lit(ALIKE)).cast("int")).groupBy(*facts, "part").agg(F.collect_list("id").alias("ids"))
    level = F.when(~F.coalesce(F.col("power_hp") != 0, F.lit(False)), 3).when(F.col("km").isNull(), 2).otherwise(1)
    kinds = kinds.withColumn("level", level)
    key = lambda at, power, cell: F.struct(F.lit(at).alias("at"), power.cast("double").alias("power"), cell.cast("long").alias("cell"))
    cell, none = (lambda km: F.floor(km / F.lit(CELL_KM))), F.lit(None)
    cells = F.transform(F.sequence(cell(F.col("km") - SAME_KM), cell(F.col("km") + SAME_KM)), lambda c: key(1, F.col("power_hp"), c))
    sought = F.when(F.col("level") == 1, cells).when(F.col("level") == 2, F.array(key(2, F.col("power_hp"), none))).otherwise(F.array(key(3, none, none)))
    met = F.array_compact(F.array(F.when(F.col("level") == 1, key(1, F.col("power_hp"), cell(F.col("km")))), F.when(F.col("level") < 3, key(2, F.col("power_hp"), none)), key(3, none, none)))
    a, b = (kinds.withColumn("key", F.explode(keys)).alias(n) for n, keys in (("a", sought), ("b", met)))
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    known = lambda c: F.coalesce(x(c) != 0, F.lit(False)) & F.coalesce(y(c) != 0, F.lit(False))
    near = F.coalesce(F.abs(x("km") - y("km")) <= SAME_KM, F.lit(True)) & (~known("power_hp") | (x("power_hp") == y("power_hp")))
    near &= ~known("price_eur") | (F.abs(x("price_eur") - y("price_eur")) / F.least(x("price_eur"), y("price_eur")) <= SAME_PRICE)
    alike = x("key").eqNullSafe(y("key")) & x("make").eqNullSafe(y("make")) & x("model").eqNullSafe(y("model")) & x("year").eqNullSafe(y("year"))
    # The wider of two rows seeks the other, the first of equals; a row meets itself too.
    mine, other = (F.struct(*[c(n) for n in (*facts, "part")]) for c in (x, y))
    turn = (x("level") > y("level")) | (x("level") == y("level")) & (mine <= other)
    both = a.join(b, alike & near & turn).select((mine == other).alias("itself"), x("ids").alias("ids"), y("ids").alias("others"))
    pairs = both.select("itself", "others", F.explode("ids").alias("one")).select("itself", "one", F.explode("others").alias("other"))
    pairs = pairs.where(F.when(F.col("itself"), F.col("one") < F.col("other")).otherwise(F.col("one") != F.col("other")))
    return pairs.select(F.least("one", "other").alias("id"), F.greatest("one", "other").alias("twin_id"))


def to_reopen(scored: DataFrame, sources: tuple[str, ...], limit: int) -> DataFrame:
    """The adverts of a shortlist to open again: best score first, those without a description of sources that can open
    adverts. limit is a budget of requests, not of successes."""
    return scored.where(F.col("source").isin(*sources) & (F.coalesce("description", F.lit("")) == "")).orderBy(F.desc("score"), "id").limit(limit)


def completed(listed: DataFrame, opened: DataFrame, key: str) -> DataFrame:
    """Adverts as their own page tells them, with what only the results page knew: open or unknown fields are filled, the
    longer list of photos stays, options are united, maps are merged with the advert's own entries on top. Rows of opened
    without a description change nothing and are left out; others have the columns of listed."""
    o = opened.where(F.coalesce("description", F.lit("")) != "").select(key, *[F.col(c).alias(f"_{c}") for c in listed.columns if c != key and c in opened.columns])
    both = listed.join(o, key)

    def merged(name: str, kind: str) -> Column:
        if f"_{name}" not in both.columns:
            return F.col(name)
        mine, full = F.col(name), F.col(f"_{name}")
        if name == "photos":
            return F.when(F.coalesce(F.size(mine), F.lit(0)) > F.coalesce(F.size(full), F.lit(0)), mine).otherwise(full)
        if kind.startswith("array"):
            empty = F.array().cast(kind)
            return F.array_sort(F.array_union(F.coalesce(mine, empty), F.coalesce(full, empty)))
        if kind.startswith("map"):
            return F.when(mine.isNull(), full).when(full.isNull(), mine).otherwise(F.map_concat(F.map_filter(mine, lambda k, _: ~F.map_contains_key(full, k)), full))
        if name == "scraped_at":
            return full
        open_ = full.isNull() | F.coalesce(full.cast("string").isin("", "unknown"), F.lit(False))
        held = mine.isNotNull() & (mine.cast("string") != "")
        return F.when(open_ & held, mine).otherwise(full)

    return both.select(*[F.col(c) if c == key else merged(c, k).alias(c) for c, k in listed.dtypes])
