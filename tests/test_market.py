"""The chain on a market whose true prices are known."""

import re

from pyspark.sql import functions as F

from motorlens.operators import alerts, deals, expert, valuation
from motorlens.plans.market_queries import WATCHLISTS
from motorlens.sources import market
from motorlens.sources.fixtures import as_of, listings


def test_prices_scores_and_alerts(spark):
    ads = market.generate(spark, 4000, as_of(), seed=11).cache()
    valued = valuation.value_market(ads, as_of())
    worded = valued.withColumns({"title": F.concat_ws(" ", "make", "model", "year"), "version": F.lit(None).cast("string"), "price_dropped": F.lit(False)})
    scored = expert.score(expert.report(worded, as_of()), as_of()).cache()
    error = scored.where("comps_count >= 6 and kind = 'fair'").select(F.median(F.abs(F.col("fair_price_eur") - F.col("true_price")) / F.col("true_price"))).head()[0]
    assert error < 0.12
    medians = {r["kind"]: r["m"] for r in scored.groupBy("kind").agg(F.median("score").alias("m")).collect()}
    assert medians["bargain"] > medians["fair"] > medians["trap"]
    top = deals.top_deals(scored, 20).collect()
    assert len(top) == 20 and not any(r["kind"] == "trap" for r in top) and sum(r["kind"] == "bargain" for r in top) >= 8
    none = spark.createDataFrame([], "watchlist_id int, listing_id long")
    first = alerts.new_alerts(scored, WATCHLISTS, none, cap=10**6)
    sent = alerts.record(first, F.current_timestamp()).select("watchlist_id", "listing_id")
    assert alerts.new_alerts(scored, WATCHLISTS, sent, cap=10**6).count() == 0


def test_steps_choose_what_one_join_chooses(spark):
    """Targets leave fuel, gearbox, year or km open; one model and country has a third of all adverts."""
    ads = market.generate(spark, 900, as_of(), seed=5)
    hot, first = F.col("id") % 3 == 0, ads.orderBy("id").select("make", "model", "country").head()
    ads = ads.withColumns({c: F.when(hot, F.lit(first[c])).otherwise(F.col(c)) for c in ("make", "model", "country")})
    ads = ads.withColumns({"fuel": F.when(F.col("id") % 7 == 0, "unknown").otherwise(F.col("fuel")), "gearbox": F.when(F.col("id") % 11 == 0, "unknown").otherwise(F.col("gearbox"))})
    ads = ads.withColumns({"year": F.when(F.col("id") % 13 != 0, F.col("year")), "km": F.when(F.col("id") % 17 != 0, F.col("km"))})
    m = valuation.vehicle_factor(ads, as_of()).cache()
    rows = lambda df: sorted((r["t_id"], r["car"], r["chosen"], r["comps"], r["ad"]["id"]) for r in df.select("t_id", "car", "chosen", "comps", "ad").collect())
    for limit in (None, 10):
        whole = rows(valuation.comparables(valuation.pairs(m, m), limit=limit))
        assert len({r[2] for r in whole}) >= 4 and rows(valuation.find(m, m, limit=limit)) == whole == rows(valuation.find(m, m, limit=limit, steps=(1, 3, 4, 5)))
    found = valuation.find(m, m.limit(0))
    assert found.count() == 0 and valuation.find(m.limit(0), m).count() == 0


def test_steps_join_fewer_pairs_as_the_market_grows(spark):
    """Of four times the adverts, the wide step sees fewer targets, while one join would make sixteen times the pairs."""
    share = []
    for n in (1500, 6000):
        m = valuation.vehicle_factor(market.generate(spark, n, as_of(), seed=5), as_of()).cache()
        done = valuation.comparables(valuation.pairs(m, m, widest=3), widest=3).select("t_id").distinct().count()
        share.append(1 - done / n)
    assert share[1] < 0.6 * share[0]


def test_copies_of_a_car_add_no_pairs(spark):
    """Adverts that only differ in id, price and seller are one kind, and the comparables stay those of one join; some targets
    stand in the market with another fingerprint or have none."""
    ads = market.generate(spark, 150, as_of(), seed=5).withColumns({"make": F.lit("Audi"), "model": F.lit("A4")})
    ads = ads.withColumn("fingerprint", F.when(F.col("id") % 10 != 0, F.col("fingerprint")).otherwise(""))
    copies = ads.crossJoin(spark.range(4).withColumnRenamed("id", "n")).withColumns({"id": F.col("id") + 1000 * F.col("n"), "price_eur": F.col("price_eur") + 7 * F.col("n"), "seller_type": F.when(F.col("n") % 2 == 0, "pro").otherwise("private")}).drop("n")
    one, four = (valuation.vehicle_factor(df, as_of()).cache() for df in (ads, copies))
    kinds = [valuation.specs(valuation.own(m.where("fingerprint <> ''"), None)).count() for m in (one, four)]
    assert kinds[0] == kinds[1]
    moved = four.withColumns({"fingerprint": F.when(F.col("id") % 7 == 0, F.lit("x")).otherwise(F.col("fingerprint"))})
    rows = lambda df: sorted((r["t_id"], r["t_factor"], r["car"], r["chosen"], r["comps"], r["ad"]["id"]) for r in df.collect())
    assert rows(valuation.find(four, four, limit=5, among=True)) == rows(valuation.comparables(valuation.pairs(four, four), limit=5))
    assert rows(valuation.find(moved, four)) == rows(valuation.comparables(valuation.pairs(moved, four)))


def test_comparables_are_found_without_shuffling_pairs(spark):
    """Only the two sides of the join are dealt."""
    ads = market.generate(spark, 30, as_of(), seed=5).withColumn("is_synthetic", F.col("id") % 2 == 0)
    m = valuation.vehicle_factor(ads, as_of())
    (first, dealt), *_ = valuation.chosen_steps(valuation.specs(valuation.own(m, None)), m)
    plan = first._jdf.queryExecution().sparkPlan().toString() + first._jdf.queryExecution().executedPlan().toString()
    assert dealt and "hashpartitioning(t_id" not in plan


def test_one_offer_of_a_kind_is_enough_among_themselves(spark, monkeypatch):
    """Of adverts that differ in id and price alone, one is joined, not the cheapest two; prices stay those of one join."""
    ads = market.generate(spark, 60, as_of(), seed=5).withColumns({"make": F.lit("Audi"), "model": F.lit("A4"), "seen_days": F.lit(1)})
    ads = ads.withColumn("fingerprint", F.when(F.col("id") % 10 != 0, F.col("fingerprint")).otherwise(""))
    ads = ads.crossJoin(spark.range(3).withColumnRenamed("id", "n")).withColumns({"id": F.col("id") + 1000 * F.col("n"), "price_eur": 5000 + F.col("price_eur") + F.col("n")}).drop("n").cache()
    joined, admitted = [], valuation._admitted
    monkeypatch.setattr(valuation, "_admitted", lambda t, c, *how: joined.append(c) or admitted(t, c, *how))
    valued = valuation.value_market(ads, as_of()).where("comps_count > 0")
    alone = F.when(F.col("fingerprint") == "", F.col("id"))
    assert joined[0].count() == valuation.SHARES * ads.select(*valuation.SPEC, alone).distinct().count()
    m = valuation.vehicle_factor(ads, as_of())
    whole = valuation.comparables(valuation.pairs(m, m)).groupBy("t_id").agg(F.first("comps").alias("comps"), F.min(F.col("ad.price") * F.col("t_factor") / F.col("ad.factor")).alias("least"))
    rows = lambda df: sorted((r[0], r[1], round(r[2], 4)) for r in df.collect())
    assert rows(valued.select("id", "comps_count", "min_adjusted")) == rows(whole.select("t_id", "comps", "least"))


def test_first_step_stays_within_one_fuel(spark):
    """Steps choose what one join chooses, targets of unknown fuel and adverts without a fingerprint included."""
    i = F.col("id")
    m = valuation.vehicle_factor(listings(spark, "/root/testdata/sf0.001"), as_of()).where("model like '%v1'")
    m = m.withColumns({"fuel": F.when(i % 7 == 0, "unknown").otherwise(F.col("fuel")), "fingerprint": F.when(i % 5 == 1, "").otherwise(F.col("fingerprint")), "country": F.lit("FR"), "km": 50_000 + i % 900}).localCheckpoint()
    targets = m.where("price_eur is not null")
    rows = lambda df: sorted(df.select("t_id", "car", "chosen", "comps", "ad.id").collect())
    assert rows(valuation.find(targets, m, min_count=2, among=True)) == rows(valuation.comparables(valuation.pairs(targets, m), min_count=2))
    first, _ = valuation.chosen_steps(valuation.specs(valuation.own(targets, None)), m, min_count=2, among=True)[0]
    assert {r[0] for r in first.select("chosen").distinct().collect()} <= {1, 2}
    assert first.count() > 0


def test_adverts_are_dealt_once(spark):
    """By the pool of the first step; wider steps deal kinds (t_*, c_*), and prices come back to the adverts where these lie."""
    valued = valuation.value_market(market.generate(spark, 40, as_of(), seed=5), as_of())
    plan = valued._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\((\w+?)#", plan)) <= {"_home", "t_home", "t_deal", "c_deal", "t_id"}


def test_prices_come_beside_targets(spark):
    """Unknown keys are alike; rows without a match stay, and columns of NULL do not hide a match."""
    a = spark.createDataFrame([(1, None, 1), (1, None, 2), (1, 5, 3), (2, 5, 4)], "k int, j int, id int").repartition(3, "k")
    b = spark.createDataFrame([(1, None, None, "x"), (2, 5, 7, None), (3, 5, 8, "z")], "k int, j int, v int, w string").repartition(3, "k")
    both = valuation.beside(a, b, ("k", "j"))
    assert sorted(map(tuple, both.select("id", "v", "w").collect())) == [(1, None, "x"), (2, None, "x"), (3, None, None), (4, 7, None)]
    assert both._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 2


def test_pairs_are_counted_without_being_made(spark):
    """The counts are those of the pairs, for targets that leave fuel, gearbox, year or km open, odd numbers, and adverts without
    a fingerprint; no plan joins adverts."""
    ads = market.generate(spark, 300, as_of(), seed=5)
    i, first = F.col("id"), ads.orderBy("id").select("make", "model", "country").head()
    ads = ads.withColumns({c: F.when(i % 3 != 0, F.lit(first[c])).otherwise(F.col(c)) for c in ("make", "model", "country")})
    ads = ads.withColumns({
        "country": F.when(i % 29 != 0, F.col("country")), "fuel": F.when(i % 7 == 0, "unknown").when(i % 19 != 0, F.col("fuel")), "gearbox": F.when(i % 11 == 0, "unknown").when(i % 23 != 0, F.col("gearbox")),
        "year": F.when(i % 13 == 0, 0).when(i % 31 == 0, 3).when(i % 17 != 0, F.col("year")), "km": F.when(i % 10 == 0, 0).when(i % 37 == 0, -20_000).when(i % 41 == 0, -700).when(i % 9 != 0, F.col("km")),
        "fingerprint": F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat(F.lit("car"), i % 8)).when(i % 43 != 0, F.col("fingerprint")),
    })
    m = valuation.vehicle_factor(ads, as_of()).localCheckpoint()
    for target in (i % 4 != 0, (i % 4 != 0) & F.col("year").isNotNull() & (F.col("year") > 0) & ~F.col("fuel").eqNullSafe("unknown") & ~F.col("gearbox").eqNullSafe("unknown")):
        want = valuation.pairs(m.where(target), m, exclude_ids=(4, 5)).groupBy("tier").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("c_id") % 1000).alias("total"))
        got = valuation.pair_counts(m, target, i % 1000, exclude_ids=(4, 5))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert want.count() == 5 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_adverts_alike_are_paired_as_one_row(spark, monkeypatch):
    """The pairs are those of all adverts with all, open fields, negative km and copies included; adverts that are alike, and
    those of far km or other power, do not meet each other one by one."""
    i = F.col("id")
    ads = spark.range(400).select(
        "id", F.when(i % 50 != 0, "Audi").alias("make"), F.lit("A4").alias("model"), F.when(i % 7 != 0, (2015 + i % 2).cast("int")).alias("year"),
        F.when(i % 11 != 0, (F.pmod(F.xxhash64(i % 60), F.lit(40)) * 1000 - 4000 + i % 3).cast("int")).alias("km"), F.when(i % 13 == 0, 0).when(i % 17 != 0, (100 + i % 3 * 10).cast("int")).alias("power_hp"),
        F.when(i % 19 == 0, 0.0).when(i % 23 != 0, 10_000.0 + i % 5 * 900).alias("price_eur"),
    )
    ads = ads.unionByName(ads.where("id < 40").withColumn("id", i + 1000))
    rows = [r.asDict() for r in ads.collect()]
    unlike = lambda a, b, c: a[c] and b[c] and a[c] != b[c]
    far = lambda a, b: a["km"] is not None and b["km"] is not None and abs(a["km"] - b["km"]) > deals.SAME_KM
    dear = lambda a, b: a["price_eur"] and b["price_eur"] and abs(a["price_eur"] - b["price_eur"]) / min(a["price_eur"], b["price_eur"]) > deals.SAME_PRICE
    same = lambda a, b: all(a[c] == b[c] for c in ("make", "model", "year")) and not (unlike(a, b, "power_hp") or far(a, b) or dear(a, b))
    want = sorted((a["id"], b["id"]) for a in rows for b in rows if a["id"] < b["id"] and same(a, b))
    assert len(want) > 3000
    for alike in (2, 1000):
        monkeypatch.setattr(deals, "ALIKE", alike)
        got = deals.same_car(ads)
        assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :] and "Explode" in plan.title()
