"""Queries over pages and batches that are built from the orders, one advert for each order, so that oracles know what the
pages say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.operators import deals, profile, state
from motorlens.sources import pages as pg
from motorlens.sources import trees
from motorlens.sources.fixtures import as_of, spread, tasks_of
from motorlens.streaming.folders import shared_folder
from motorlens.streaming.store import Store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    df = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id")))
    return df.select("id", (2000 + F.col("id") % 30000).alias("price"), (10000 + (F.col("id") * 7) % 90000).alias("km"), (60 + F.col("id") % 200).alias("power"), (2008 + F.col("id") % 15).alias("year"), (1 + F.col("id") % 12).alias("month"))


_ADVERTS = "WITH a AS (SELECT o_orderkey::BIGINT AS id, 2000 + o_orderkey % 30000 AS price, 10000 + (o_orderkey * 7) % 90000 AS km, 60 + o_orderkey % 200 AS power, 2008 + o_orderkey % 15 AS year, 1 + o_orderkey % 12 AS month FROM orders)"


def _say(template: str, **values: Column) -> Column:
    """template with {name} replaced by columns; a NULL column leaves out nothing but itself."""
    parts, rest = [], template
    while rest:
        text, brace, rest = rest.partition("⟨")
        parts.append(F.lit(text))
        if brace:
            name, _, rest = rest.partition("⟩")
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def _dotted(n: Column) -> Column:
    return F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


#: How deep the results list lies in graphs.
_DEEP = 10


def _result_pages(a: DataFrame) -> DataFrame:
    """Twenty adverts a page, the first of them listed twice. Every third has its km on its card alone, every thirteenth a
    km that cannot be, every fifth its price on its card alone. Cards hold a named gallery before their pills, whose text is
    in nested tags."""
    i, value = F.col("id"), {"id": F.col("id"), "n": 1000000 + F.col("id"), "km": F.col("km"), "price": F.col("price"), "power": F.col("power"), "dotted_km": _dotted(F.col("km")), "dotted": _dotted(F.col("price")), "since": F.concat_ws("/", F.lpad(F.col("month").cast("string"), 2, "0"), "year")}
    km = F.when(i % 13 == 0, F.lit(',"mileageFromOdometer":98000000')).when(i % 3 != 0, _say(',"mileageFromOdometer":{"@type":"QuantitativeValue","value":"⟨dotted_km⟩","unitCode":"KMT"}', **value)).otherwise("")
    seller = F.when(i % 4 == 0, F.lit(',"seller":{"@type":"AutoDealer","name":"X"}')).otherwise("")
    offer = F.when(i % 5 != 0, _say(',"offers":{"@type":"Offer","price":"⟨dotted⟩ €"⟨seller⟩}', **value, seller=seller)).otherwise("")
    item = _say('{"@type":"ListItem","item":{"@type":"https://schema.org/Car","name":"Car ⟨id⟩"⟨km_⟩⟨offer⟩,"url":"/d/advert-⟨n⟩?ref=x"}}', **value, km_=km, offer=offer)
    before = F.when(i % 7 == 0, F.col("price") + 500).when(i % 7 == 1, F.col("price") - 500)
    card = _say('<article class="card" data-guid="⟨n⟩" data-price="⟨price⟩" data-mileage="⟨km⟩" data-zip-code="⟨zip⟩" data-seller-type="⟨code⟩" data-first-registration="⟨since⟩" data-fuel="b"><div id="gallery-⟨n⟩"><img src="x.jpg"></div><h2>Car</h2><div><span class="ListItemPill_text__a1">Diesel</span><span class="ListItemPill_text__a1"><i>9 kW</i> (<b>⟨power⟩ <u>Ch</u></b>)</span></div>⟨old⟩</article>', **value, zip=F.lpad((i % 99999).cast("string"), 5, "0"), code=F.element_at(F.array(F.lit("p"), F.lit("d"), F.lit("z")), (i % 3 + 1).cast("int")), old=F.when(before.isNotNull(), F.concat(F.lit('<s class="PreviousPrice_price__b"><em>'), before.cast("string"), F.lit("</em> €</s>"))))
    rows = a.select(F.expr("id div 20").alias("page"), F.struct("id", item.alias("item"), card.alias("card")).alias("r")).repartition(tasks_of(a), "page").groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("r"))
    items = F.concat_ws(",", F.transform("r", lambda x: x["item"]), F.col("r")[0]["item"])
    deep, shut = '{"@graph":[' * _DEEP, "]}" * _DEEP
    html = F.concat(F.lit(f'<html><script type="application/ld+json">[{{"@type":"WebSite"}},{deep}{{"@type":"SearchResultsPage","mainEntity":{{"@type":"ItemList","itemListElement":['), items, F.lit(f"]}}}}{shut},]</script>"), F.concat_ws("", F.transform("r", lambda x: x["card"])), F.lit("</html>"))
    return rows.select(F.concat(F.lit("https://a.de/search?page="), F.col("page")).alias("url"), html.alias("html"))


@query(_ADVERTS + """ SELECT 'https://a.de/search?page=' || id // 20 AS page, (1000000 + id)::VARCHAR AS source_id, (row_number() OVER (PARTITION BY id // 20 ORDER BY id))::INT AS position, price::DOUBLE AS price, km::INT AS km, power::INT AS power_hp, 'Car ' || id || ' essence' AS title,
year::INT AS year, make_date(year, month, 1) AS first_registration, CASE WHEN id % 4 = 0 AND id % 5 <> 0 THEN 'pro' WHEN id % 3 = 0 THEN 'private' WHEN id % 3 = 1 THEN 'pro' ELSE 'unknown' END AS seller_type, lpad((id % 99999)::VARCHAR, 5, '0') AS postcode, CASE WHEN id % 7 = 0 THEN price + 500.0::DOUBLE END AS previous_price FROM a""")
def results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD lists of results pages with their cards merged in."""
    rows = pg.results_page(_result_pages(_adverts(spark, sf_dir)), as_of())
    return rows.select("page", "source_id", F.col("position").cast("int").alias("position"), "price", "km", "power_hp", "title", "year", "first_registration", "seller_type", "postcode", "previous_price")


@query(_ADVERTS + " SELECT 'https://a.de/search?page=' || id // 20 AS page, (1000000 + id)::VARCHAR AS listing_id, (row_number() OVER (PARTITION BY id // 20 ORDER BY id))::INT AS position, CASE WHEN id % 5 <> 0 THEN price::DOUBLE END AS price, CASE WHEN id % 3 <> 0 AND id % 13 <> 0 THEN km::INT END AS km FROM a")
def item_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists alone, ten graphs deep; the advert that a page lists twice counts once."""
    rows = pg.item_list_rows(_result_pages(_adverts(spark, sf_dir)), as_of())
    return rows.select("page", F.col("source_id").alias("listing_id"), F.col("position").cast("int").alias("position"), "price", "km")


@query(_ADVERTS + """ SELECT 'https://a.de/search?page=' || id // 20 AS page, (1000000 + id)::VARCHAR AS key, power || ' Ch' AS power_text, CASE id % 7 WHEN 0 THEN price + 500 WHEN 1 THEN price - 500 END || ' €' AS before_text FROM a
UNION ALL SELECT 'https://a.de/search?page=' || id // 20, 'gallery-' || (1000000 + id), NULL, NULL FROM a""")
def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What named elements hold: a card its whole inside, a gallery in it nothing."""
    rows = pg.card_texts(_result_pages(_adverts(spark, sf_dir)))
    return rows.select("page", F.array_join("keys", " ").alias("key"), F.nullif("power_text", F.lit("")).alias("power_text"), "before_text")


@query(_ADVERTS + """ SELECT id, km || ' km' AS km, year || ' in spring' AS year, price::VARCHAR AS price, 'a & b ' || id AS name, 'in' AS inner_item, CASE WHEN id % 2 = 0 THEN 'even' END AS follows, 'Km' AS first_item, CASE WHEN id % 3 = 0 THEN 'last' END AS third FROM a""")
def css_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors with combinators, places among children, attributes and lists, over a page for each order."""
    a = _adverts(spark, sf_dir)
    body = '<html><body><p>one<p class="y">two<ul class="specs big"><li>Km<li><b>⟨km⟩ km</b><li class="y">⟨year⟩<ul><li>in</ul>spring</ul><div class="x">no</div><section lang="fr-FR"><div class="x" data-price=" ⟨price⟩ ">a &amp; b<span> ⟨id⟩</span><!-- <i>c</i> --><script>"<div class=x>"</script></div>⟨even⟩<ol><li>1<li>2⟨third⟩</ol></section></body></html>'
    html = _say(body, id=F.col("id"), km=F.col("km"), year=F.col("year"), price=F.col("price"), even=F.when(F.col("id") % 2 == 0, F.lit("<em>even</em>")), third=F.when(F.col("id") % 3 == 0, F.lit("<li>last")))
    rules = {
        "km": "ul.specs > li:nth-child(2)", "year": "body > .specs .y", "price": {"selector": "section > .x", "attr": "data-price"}, "name": '[lang|="fr"] .x', "inner_item": "li.y li, .none", "follows": "div.x[data-price] + em",
        "first_item": "li:not(.y):first-child", "third": "ol > li ~ li:nth-child(2n+3)",
    }
    return trees.css_fields(a.select("id", html.alias("html")), rules)


@query(_ADVERTS + " SELECT 'https://a.de/search?page=' || id // 20 AS page, count(*) AS rows, count(*) FILTER (id % 3 <> 0 AND id % 5 <> 0 AND id % 13 <> 0) AS complete, count(*) FILTER (id % 3 <> 0 AND id % 5 <> 0 AND id % 13 <> 0) >= greatest(1, floor(count(*) * 0.5)) AS usable FROM a GROUP BY 1")
def results_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which results pages do without their cards."""
    return pg.usable(pg.item_list_rows(_result_pages(_adverts(spark, sf_dir)), as_of()))


def _detail_pages(a: DataFrame) -> DataFrame:
    """Five kinds in turn: two vehicles in a graph, microdata, OpenGraph, nothing, JSON-LD whose price, km and year stand in tags."""
    i, value = F.col("id"), {"id": F.col("id"), "n": 1000000 + F.col("id"), "km": F.col("km"), "price": F.col("price"), "year": F.col("year"), "month": F.lpad(F.col("month").cast("string"), 2, "0"), "dotted_km": _dotted(F.col("km")), "dotted": _dotted(F.col("price")), "hp": F.when(F.col("id") % 3 == 0, 9000).otherwise(F.col("power"))}
    script = lambda body: _say(f'<script type="application/ld+json">{body}</script>', **value)
    html = (
        F.when(i % 5 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type":"Car", broken</script>'), script('{"@graph":[{"@type":"WebPage","name":"x"},{"@type":"Car","name":"decoy","image":"d.jpg","brand":"Decoy"},{"@type":"Car","name":"Golf ⟨id⟩","brand":{"@type":"Brand","name":"Volkswagen"},"fuelType":"Petrol","vehicleTransmission":["Manual"],"numberOfDoors":5,"seatingCapacity":{"value":"4"},"vehicleModelDate":"⟨year⟩","dateVehicleFirstRegistered":"⟨year⟩-⟨month⟩-15","vehicleEngine":{"enginePower":{"value":⟨hp⟩}},"mileageFromOdometer":"⟨dotted_km⟩","image":["/1.jpg",{"url":"2.jpg"},"/1.jpg"],"offers":[{"price":"⟨dotted⟩","seller":{"@type":"http://schema.org/Person","name":null,"value":"nobody"}}]}],}')))
        .when(i % 5 == 1, _say('<div itemscope><h1 itemprop="name">Focus ⟨id⟩</h1><meta itemprop="price" content="⟨price⟩"></div><meta property="og:title" content="other">', **value))
        .when(i % 5 == 2, _say('<meta property="og:title" content="Polo ⟨id⟩"><meta property="product:price:amount" content="⟨price⟩"><meta property="og:image" content="//img.a.de/⟨id⟩.jpg">', **value))
        .when(i % 5 == 3, F.lit("<html><p>gone</p></html>"))
        .otherwise(F.concat(script('{"@type":"Car","name":"Clio ⟨id⟩","mileage":{"value":""}}'), _say('<p class="price-tag">none</p><div class="box"><p class="big price-tag" data-x="1"><b>⟨dotted⟩</b> €</p><b id="km">⟨km⟩ km</b><ul><li>x<li>since ⟨month⟩/⟨year⟩</ul></div>', **value)))
    )
    return a.select(F.concat(F.lit("https://a.de/auto/"), 1000000 + i, F.lit(".html")).alias("url"), html.alias("html"))


@query(_ADVERTS + """ SELECT 'https://a.de/auto/' || (1000000 + id) || '.html' AS page, CASE id % 5 WHEN 0 THEN 'Golf ' || id || ' essence Manual' WHEN 1 THEN 'Focus ' || id WHEN 2 THEN 'Polo ' || id ELSE 'Clio ' || id END AS title, CASE WHEN id % 5 = 0 THEN 'Volkswagen' END AS make, price::DOUBLE AS price, CASE WHEN id % 5 IN (0, 4) THEN km::INT END AS km,
CASE WHEN id % 5 IN (0, 4) THEN year::INT END AS year, CASE WHEN id % 5 = 0 AND id % 3 <> 0 THEN power::INT END AS power_hp, CASE WHEN id % 5 = 0 THEN 5 END AS doors, CASE WHEN id % 5 = 0 THEN 4 END AS seats, CASE id % 5 WHEN 0 THEN make_date(year, month, 15) WHEN 4 THEN make_date(year, month, 1) END AS first_registration,
CASE id % 5 WHEN 0 THEN 'https://a.de/1.jpg https://a.de/auto/2.jpg' WHEN 2 THEN 'https://img.a.de/' || id || '.jpg' ELSE '' END AS images FROM a WHERE id % 5 <> 3""")
def detail_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of a detail page: JSON-LD, microdata, OpenGraph, then selectors."""
    selectors = {"price": "div > .price-tag", "km": {"selector": "#km"}, "year": ".box li:nth-child(2)", "registration": ".box ul > li + li"}
    rows = pg.detail_page(_detail_pages(_adverts(spark, sf_dir)), as_of(), selectors)
    return rows.select("page", "title", "make", "price", "km", "year", "power_hp", "doors", "seats", "first_registration", F.array_join("images", " ").alias("images"))


@query(_ADVERTS + " SELECT 'https://a.de/auto/' || (1000000 + id) || '.html' AS page, CASE WHEN id % 5 = 0 THEN 'Volkswagen' END AS make, CASE WHEN id % 5 = 0 THEN price::DOUBLE END AS price, CASE WHEN id % 5 = 0 THEN km::INT END AS km, CASE WHEN id % 5 = 0 AND id % 3 <> 0 THEN power::INT END AS power_hp, CASE WHEN id % 5 = 0 THEN 'private' ELSE 'unknown' END AS seller_type, NULL::VARCHAR AS seller_name, CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END AS images FROM a WHERE id % 5 IN (0, 4)")
def jsonld_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vehicle node of each page that has one; a seller whose name is there and null has none."""
    df = pg.vehicles(_detail_pages(_adverts(spark, sf_dir)), as_of())
    return df.select("page", "make", "price", "km", "power_hp", "seller_type", "seller_name", F.size("images").alias("images"))


@query(_ADVERTS + """, b AS (SELECT *, 'https://a.de/auto/' || (1000000 + id) || '.html' AS url FROM a) SELECT url, 'og:title' AS property, CASE id % 5 WHEN 1 THEN 'other' ELSE 'Polo ' || id END AS content FROM b WHERE id % 5 IN (1, 2)
UNION ALL SELECT url, 'product:price:amount', price::VARCHAR FROM b WHERE id % 5 = 2 UNION ALL SELECT url, 'og:image', '//img.a.de/' || id || '.jpg' FROM b WHERE id % 5 = 2""")
def opengraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.open_graph(_detail_pages(_adverts(spark, sf_dir)))


@query(_ADVERTS + ", b AS (SELECT *, 'https://a.de/auto/' || (1000000 + id) || '.html' AS url FROM a WHERE id % 5 = 1) SELECT url, 'name' AS property, 'Focus ' || id AS content FROM b UNION ALL SELECT url, 'price', price::VARCHAR FROM b")
def microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.microdata(_detail_pages(_adverts(spark, sf_dir)))


@query("""WITH a AS (SELECT o_orderkey AS id FROM orders), b AS (SELECT id, id % 11 = 0 AS failed, id % 7 <> 0 AS allowed, CASE WHEN id % 5 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN id % 3 = 0 THEN id % 4 ELSE 0 END AS complete, id % 6 AS links, id % 2 = 0 AS js, id % 4 AS samples, least(id % 4, id % 13) AS usable FROM a)
SELECT id, CASE WHEN failed THEN 'echec' WHEN NOT allowed THEN 'interdit' WHEN status >= 400 THEN 'echec' WHEN complete > 0 THEN 'liste' WHEN links = 0 THEN CASE WHEN js THEN 'js' ELSE 'motif' END WHEN samples = 0 THEN 'partiel' WHEN usable = 0 THEN 'extraction' WHEN usable < samples THEN 'partiel' ELSE 'ok' END AS level FROM b""")
def source_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of sources over every mix of causes."""
    i = F.col("o_orderkey")
    level = profile.verdict(F.when(i % 11 == 0, F.lit("timeout")), i % 7 != 0, F.when(i % 5 == 0, 404).otherwise(200), F.when(i % 3 == 0, i % 4).otherwise(0), i % 6, i % 2 == 0, i % 4, F.least(i % 4, i % 13))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(i.alias("id"), level.alias("level"))


def _sightings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as sightings of adverts: the first half is stored, the second a batch in which adverts repeat."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    half = o.agg(F.expr("max(o_orderkey) div 2").alias("half"))
    o = o.select((F.col("o_orderkey") % 700).alias("source_id"), F.col("o_orderkey").cast("long").alias("turn"), F.timestamp_seconds(F.col("o_orderkey")).alias("last_seen"), (1000 + (F.col("o_orderkey") * 13) % 3).cast("double").alias("price_eur"), F.when(F.col("o_orderkey") % 9 != 0, F.lit("car")).alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(2000.0)).otherwise(F.lit(10.0)).alias("previous_price")).crossJoin(F.broadcast(half))
    stored = state.latest(state.admissible(o.where("turn <= half and source_id < 500")).drop("half"), ("source_id",), ("turn",))
    return stored.drop("turn", "previous_price"), o.where("turn > half").drop("half")


_SIGHTINGS = """WITH h AS (SELECT max(o_orderkey) // 2 AS half FROM orders), o AS (SELECT o_orderkey % 700 AS source_id, o_orderkey AS turn, (1000 + (o_orderkey * 13) % 3)::DOUBLE AS price_eur, o_orderkey % 2 = 0 AS cut, o_orderkey > half AS late FROM orders, h WHERE o_orderkey % 9 <> 0 AND (o_orderkey > half OR o_orderkey % 700 < 500)),
s AS (SELECT source_id, max(turn) AS turn FROM o WHERE NOT late GROUP BY source_id), r AS (SELECT * FROM o WHERE late UNION ALL SELECT o.* FROM o JOIN s USING (source_id, turn)),
w AS (SELECT *, lag(price_eur) OVER (PARTITION BY source_id ORDER BY turn) AS previous, row_number() OVER (PARTITION BY source_id ORDER BY turn) = 1 AS first FROM r),
m AS (SELECT *, late AND (first OR abs(price_eur - previous) > 1) AS moved FROM w) """


_KEYS = ("source_id",)


@query(_SIGHTINGS + """, f AS (SELECT source_id, min(turn) AS turn FROM o WHERE NOT late GROUP BY source_id) SELECT source_id, arg_max(price_eur, m.turn) AS price_eur, epoch_ms(max(m.turn) FILTER (moved) * 1000)::TIMESTAMP AS price_changed_at, bool_or(moved) AS touched,
epoch_ms(coalesce(any_value(f.turn), min(m.turn) FILTER (late)) * 1000)::TIMESTAMP AS first_seen, CASE WHEN any_value(f.turn) IS NOT NULL THEN source_id % 100 END AS score FROM m LEFT JOIN f USING (source_id) GROUP BY source_id""")
def ingest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after a batch, with the adverts whose price it moved; what only the store has stays."""
    stored, batch = _sightings(spark, sf_dir)
    stored = stored.join(_first_seen(spark, sf_dir), "source_id").withColumn("score", (F.col("source_id") % 100).cast("long"))
    rows = state.ingest(stored, batch, _KEYS, "last_seen", "turn")
    plain = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("price_changed_at", "first_seen")]
    return rows.select("source_id", "price_eur", *plain, "touched", "score")


def _first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When adverts of the first half were seen first."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    half = o.agg(F.expr("max(o_orderkey) div 2").alias("half"))
    early = o.crossJoin(F.broadcast(half)).where("o_orderkey <= half and o_orderkey % 700 < 500 and o_orderkey % 9 <> 0")  # one row
    return early.groupBy((F.col("o_orderkey") % 700).alias("source_id")).agg(F.timestamp_seconds(F.min("o_orderkey")).alias("first_seen"))


@query("""WITH p AS (SELECT max(o_orderkey) // 4 + 1 AS part FROM orders), o AS (SELECT o_orderkey % 700 AS source_id, o_orderkey AS turn, o_orderkey // part AS batch, (1000 + (o_orderkey * 13) % 3)::DOUBLE AS price_eur FROM orders, p WHERE o_orderkey % 9 <> 0),
w AS (SELECT *, lag(price_eur) OVER (PARTITION BY source_id ORDER BY turn) AS previous FROM o), m AS (SELECT *, previous IS NULL OR abs(price_eur - previous) > 1 AS moved FROM w)
SELECT source_id, arg_max(price_eur, turn) AS price_eur, min(turn) AS first_turn, max(turn) AS last_turn, max(turn) FILTER (moved) AS moved_turn, bool_or(moved AND batch = 3) AS touched, CASE WHEN min(turn) FILTER (batch <= 1) IS NOT NULL THEN source_id % 100 END AS score,
CASE WHEN min(turn) FILTER (batch <= 1) IS NOT NULL AND source_id % 100 >= 90 THEN 1 END AS alerted FROM m GROUP BY source_id""")
def ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table behind four batches, of which two come again, with a scoring run and its alerts in between."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("turn"))
    part = o.agg(F.expr("max(turn) div 4 + 1").alias("part")).first()["part"]
    rows = o.select(
        (F.col("turn") % 700).alias("source_id"), "turn", F.timestamp_seconds("turn").alias("last_seen"), (1000 + (F.col("turn") * 13) % 3).cast("double").alias("price_eur"),
        F.when(F.col("turn") % 9 != 0, F.lit("car")).alias("title"), F.floor(F.col("turn") / part).alias("batch"),
    )
    store = Store(spark, shared_folder(spark, "listings"), _KEYS, "source_id long, last_seen timestamp, price_eur double, title string", buckets=8)
    take = lambda old, batch: state.ingest(old, batch, _KEYS, "last_seen", "turn")
    put = lambda n: store.apply("sightings", n, rows.where(F.col("batch") == n).drop("batch"), take)
    put(0)
    put(1)
    scores = store.read().select("source_id", (F.col("source_id") % 100).alias("score"), F.when(F.col("source_id") % 100 >= 90, 1).alias("alerted"))
    store.apply("scores", 0, scores, lambda old, new: old.join(new, "source_id", "left"))
    put(1)
    put(2)
    put(3)
    put(3)
    put(0)
    second = lambda c: F.unix_seconds(c)
    return store.read().select("source_id", "price_eur", second("first_seen").alias("first_turn"), second("last_seen").alias("last_turn"), second("price_changed_at").alias("moved_turn"), "touched", "score", "alerted")


@query(_SIGHTINGS + "SELECT source_id, turn, previous, price_eur FROM m WHERE late AND NOT first AND price_eur < previous - 1")
def price_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price cuts of a batch, one by one."""
    stored, batch = _sightings(spark, sf_dir)
    return state.price_cuts(stored, batch, _KEYS, "last_seen", "turn")


@query(_SIGHTINGS + "SELECT source_id, 2000.0::DOUBLE AS price_eur, epoch_ms((turn - 1) * 1000)::TIMESTAMP AS seen_at FROM m WHERE late AND first AND cut")
def price_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First price points of new adverts that show the price they had before."""
    stored, batch = _sightings(spark, sf_dir)
    seeds = state.seeded(state.applied(stored, batch, _KEYS, "last_seen", "turn"), _KEYS, "last_seen")
    return seeds.select("source_id", "price_eur", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"))


@query("WITH a AS (SELECT o_orderkey AS id, (o_orderkey * 31) % 101 AS score, ['a', 'b', 'c'][o_orderkey % 3 + 1] AS source FROM orders WHERE o_orderkey % 4 <> 0) SELECT id, score, source FROM a WHERE source <> 'c' ORDER BY score DESC, id LIMIT 20")
def detail_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty adverts of a shortlist to open again."""
    i = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(i.alias("id"), ((i * 31) % 101).alias("score"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (i % 3 + 1).cast("int")).alias("source"), F.when(i % 4 == 0, F.lit("said")).when(i % 4 == 1, F.lit("")).alias("description"))
    return deals.to_reopen(rows, ("a", "b"), 20).select("id", "score", "source")


@query("""SELECT o_orderkey AS id, 'told' AS description, CASE WHEN o_orderkey % 3 = 0 THEN 'petrol' ELSE 'diesel' END AS fuel, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE 'y' END AS postcode, greatest(o_orderkey % 3, o_orderkey % 5)::INT AS n_photos, CASE WHEN o_orderkey % 2 = 0 THEN 'abs,gps' ELSE 'abs' END AS options, CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'a' END AS extra FROM orders WHERE o_orderkey % 7 <> 0""")
def detail_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results rows completed from the adverts' own pages; an advert without a description stays out."""
    i, s = F.col("o_orderkey"), F.lit
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    photos = lambda n: F.array_repeat(s("p"), n.cast("int"))
    listed = o.select(i.alias("id"), s(None).cast("string").alias("description"), s("petrol").alias("fuel"), s("x").alias("postcode"), photos(i % 3).alias("photos"), F.array(s("abs")).alias("options"), F.create_map(s("k"), s("a"), s("only"), s("z")).alias("extra"))
    opened = o.select(i.alias("id"), F.when(i % 7 != 0, s("told")).alias("description"), F.when(i % 3 == 0, s("unknown")).otherwise("diesel").alias("fuel"), F.when(i % 4 != 0, s("y")).alias("postcode"), photos(i % 5).alias("photos"), F.when(i % 2 == 0, F.array(s("gps"))).alias("options"), F.when(i % 2 == 0, F.create_map(s("k"), s("b"))).alias("extra"))
    rows = deals.completed(listed, opened, "id").where("extra['only'] = 'z'")
    return rows.select("id", "description", "fuel", "postcode", F.size("photos").alias("n_photos"), F.array_join("options", ",").alias("options"), F.col("extra")["k"].alias("extra"))
