"""Queries of parsers and classifiers. Inputs are wordings whose meaning is known, so an oracle states that meaning; some
are built from the fixture listings, row by row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.functions import classify as cl
from motorlens.functions import text as tx
from motorlens.functions import urls as ul
from motorlens.schemas import DEFAULT_PRICE, USD_TO_EUR
from motorlens.sources.fixtures import DUCK, as_of, listings, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Numbers that an order's key gives a wording, in Spark and in DuckDB.
_NUMBERS = {"id": "{k}", "n": "1000 + {k} % 9000", "t": "{k} % 10", "y": "1990 + {k} % 35", "m": "1 + {k} % 12", "d": "1 + {k} % 28", "p": "60 + {k} % 140"}


def composed(template: str | None, values: dict[str, Column]) -> Column:
    """template with each ⟨name⟩ replaced; ⟨0name⟩ has two digits."""
    if template is None:
        return F.lit(None).cast("string")
    parts = []
    for piece in re.split("(⟨[^⟩]*⟩)", template):
        name = piece[1:-1].lstrip("0") if piece.startswith("⟨") else None
        parts.append(F.lit(piece) if name is None else F.lpad(values[name].cast("string"), 2, "0") if piece[1] == "0" else values[name].cast("string"))
    return F.concat(*parts)


def cases(name: str, kind: str, function, rows: list[tuple], fields: int = 1) -> None:
    """Register function over all orders: each takes one of rows (wordings..., what they mean) by its key, with numbers of
    its own in it. A meaning is SQL over those numbers, or None."""
    cast = {"int": "INT", "double": "DOUBLE", "date": "DATE"}.get(kind, "VARCHAR")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.col("o_orderkey").cast("long")
        df = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k")))
        values = {n: F.expr(e.format(k="k")) for n, e in _NUMBERS.items()}
        turn = F.pmod("k", F.lit(len(rows)))
        worded = [F.coalesce(*[F.when(turn == i, composed(r[j], values)) for i, r in enumerate(rows)]).alias(f"a{j}") for j in range(fields)]
        value: Column = function(*[F.col(f"a{j}") for j in range(fields)])
        if kind.endswith("[]"):
            value = F.array_join(value, ",")
        return df.select("k", *worded).select("k", value.alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    numbers = ", ".join(f"{e.format(k='o_orderkey')} AS {n}" for n, e in _NUMBERS.items())
    means = " ".join(f"WHEN {i} THEN ({r[fields] or 'NULL'})::{cast}" for i, r in enumerate(rows))
    ORACLES[name] = f"WITH o AS (SELECT o_orderkey::BIGINT AS k, {numbers} FROM orders) SELECT k, CASE k % {len(rows)} {means} END AS value FROM o"


def words(*rows: tuple) -> list[tuple]:
    """Rows whose meaning is a text (or a list of texts, or None) itself."""
    quoted = lambda v: None if v is None else "'" + (",".join(v) if isinstance(v, list) else v).replace("'", "''") + "'"
    return [(*r[:-1], quoted(r[-1])) for r in rows]


def row_query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


cases("parse_decimal", "double", tx.parse_decimal, [("⟨t⟩,6 l", "t + 0.6::DOUBLE"), ("1.⟨n⟩,5", "10000 + n + 0.5::DOUBLE"), ("⟨p⟩.123,56", "(p * 1000 + 123)::DOUBLE + 0.56::DOUBLE"), ("⟨p⟩,234.5", "p * 1000 + 234.5::DOUBLE"), ("⟨t⟩.25", "t + 0.25::DOUBLE"), ("abc", None), (None, None), ("1,2,⟨t⟩", None), ("no ⟨id⟩", "id")])
cases("parse_registration", "date", lambda t: tx.parse_registration(t, as_of()), [("⟨y⟩-⟨0m⟩-⟨0d⟩", "make_date(y, m, d)"), ("mise en circulation ⟨y⟩-⟨0m⟩", "make_date(y, m, 1)"), ("⟨0m⟩/⟨y⟩", "make_date(y, m, 1)"), ("⟨m⟩.⟨y⟩", "make_date(y, m, 1)"), ("mars ⟨y⟩", "make_date(y, 3, 1)"), ("Okt. ⟨y⟩", "make_date(y, 10, 1)"), ("février ⟨y⟩", "make_date(y, 2, 1)"), ("annee ⟨y⟩", "make_date(y, 6, 1)"), ("⟨y⟩-13-02", None), ("⟨y⟩-03-31", "make_date(y, 3, 28)"), ("rien ⟨t⟩", None), (None, None)])
cases("to_eur", "double", lambda a, c: tx.to_eur(a.cast("double"), c), [("⟨n⟩", "GBP", "round(n * 1.17::DOUBLE, 2)"), ("⟨n⟩", "gbp", "round(n * 1.17::DOUBLE, 2)"), ("⟨n⟩00", "HUF", "n * 0.25::DOUBLE"), ("⟨n⟩", None, "n"), ("⟨n⟩.5", "", "n + 0.5"), ("⟨n⟩", "USD", None), (None, "EUR", None), ("⟨n⟩0", "SEK", "round(n * 0.89::DOUBLE, 2)")], 2)
cases("clean_text", "string", tx.clean_text, [("  a \t b⟨id⟩ ", "'a b' || id"), ("a\u00a0⟨id⟩\u202fb", "'a ' || id || ' b'"), ("a\n\n\n\n⟨id⟩", "'a' || chr(10) || chr(10) || id"), ("   ", None), (None, None), ("⟨id⟩\n\nb", "id || chr(10) || chr(10) || 'b'")])
cases("clean_text_full", "string", lambda t: tx.clean_text(t, full=True), [("Ｇｏｌｆ  ⟨id⟩", "'Golf ' || id"), ("ﬁn ⟨id⟩ ②", "'fin ' || id || ' 2'"), (" \u3000 ", None), (None, None)])
cases("country_code", "string", tx.country, words(("fr", "FR"), (None, "FR"), ("", "FR"), ("deu", "DE"), ("it⟨id⟩", "IT")))
cases("make", "string", cl.canonical_make, words(("vw", "Volkswagen"), ("VOLKSWAGEN", "Volkswagen"), ("Mercedes", "Mercedes-Benz"), ("Citroën", "Citroen"), ("alfa romeo", "Alfa Romeo"), ("land rover", "Land Rover"), ("lada", "Lada"), ("aston martin", "Aston Martin"), ("", None), (None, None)))
cases("make_in_text", "string", cl.detect_make, words(("Vends VW Golf ⟨t⟩", "Volkswagen"), ("Alfa Romeo Giulia ⟨y⟩", "Alfa Romeo"), ("⟨y⟩ Range Rover Evoque", "Land Rover"), ("belle voiture ⟨n⟩", None), (None, None), ("BMW 3⟨t⟩0d Touring", "BMW"), ("⟨n⟩ euros, bmwx", None)))
cases("model", "string", cl.canonical_model, words(("BMW", "BMW 320d Touring ⟨y⟩", "Serie 3"), ("BMW", "BMW 3er Limousine", "Serie 3"), ("Mercedes-Benz", "Mercedes C 220 CDI ⟨y⟩", "Classe C"), ("Volkswagen", "VW Golf ⟨t⟩ TDI", "Golf"), ("Volkswagen", "VW T-Roc", "T-Roc"), ("Peugeot", "Peugeot 308 SW ⟨y⟩", "308"), ("Tesla", "Tesla Model 3 Long Range", "Model 3"), ("Fiat", "Fiat Panda 1.2", "Panda"), ("Fiat", "vends Fiat 500 occasion", "500"), ("Fiat", None, None)), 2)
cases("fuel", "string", cl.detect_fuel, words(("Golf 1.⟨t⟩ TDI", "hayon electrique", "diesel"), ("Clio TCe ⟨p⟩", None, "petrol"), ("BMW 330e", "annee ⟨y⟩", "phev"), ("BMW 320 d", None, "diesel"), ("Golf hybrid", "plug-in, garantie", "phev"), ("Zoe 40 kWh ⟨y⟩", None, "electric"), ("hayon electrique", "rien", "unknown"), ("moteur electrique", None, "electric"), ("Yaris hybride ⟨y⟩", "essence", "hybrid"), ("gpl bon etat", "⟨n⟩ km", "lpg"), ("E85", None, "ethanol"), (None, None, "unknown")), 2)
cases("gearbox", "string", cl.detect_gearbox, words(("boite auto DSG ⟨t⟩", "automatic"), ("BVM 6, ⟨n⟩ km", "manual"), ("Schaltgetriebe ⟨y⟩", "manual"), ("autoroute ⟨n⟩", "unknown"), ("e-CVT", "automatic"), (None, "unknown")))
cases("body", "string", cl.detect_body, words(("Golf break ⟨y⟩", "estate"), ("308 SW ⟨p⟩", "estate"), ("cabriolet ⟨y⟩", "cabrio"), ("coupé sport ⟨t⟩", "coupe"), ("VW suv ⟨n⟩", "suv"), ("volkswagen ⟨id⟩", "unknown"), ("berline 5 portes", "sedan"), (None, "unknown")))
cases("options", "string[]", cl.detect_options, words(("GPS, cuir, toit ouvrant, ⟨n⟩ km", ["cuir", "gps", "toit_ouvrant"]), ("Sitzheizung und Navi ⟨y⟩", ["gps", "sieges_chauffants"]), ("rien ⟨t⟩", []), ("S line ⟨y⟩, Apple CarPlay", ["carplay", "pack_sport"])))
cases("seller_type", "string", cl.detect_seller, words(("Garage du Centre ⟨t⟩", None, "pro"), ("Jean", "vente particulier ⟨y⟩", "private"), ("Autohaus GmbH", None, "pro"), ("Jean", "von privat", "private"), ("Jean", "belle ⟨n⟩", "unknown"), ("x", "clim auto", "pro"), (None, None, "unknown")), 2)
cases("listing_id_literals", "string", ul.listing_id, [("https://a.de/x/3f2504e0-4f89-11d3-9a0c-0305e82c3301", "'3f2504e0-4f89-11d3-9a0c-0305e82c3301'"), ("https://a.de/d?id=⟨n⟩&x=1", "n"), ("https://a.de/cat_ma73mo2079-12⟨n⟩", "'12' || n"), ("https://a.de/golf-9876⟨n⟩.htm", "'9876' || n"), ("https://a.de/golf-⟨n⟩", "'golf-' || n")])
cases("canonical_url_literals", "string", ul.canonical, [("https://a.de/x?utm_source=f&id=⟨n⟩#top", "'https://a.de/x?id=' || n"), ("https://a.de/⟨n⟩?ref=1", "'https://a.de/' || n"), ("https://a.de/x?k=&m=⟨t⟩", "'https://a.de/x?m=' || t"), ("https://a.de/⟨id⟩", "'https://a.de/' || id")])
cases("source_for_url", "string", lambda u: ul.source_for(u, ("autoscout24", "mobile-de", "leboncoin")), words(("https://www.autoscout24.fr/⟨n⟩", "autoscout24"), ("https://m.leboncoin.fr/⟨id⟩", "leboncoin"), ("https://example.org/⟨n⟩", None)))
cases("search_url", "string", lambda m: ul.search_url("https://a.de/{make}/?model=&make={make}&page=2", make=m), [("Alfa Romeo ⟨t⟩", "'https://a.de/alfa-romeo-' || t || '/?make=alfa-romeo-' || t || '&page=2'"), (None, "'https://a.de/?page=2'")])
cases("media_sniff", "string", lambda h: ul.media_type(F.unhex(h)), words(("FFD8FFE0⟨n⟩", "image/jpeg"), ("89504E470D0A1A0A⟨n⟩", "image/png"), ("474946383961⟨n⟩", "image/gif"), ("52494646⟨n⟩000057454250⟨n⟩", "image/webp"), ("3C68746D6C⟨n⟩", None), ("", None)))
cases("power_in_text", "int", cl.power_in, [("⟨p⟩ ch", "p"), ("moteur de ⟨p⟩ kW", "round_even(p * 1.35962::DOUBLE, 0)"), ("TDI ⟨p⟩", "p"), ("24.2 kwh ⟨t⟩", None), ("BlueHDi ⟨p⟩ S", "p"), ("5 ch", None)])
cases("km_in_text", "int", cl.km_in, [("Golf ⟨p⟩.500 km", "p * 1000 + 500"), ("⟨p⟩,250 miles", "round_even((p * 1000 + 250) * 1.60934::DOUBLE, 0)"), ("neuf ⟨t⟩", None)])


@row_query(DUCK + " SELECT id, price_eur FROM listings WHERE price_eur IS NOT NULL")
def parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir).where("price_eur is not null")
    n = F.col("price_eur").cast("int")
    high, low = F.floor(n / 1000).cast("string"), F.lpad((n % 1000).cast("string"), 3, "0")
    text = F.element_at(F.array(F.concat(F.lit("Prix: "), n), F.concat(high, F.lit("."), low, F.lit(" €")), F.concat(high, F.lit(" "), low, F.lit(" EUR")), F.concat(F.lit("£"), high, F.lit(","), low), F.concat(F.lit("€ "), high, F.lit("."), low, F.lit(",00"))), (F.col("id") % 5 + 1).cast("int"))
    return df.select("id", tx.parse_price(text).alias("price_eur"))


@row_query(DUCK + " SELECT id, CASE id % 3 WHEN 1 THEN round_even(km * 1.60934::DOUBLE, 0)::INT WHEN 2 THEN km // 1000 * 1000 ELSE km END AS km FROM listings")
def parse_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = F.floor(F.col("km") / 1000).cast("string"), F.lpad((F.col("km") % 1000).cast("string"), 3, "0")
    text = F.when(F.col("id") % 3 == 1, F.concat(high, F.lit(","), low, F.lit(" miles"))).when(F.col("id") % 3 == 2, F.concat(high, F.lit(" tkm"))).otherwise(F.concat(high, F.lit("."), low, F.lit(" km")))
    return listings(spark, sf_dir).select("id", tx.parse_km(text).alias("km"))


@row_query(DUCK + " SELECT id, CASE WHEN id % 2 = 0 THEN power_hp ELSE round_even(power_hp * 1.35962::DOUBLE, 0)::INT END AS power_hp FROM listings")
def parse_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", tx.parse_power_hp(F.concat(F.col("power_hp"), F.when(F.col("id") % 2 == 0, " ch").otherwise(" kW"))).alias("power_hp"))


@row_query(DUCK + " SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE year END AS year FROM listings")
def parse_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("modele "), F.when(F.col("id") % 11 == 0, F.lit(2041)).otherwise(F.col("year")), F.lit(", 5 portes"))
    return listings(spark, sf_dir).select("id", tx.parse_year(text, as_of()).alias("year"))


@row_query("SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of whole texts."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@row_query(DUCK + " SELECT id, fingerprint FROM listings")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", "fingerprint")


@row_query(DUCK + " SELECT id, greatest(0, 2026 - year + 0.5::DOUBLE) AS age_years, round(CASE WHEN 2026 - year + 0.5 >= 0.5 THEN km / (2026 - year + 0.5::DOUBLE) END, 4) AS km_per_year FROM listings")
def age_km_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = tx.age_years(F.col("year"), as_of())
    return listings(spark, sf_dir).select("id", age.alias("age_years"), F.round(tx.km_per_year(F.col("km"), age), 4).alias("km_per_year"))


_BODIES = {"sedan": "berline", "suv": "suv", "hatch": "compacte", "city": "citadine", "estate": "break"}


@row_query(DUCK + """ SELECT id, make, regexp_replace(regexp_replace(model, ' v[0-9]+$', ''), '^Serie 3$', 'Serie') AS model, year, km, power_hp, CASE WHEN make = 'Tesla' OR model LIKE 'Zoe%' THEN 'electric' ELSE fuel END AS fuel, gearbox, body,
array_to_string(list_filter([CASE WHEN id % 3 = 0 THEN 'cuir' END, CASE WHEN id % 2 = 0 THEN 'gps' END, CASE WHEN id % 5 = 0 THEN 'toit_ouvrant' END], lambda x: x IS NOT NULL), ',') AS options, CASE id % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'private' ELSE 'unknown' END AS seller_type FROM listings""")
def enrich_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is read back out of a title and a wording that tell it."""
    said = lambda c, table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(c))
    fuel = said("fuel", {"diesel": "gazole", "petrol": "essence", "hybrid": "hybride", "electric": "100% electric"})
    box, i = said("gearbox", {"manual": "boite manuelle", "automatic": "automatik"}), F.col("id")
    raw = listings(spark, sf_dir).select(
        "id", F.concat_ws(" ", "make", F.regexp_replace("model", " v\\d+$", ""), fuel, F.lit("annee"), "year").alias("title"),
        F.concat_ws(", ", box, F.concat("power_hp", F.lit(" ch")), F.concat(F.lit("compteur: "), F.col("km"), F.lit(" km")), said("body", _BODIES), F.when(i % 2 == 0, "gps"), F.when(i % 3 == 0, "cuir"), F.when(i % 5 == 0, "toit ouvrant"), F.when(i % 3 == 1, "vente particulier")).alias("description"),
        F.when(i % 3 == 0, "Garage du Centre").alias("seller_name"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("version", "string"), ("make", "string"), ("model", "string"), ("fuel", "string"), ("gearbox", "string"), ("body", "string"), ("power_hp", "int"), ("km", "int"), ("year", "int"), ("first_registration", "date"), ("seller_type", "string"), ("options", "array<string>"), ("price_eur", "double"), ("price", "double"), ("currency", "string"))],
    )
    return cl.enrich(raw, as_of()).select("id", "make", "model", "year", "km", "power_hp", "fuel", "gearbox", "body", F.array_join("options", ",").alias("options"), "seller_type")


@row_query(f"SELECT o_orderkey AS id, round((o_totalprice * 100 * {DEFAULT_PRICE[0]} + o_custkey * {DEFAULT_PRICE[1]}) / 1e6 * {USD_TO_EUR}::DOUBLE, 4) AS eur FROM orders")
def model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of tokens at the default rates, of as many tokens as the orders have cents and customers."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.round(tx.token_cost(F.col("o_totalprice") * 100, F.col("o_custkey")), 4).alias("eur"))
