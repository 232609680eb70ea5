"""Listings derived from the driver's tables, as one SQL text that Spark and DuckDB both run.

The tables hold no adverts, so every order becomes one, with a car, a seller, a price and a wording that follow from its
key by integer arithmetic. What each wording says is known (SENTENCES), which gives parity checks a truth of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.functions import text as tx

AS_OF = "2026-01-01"
SOURCES = ("demo", "sitea", "siteb", "sitec", "sited")
COUNTRIES = ("FR", "DE", "IT", "ES", "BE", "NL")
#: Make, model, price when new, body.
CATALOG = (
    ("BMW", "Serie 3", 52000, "sedan"), ("BMW", "X1", 48000, "suv"), ("Audi", "A4", 50000, "sedan"), ("Audi", "Q3", 46000, "suv"),
    ("Mercedes-Benz", "Classe C", 54000, "sedan"), ("Volkswagen", "Golf", 34000, "hatch"), ("Volkswagen", "Polo", 24000, "city"), ("Volkswagen", "Tiguan", 41000, "suv"),
    ("Renault", "Clio", 22000, "city"), ("Renault", "Megane", 29000, "hatch"), ("Renault", "Zoe", 33000, "city"), ("Peugeot", "208", 23000, "city"),
    ("Peugeot", "308", 31000, "hatch"), ("Peugeot", "3008", 38000, "suv"), ("Citroen", "C3", 21000, "city"), ("Ford", "Fiesta", 22000, "city"),
    ("Ford", "Focus", 29000, "hatch"), ("Toyota", "Yaris", 24000, "city"), ("Toyota", "Corolla", 31000, "hatch"), ("Tesla", "Model 3", 45000, "sedan"),
    ("Volvo", "V70", 47000, "estate"), ("Opel", "Corsa", 21000, "city"), ("Nissan", "Qashqai", 33000, "suv"), ("Mazda", "Cx-5", 37000, "suv"),
)
VARIANTS = 12
#: What a description says, and the codes of the signals in it, in the order in which they are reported.
SENTENCES = (
    ("", ()),
    ("Carnet d'entretien complet, premiere main.", ("carnet_entretien", "premiere_main")),
    ("Vendu en l'etat, moteur HS depuis mai.", ("vendu_en_letat", "moteur_hs")),
    ("Jamais accidente, vehicule non fumeur.", ("non_fumeur",)),
    ("Accidente a l'avant, carrosserie a refaire.", ("accidente",)),
    ("Courroie a changer, embrayage patine.", ("distribution_a_faire", "embrayage_a_faire")),
    ("Distribution faite, pneus neufs, CT OK.", ("distribution_faite", "ct_ok", "pneus_neufs")),
    ("Kilometrage non garanti, vente urgente.", ("km_non_garanti", "urgence")),
    ("Paiement par mandat cash, je suis a l'etranger.", ("arnaque",)),
    ("Voiture tres propre, visible le soir.", ()),
    ("Unfallwagen mit Motorschaden, nur fur Export.", ("pour_pieces", "moteur_hs", "accidente")),
    ("Nichtraucher, Scheckheft, TUV neu.", ("carnet_entretien", "ct_ok", "non_fumeur")),
    ("Kein Rost, keine Kratzer, mit Garantie.", ("garantie",)),
    ("Rouille sur les bas de caisse, clim HS.", ("rouille", "clim_hs")),
    ("Ancien taxi, vehicule import Allemagne.", ("ancien_taxi", "import")),
    ("Aucun voyant allume, revision faite.", ("revision_faite",)),
    ("Voyant moteur allume, turbo HS.", ("turbo", "voyant_moteur")),
    ("One owner, full service history, new tyres.", ("carnet_entretien", "premiere_main", "pneus_neufs")),
    ("Sold as seen, engine failure, no V5.", ("vendu_en_letat", "moteur_hs", "carte_grise_probleme")),
    ("Toit ouvrant, sieges chauffants, hayon electrique.", ()),
    ("Joint de culasse a revoir, consomme de l'huile.", ("consomme_huile", "joint_culasse")),
    ("4eme main, sans controle technique.", ("ct_ko", "plusieurs_proprios")),
    ("Importante remise possible, garantie 12 mois.", ("garantie",)),
    ("Vanne EGR et injecteurs HS, fumee bleue.", ("injecteurs", "fap_egr", "fumee")),
)


def _pick(values: tuple, number: str, spark: bool = False) -> str:
    """The value in place number, from 0. Spark: from an array, since its code for long CASEs is too large to be compiled."""
    quoted = [f"'{str(v).replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v) for v in values]
    if spark:
        return f"get(array({', '.join(quoted)}), CAST({number} AS INT))"
    return "CASE " + number + " " + " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(quoted)) + " END"


def listings_sql(spark: bool = True) -> str:
    """One row for each order. Spark: {orders} and {customer} are bound to DataFrames; DuckDB: they are views."""
    div = (lambda a, b: f"({a} div {b})") if spark else (lambda a, b: f"({a} // {b})")
    orders, customer = ("{orders}", "{customer}") if spark else ("orders", "customer")
    # Spark reads backslashes in literals; the sentences have none, but apostrophes are doubled for both.
    pick = lambda values, number: _pick(values, number, spark)
    c = lambda k: pick(tuple(x[k] for x in CATALOG), "(h % 24)")
    return f"""
SELECT x.*, CASE WHEN raw_price IS NULL THEN NULL ELSE CAST(raw_price AS DOUBLE) END AS price_eur
FROM (SELECT y.*,
    CASE WHEN id % 211 = 0 THEN NULL ELSE floor(base * power(0.875e0, 2026 - year + 0.5e0) * power(0.7e0, km / 150000e0)
        * (CASE kind WHEN 'bargain' THEN 0.79e0 WHEN 'trap' THEN 0.62e0 ELSE 1e0 END) * (0.94e0 + (id * 37 % 17) / 100e0) * (1e0 + least(options_n * 0.01e0, 0.09e0))
        * (CASE gearbox WHEN 'automatic' THEN 1.05e0 ELSE 1e0 END)) END AS raw_price
  FROM (SELECT id, h, source, CAST(id AS STRING) AS source_id, source = 'demo' AS is_synthetic, kind,
      {c(0)} AS make, {c(1)} || ' v' || CAST({div('h', 24)} % {VARIANTS} AS STRING) AS model, {c(2)} AS base, {c(3)} AS body,
      CAST(2012 + {div('h', 12)} % 14 AS INT) AS year, CAST(3000 + (h * 31) % 200000 AS INT) AS km, CAST(70 + (h % 17) * 10 AS INT) AS power_hp,
      {pick(("diesel", "petrol", "hybrid", "electric"), f"({div('h', 7)} % 4)")} AS fuel,
      {pick(("manual", "automatic"), f"({div('h', 5)} % 2)")} AS gearbox,
      {pick(COUNTRIES, "(c_nationkey % 6)")} AS country,
      CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'pro' WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'private' ELSE 'unknown' END AS seller_type,
      CAST(h % 12 AS INT) AS options_n, CAST(id % 14 AS INT) AS photos_n, CAST(id % 150 AS INT) AS seen_days, id % 13 <> 0 AS active,
      CAST(id % 40 AS INT) AS analyzed_hours, CAST({div('h', 3)} % {len(SENTENCES)} AS INT) AS sentence,
      {pick(tuple(s for s, _ in SENTENCES), f"({div('h', 3)} % {len(SENTENCES)})")} AS description
    FROM (SELECT id, vk, (vk * 7919) % 100003 AS h, c_nationkey, c_mktsegment, source,
          CASE WHEN (vk * 7919) % 100003 % 100 < 8 THEN 'bargain' WHEN (vk * 7919) % 100003 % 100 < 15 THEN 'trap' ELSE 'fair' END AS kind
        FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(CASE WHEN o_orderkey % 10 < 3 THEN o_orderkey - o_orderkey % 10 ELSE o_orderkey END AS BIGINT) AS vk,
              c_nationkey, c_mktsegment, {pick(SOURCES, "(o_orderkey % 5)")} AS source
            FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey) a) b) y) x"""


#: The same listings for DuckDB, without the fingerprint.
PLAIN_DUCK = listings_sql(False).replace("AS STRING)", "AS VARCHAR)")


def duck(inner: str) -> str:
    """listings for DuckDB from the SQL of their rows, with the fingerprint, to put before an oracle's own query."""
    return "WITH listings AS (SELECT *, substr(sha1(concat_ws('|', lower(make), lower(model), year::VARCHAR, km::VARCHAR, fuel, power_hp::VARCHAR)), 1, 24) AS fingerprint FROM (" + inner + ") l)"


DUCK = duck(PLAIN_DUCK)


#: Rows of a task at most, where work on each row is heavy.
TASK_ROWS = 20_000


def tasks_of(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """A table dealt to all cores, and to tasks of some TASK_ROWS rows, before work on its rows. Narrow keys become whole
    pages, so that splits by bytes are too few however large the table; one that has enough splits is as it is."""
    tasks = tasks_of(df)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    df = spark.sql(listings_sql(), orders=orders, customer=customer).drop("raw_price")
    return df.withColumn("fingerprint", tx.fingerprint(F.col("make"), F.col("model"), F.col("year"), F.col("km"), F.col("fuel"), F.col("power_hp")))


def as_of() -> "F.Column":
    return F.lit(AS_OF).cast("date")


def observations(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """listing_id, price_eur, seen_at, event_id from the events; coarse: most moves are under one euro."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    price = (1000 + F.floor("value") / 10) if coarse else F.round(1000 + 10 * F.col("value"), 2)
    return e.select(F.col("user_id").alias("listing_id"), price.alias("price_eur"), F.col("ts").alias("seen_at"), "event_id")


def observations_sql(coarse: bool = False) -> str:
    price = "1000 + floor(value) / 10" if coarse else "round(1000 + 10 * value, 2)"
    return f"WITH obs AS (SELECT user_id AS listing_id, {price} AS price_eur, ts AS seen_at, event_id FROM events)"
