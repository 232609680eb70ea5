"""A synthetic market of which the true prices are known: any number of adverts, each from its number and a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.functions import text as tx
from motorlens.functions.classify import is_premium
from motorlens.sources.fixtures import CATALOG, COUNTRIES, SENTENCES

#: Shares of bargains and traps; the rest are fair.
BARGAIN, TRAP = 0.08, 0.07


def _u(seed: int, k: int) -> Column:
    """Uniform in [0, 1), from the row number."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _of(values: tuple, u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def residual_ratio(age: Column, km: Column, premium: Column, fuel: Column) -> Column:
    """What is left of the price when new, by age and km; never under 6 %."""
    rate = F.when(premium, F.lit(0.155)).otherwise(F.lit(0.125)) + F.when(fuel == "electric", F.lit(0.03)).otherwise(F.lit(0.0))
    wear = F.when(fuel == "diesel", F.lit(0.30)).otherwise(F.lit(0.38))
    return F.greatest(F.lit(0.06), F.pow(1 - rate, age) * F.pow(1 - wear, km / F.lit(150_000.0)))


def generate(spark: SparkSession, size: int, as_of: Column, seed: int = 42) -> DataFrame:
    """size adverts with kind (bargain, trap, fair) and true_price; the columns of the fixture listings."""
    df = spark.range(size).withColumn("_c", F.floor(_u(seed, 0) * len(CATALOG)).cast("int"))
    column = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in CATALOG]), F.col("_c") + 1)
    df = df.select("id", column(0).alias("make"), column(1).alias("model"), column(2).alias("_new"), column(3).alias("body"))
    df = df.withColumns({
        "source": F.lit("demo"), "is_synthetic": F.lit(True), "year": (F.year(as_of) - 1 - F.floor(_u(seed, 1) * 12)).cast("int"), "fuel": _of(("petrol", "diesel", "hybrid"), _u(seed, 2)),
        "gearbox": _of(("manual", "automatic"), _u(seed, 3)), "country": _of(COUNTRIES, _u(seed, 4)), "seller_type": _of(("private", "pro"), _u(seed, 5)), "power_hp": (70 + 10 * F.floor(_u(seed, 6) * 15)).cast("int"),
        "options_n": F.floor(_u(seed, 7) * 8).cast("int"), "photos_n": (1 + F.floor(_u(seed, 8) * 12)).cast("int"), "seen_days": F.floor(_u(seed, 9) * 60).cast("int"), "active": F.lit(True), "_kind": _u(seed, 10),
    })
    age = tx.age_years(F.col("year"), as_of)
    df = df.withColumn("km", F.floor(age * (8000 + 14000 * _u(seed, 11))).cast("int"))
    df = df.withColumns({
        "kind": F.when(F.col("_kind") < BARGAIN, "bargain").when(F.col("_kind") < BARGAIN + TRAP, "trap").otherwise("fair"),
        "true_price": F.round(F.col("_new") * residual_ratio(age, F.col("km"), is_premium(F.col("make")), F.col("fuel")), 0),
    })
    factor = F.when(F.col("kind") == "bargain", 0.74 + 0.10 * _u(seed, 12)).when(F.col("kind") == "trap", (0.60 + 0.10 * _u(seed, 13)) * (0.95 + 0.10 * _u(seed, 12))).otherwise(0.94 + 0.16 * _u(seed, 12))
    bad = tuple(s for s, codes in SENTENCES if {"moteur_hs", "accidente", "arnaque", "boite_hs"} & set(codes))
    good = tuple(s for s, codes in SENTENCES if not codes or {"carnet_entretien", "premiere_main", "garantie"} & set(codes))
    df = df.withColumns({"price_eur": F.round(F.col("true_price") * factor, 0), "description": F.when(F.col("kind") == "trap", _of(bad, _u(seed, 14))).otherwise(_of(good, _u(seed, 14))), "source_id": F.col("id").cast("string")})
    df = df.withColumn("fingerprint", tx.fingerprint(F.col("make"), F.col("model"), F.col("year"), F.col("km"), F.col("fuel"), F.col("power_hp")))
    return df.drop("_new", "_kind")
