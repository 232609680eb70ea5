import datetime

from pyspark.sql import functions as F

from motorlens.functions import classify, signals, text, urls, vocab
from motorlens.operators import deals, state
from motorlens.schemas import SearchQuery


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).head()[0]


def test_number_token_swallows_blanks(spark):
    assert one(spark, text.parse_price(F.col("t")), t="2019 98 000") == 201998000.0


def test_nfkc_only_when_asked(spark):
    assert one(spark, text.clean_text(F.col("t"), full=True), t="Ｇｏｌｆ  ７") == "Golf 7"


def test_title_case(spark):
    assert one(spark, text.title_case(F.col("t")), t="t-roc x1d") == "T-Roc X1D"


def test_negation_moves_to_the_next_keyword(spark):
    got = one(spark, signals.detect_signals(F.col("t")), t="jamais accidente mais grele en 2020")
    assert [s["code"] for s in got] == ["accidente"]
    assert one(spark, signals.detect_signals(F.col("t")), t="jamais accidente") == []


def test_word_boundary(spark):
    assert one(spark, signals.detect_signals(F.col("t")), t="remise importante") == []
    assert one(spark, signals.detect_signals(F.col("t")), t=None) == []


def test_risk_falls_with_good_news(spark):
    bad = one(spark, signals.risk_of(signals.detect_signals(F.col("t"))), t="moteur hs")
    both = one(spark, signals.risk_of(signals.detect_signals(F.col("t"))), t="moteur hs, premiere main")
    assert 0 < both < bad <= 1


def test_defects_most_severe_first(spark):
    df = spark.createDataFrame([("BMW 320d steptronic", None, None, "BMW", "diesel", 2010, 90000)], "title string, version string, description string, make string, fuel string, year int, km int")
    got = signals.match_defects(df, F.lit(5000.0)).head()["defects"]
    assert [d["code"] for d in got] == ["bmw_n47_chaine", "fap_trajets_courts", "bva_zf8_vidange"]


def test_with_page(spark):
    assert one(spark, urls.with_page(F.col("u"), F.lit(3)), u="https://a.de/x?page=2&k=1") == "https://a.de/x?k=1&page=3"


def test_best_per_vehicle_puts_missing_prices_last(spark):
    df = spark.createDataFrame([(1, "f", 70, None), (2, "f", 70, 9000.0), (3, "f", 60, 1.0), (4, "", 50, 5.0), (5, "", 50, 6.0)], "id long, fingerprint string, score int, price_eur double")
    got = {r["id"]: r["others"] for r in deals.best_per_vehicle(df).collect()}
    assert got == {2: 2, 4: 0, 5: 0}


def test_upsert_is_idempotent(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("a", "1", 10.0, t), ("a", "2", 20.0, t)], "source string, source_id string, price_eur double, at timestamp")
    once = state.upsert(rows, rows, ("source", "source_id"), "at")
    assert sorted(map(tuple, once.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_matches_counts_missing_numbers_as_zero(spark):
    df = spark.createDataFrame([("bmw", None), ("BMW", 9.0)], "make string, price_eur double").withColumn("model", F.lit("x"))
    assert df.where(deals.matches(SearchQuery(make="Bmw", price_max=5))).count() == 1


def test_enrich_keeps_what_is_there(spark):
    df = spark.createDataFrame([("VW Golf TDI", "petrol")], "title string, fuel string")
    for c, t in (("version", "string"), ("description", "string"), ("make", "string"), ("model", "string"), ("gearbox", "string"), ("body", "string"), ("power_hp", "int"), ("km", "int"), ("year", "int"), ("first_registration", "date"), ("seller_type", "string"), ("seller_name", "string"), ("options", "array<string>"), ("price_eur", "double"), ("price", "double"), ("currency", "string")):
        df = df.withColumn(c, F.lit(None).cast(t))
    r = classify.enrich(df, F.lit("2026-01-01").cast("date")).head()
    assert (r["make"], r["model"], r["fuel"], r["gearbox"], r["options"]) == ("Volkswagen", "Golf", "petrol", "unknown", [])


def test_texts_are_read_once_and_words_before_what_stands_before_them(spark):
    """No expression holds its input for each letter or branch; keywords are sought before the words of equipment."""
    assert str(text.title_case(F.col("t"))).count("split(") == 1
    assert str(classify.power_of(F.col("t"))).count("regexp_extract(t,") == 2 and str(classify.km_of(F.col("t"))).count("regexp_extract(t,") == 1
    assert ", (?<!(?:^" not in str(classify.first_class(F.col("t"), vocab.FUEL, ("electric",)))
    rows = [("hayon electrique, gazole", "diesel"), ("hayon electrique et moteur electrique", "electric"), ("sieges  electriques", "unknown"), ("electrique", "electric"), ("dieselx essence", "petrol"), ("hybride plug-in", "phev"), (None, "unknown")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(~F.coalesce(classify.detect_fuel(F.col("t")) == F.col("want"), F.lit(False))).count() == 0
