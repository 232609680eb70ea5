"""Closed vocabularies, rates and the schemas of the main tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Enumerations, exchange rates and value curves.
FUELS = ("petrol", "diesel", "hybrid", "phev", "electric", "lpg", "cng", "ethanol", "other", "unknown")
GEARBOXES = ("manual", "automatic", "unknown")
SELLERS = ("private", "pro", "unknown")
BODIES = ("city", "hatch", "sedan", "estate", "suv", "coupe", "cabrio", "van", "pickup", "unknown")
VERDICTS = ("grab", "check", "avoid", "unknown")
SEVERITIES = ("info", "attention", "serieux", "redhibitoire")
FX_TO_EUR = {"EUR": 1.0, "GBP": 1.17, "CHF": 1.06, "PLN": 0.23, "SEK": 0.089, "NOK": 0.086, "DKK": 0.134, "CZK": 0.04, "HUF": 0.0025, "RON": 0.2, "BGN": 0.51}
AGE_RATE, AGE_RATE_PREMIUM, AGE_RATE_ELECTRIC = 0.125, 0.155, 0.030
KM_RATE = {"diesel": 0.30, "petrol": 0.38, "hybrid": 0.34, "phev": 0.36, "electric": 0.28, "lpg": 0.38, "cng": 0.38, "ethanol": 0.40, "other": 0.35, "unknown": 0.35}
SELLER_FACTOR = {"pro": 1.07, "private": 1.0, "unknown": 1.03}
COUNTRY_FACTOR = {"FR": 1.00, "DE": 0.93, "BE": 0.97, "NL": 1.02, "IT": 0.95, "ES": 0.94, "PT": 0.98, "AT": 0.99, "LU": 0.96, "PL": 0.88, "CH": 1.08, "GB": 0.90, "SE": 0.97, "DK": 1.05, "CZ": 0.90}
OPTION_VALUE, OPTION_CAP, AUTOMATIC_FACTOR, KM_UNIT = 0.010, 0.09, 1.05, 150_000
PREMIUM_MAKES = ("BMW", "Mercedes-Benz", "Audi", "Porsche", "Jaguar", "Land Rover", "Lexus", "Maserati", "Ferrari", "Lamborghini", "Alpine", "Tesla", "Polestar", "Volvo", "DS")
#: Dollars for a million input and output tokens, converted at USD_TO_EUR; other models take DEFAULT_PRICE.
DEFAULT_PRICE, USD_TO_EUR = (5.0, 25.0), 0.92
#: Rates of models by name, for callers to fill.
MODEL_RATES: dict[str, tuple[float, float]] = {}


@dataclass(frozen=True)
class Tier:
    """How far a comparable may be from its target. Tiers are nested: each admits all that the one before admits."""

    name: str
    years: int
    km: float
    fuel: bool
    gearbox: bool
    country: bool
    confidence: float


# Fixed values.
TIERS = (
    Tier("strict", 1, 0.30, True, True, True, 1.0),
    Tier("modele_carburant", 2, 0.50, True, False, True, 0.9),
    Tier("modele", 3, 0.70, False, False, True, 0.75),
    Tier("modele_europe", 3, 0.70, False, False, False, 0.6),
    Tier("modele_large", 5, 1.00, False, False, False, 0.4),
)
KM_SLACK, MIN_COMPS, MAX_AGE_DAYS, MIN_PRICE = 15_000, 8, 120, 500

PHOTO = T.StructType([T.StructField("url", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("caption", T.StringType())])


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


#: An advert as it is collected and kept.
LISTING = T.StructType(
    _fields(T.LongType(), "id")
    + _fields(T.StringType(), "source source_id url country title description")
    + _fields(T.DoubleType(), "price price_eur")
    + _fields(T.StringType(), "currency make model version")
    + _fields(T.IntegerType(), "year km power_hp owners doors seats")
    + _fields(T.DateType(), "first_registration")
    + _fields(T.StringType(), "fuel gearbox body seller_type color seller_name city postcode region")
    + [T.StructField("options", T.ArrayType(T.StringType())), T.StructField("photos", T.ArrayType(PHOTO)), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
    + _fields(T.TimestampNTZType(), "posted_at scraped_at first_seen last_seen price_changed_at analyzed_at")
    + _fields(T.BooleanType(), "active")
)
PRICE_POINT = T.StructType([T.StructField("listing_id", T.LongType()), T.StructField("price_eur", T.DoubleType()), T.StructField("seen_at", T.TimestampType())])


@dataclass(frozen=True)
class SearchQuery:
    """Optional criteria of a search; an unset one does not filter."""

    make: str | None = None
    model: str | None = None
    keywords: str | None = None
    price_min: float | None = None
    price_max: float | None = None
    year_min: int | None = None
    year_max: int | None = None
    km_max: int | None = None
    fuel: str | None = None
    gearbox: str | None = None
    countries: tuple[str, ...] = ()
    limit: int = 50

    def label(self) -> str:
        return " ".join(x for x in (self.make, self.model, self.keywords) if x) or "recherche"


@dataclass(frozen=True)
class Watchlist:
    """A standing query; a min_score of 0 or None stands for the default threshold."""

    id: int
    name: str
    query: SearchQuery
    sources: tuple[str, ...] = ()
    min_score: float | None = None
    channels: tuple[str, ...] = field(default=("console",))


#: Scores from which a deal is great and worth a check, and the confidence from which a price is judged.
GREAT, CHECK, MIN_CONFIDENCE = 75, 55, 0.35
