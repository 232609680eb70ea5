"""Text, number and date parsing as Column expressions (no Python runs but in :func:`nfkc`)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlens.schemas import DEFAULT_PRICE, FX_TO_EUR, USD_TO_EUR

_WIDE_SPACES = "\u00a0\u202f\u2009\u2007"
_PLAIN = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
_FROM = "".join(c for c, d in _PLAIN if len(d) > 1 and ord(d[0]) < 128)
_TO = "".join(d[0] for _, d in _PLAIN if len(d) > 1 and ord(d[0]) < 128)
MILE_KM, KW_HP = 1.60934, 1.35962
#: Month names by their first three or four letters. Fixed values.
MONTHS = {
    "janv": 1, "jan": 1, "fevr": 2, "feb": 2, "mars": 3, "mar": 3, "avr": 4, "apr": 4, "mai": 5, "may": 5, "juin": 6, "jun": 6,
    "juil": 7, "jul": 7, "aou": 8, "aug": 8, "sept": 9, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}


def let(value: Column, of) -> Column:
    """of(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), of), 0)


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility normal form, which Spark SQL lacks."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def clean_text(text: Column, full: bool = False) -> Column:
    """Plain spaces, no runs of blanks, at most one empty line, trimmed; empty is NULL. full: NFKC first."""
    t = F.translate(nfkc(text) if full else text, _WIDE_SPACES, " " * len(_WIDE_SPACES))
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(t, "^\\s+|\\s+$", ""), F.lit(""))


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks; loose combining marks go."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), "\\p{Mn}", "")


def haystack(*parts: Column) -> Column:
    """Lower-case, accent-free text of all parts that are not NULL or empty."""
    return strip_accents(F.lower(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(text: Column) -> Column:
    """A capital wherever a letter follows something that is not a letter; other letters are small."""
    letter = lambda c: c.rlike("^\\p{L}$")
    cased = lambda chars: F.transform(chars, lambda c, i: F.when((i == 0) | ~F.coalesce(letter(F.get(chars, i - 1)), F.lit(False)), F.upper(c)).otherwise(F.lower(c)))
    return let(F.split(text, "(?!^)"), lambda chars: F.array_join(cased(chars), ""))


def number_token(text: Column) -> Column:
    """The first number with its separators; blanks inside belong to it. NULL if there is none."""
    plain = F.translate(text, _WIDE_SPACES, " " * len(_WIDE_SPACES))
    return let(F.regexp_extract(plain, "(\\d[\\d\\s.,]*\\d|\\d)", 1), lambda t: F.nullif(t, F.lit("")))


def parse_price(text: Column) -> Column:
    """Separators are thousands, but one or two digits after the last of `.,` are decimals."""

    def price(part: Column) -> Column:
        digits, tail = part["digits"], part["tail"]
        whole = F.substring(digits, F.lit(1), F.length(digits) - F.length(tail))
        return F.when((tail != "") & (F.length(digits) > F.length(tail)), F.concat(whole, F.lit("."), tail)).otherwise(digits).try_cast("double")

    parts = let(number_token(text), lambda t: F.struct(F.regexp_replace(t, "\\D", "").alias("digits"), F.regexp_extract(t, "[.,](\\d{1,2})$", 1).alias("tail")))
    return let(parts, price)


def parse_decimal(text: Column) -> Column:
    """With both separators the last is the decimal sign; a lone comma is one; what is no number gives NULL."""
    token = F.replace(number_token(text), F.lit(" "), F.lit(""))
    both = F.concat(F.regexp_replace(F.regexp_extract(token, "^(.*)[.,]", 1), "[.,]", ""), F.lit("."), F.regexp_extract(token, "([^.,]*)$", 1))
    return F.when(token.contains(",") & token.contains("."), both).otherwise(F.replace(token, F.lit(","), F.lit("."))).try_cast("double")


def _whole(value: Column, low: int, high: int) -> Column:
    return let(F.bround(value).cast("long"), lambda n: F.when(n.between(low, high), n.cast("int")))


def parse_km(text: Column) -> Column:
    raw, n = F.lower(text), parse_price(text)
    n = F.when(raw.rlike("\\b(mi|miles|mile)\\b") & ~raw.contains("km"), n * MILE_KM).otherwise(n)
    return _whole(F.when(raw.rlike("\\btkm\\b") & (n < 1000), n * 1000).otherwise(n), 0, 2_000_000)


def parse_power_hp(text: Column) -> Column:
    raw, n = F.lower(text), parse_price(text)
    return _whole(F.when(raw.rlike("\\bkw\\b") & ~raw.rlike("\\b(ch|cv|hp|ps|bhp)\\b"), n * KW_HP).otherwise(n), 15, 1500)


_YEAR = "(19[7-9]\\d|20[0-4]\\d)"


def parse_year(text: Column, as_of: Column) -> Column:
    """The first plausible year, unless it lies beyond next year."""
    y = F.nullif(F.regexp_extract(text, _YEAR, 1), F.lit("")).cast("int")
    return F.when(y <= F.year(as_of) + 1, y)


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """NULL for a month outside 1..12; days are clamped to 1..28."""
    return F.when(year.isNotNull() & month.between(1, 12), F.make_date(year, month, F.greatest(F.lit(1), F.least(day, F.lit(28)))))


def parse_registration(text: Column, as_of: Column) -> Column:
    """`2018-03[-01]`, `03/2018`, a month's name and a year, or a year alone (its first of June)."""
    t = F.lower(strip_accents(text))
    part = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    iso, slashed, named = f"\\b{_YEAR}-(\\d{{1,2}})(?:-(\\d{{1,2}}))?\\b", f"\\b(\\d{{1,2}})[/.\\-]{_YEAR}\\b", f"([a-z]{{3,4}})[a-z.]*\\s+{_YEAR}"
    months = F.create_map(*[F.lit(v) for pair in MONTHS.items() for v in pair])
    month = F.try_element_at(months, part(named, 1))
    return (
        F.when(part(iso, 1).isNotNull(), safe_date(part(iso, 1).cast("int"), part(iso, 2).cast("int"), F.coalesce(part(iso, 3).cast("int"), F.lit(1))))
        .when(part(slashed, 1).isNotNull(), safe_date(part(slashed, 2).cast("int"), part(slashed, 1).cast("int"), F.lit(1)))
        .when(month.isNotNull(), safe_date(part(named, 2).cast("int"), month, F.lit(1)))
        .otherwise(safe_date(parse_year(text, as_of), F.lit(6), F.lit(1)))
    )


def to_eur(amount: Column, currency: Column) -> Column:
    """NULL for an unknown currency; no currency means euros."""
    rates = F.create_map(*[F.lit(v) for pair in FX_TO_EUR.items() for v in pair])
    return F.round(amount * F.try_element_at(rates, F.upper(F.coalesce(F.nullif(currency, F.lit("")), F.lit("EUR")))), 2)


def token_cost(read: Column, written: Column, rates: tuple[float, float] = DEFAULT_PRICE) -> Column:
    """Euros for tokens read and written, at rates in dollars for a million each."""
    return (read * rates[0] + written * rates[1]) / 1e6 * USD_TO_EUR


def country(code: Column) -> Column:
    return F.substring(F.upper(F.coalesce(F.nullif(code, F.lit("")), F.lit("FR"))), 1, 2)


def age_years(year: Column, as_of: Column, registered: Column | None = None) -> Column:
    by_year = F.when(F.coalesce(year, F.lit(0)) != 0, F.greatest(F.lit(0.0), F.year(as_of) - year + F.lit(0.5)))
    if registered is None:
        return by_year
    return F.coalesce(F.greatest(F.lit(0.0), F.datediff(as_of, registered) / F.lit(365.25)), by_year)


def km_per_year(km: Column, age: Column) -> Column:
    return F.when(age >= 0.5, km / age)


def fingerprint(make: Column, model: Column, year: Column, km: Column, fuel: Column, power: Column) -> Column:
    """Identity of a physical car: a missing part, or a year or power of 0, is `?`."""
    q = F.lit("?")
    some = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("0")), q)
    parts = (F.coalesce(F.nullif(F.lower(make), F.lit("")), q), F.coalesce(F.nullif(F.lower(model), F.lit("")), q), some(year), F.coalesce(km.cast("string"), q), fuel, some(power))
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 24)


def thousands(value: Column, separator: str = "\u202f") -> Column:
    return F.translate(F.format_number(F.bround(value), 0), ",", separator)
