"""Dictionary classifiers as Column expressions: each class is one alternation on an accent-free haystack."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens.functions import text as tx
from motorlens.functions import vocab as v
from motorlens.schemas import PREMIUM_MAKES


def any_of(keywords: tuple[str, ...]) -> str:
    """Whole-word alternation of keywords (no letter or digit on either side)."""
    words = "|".join(re.escape(k.strip()).replace("\\ ", " ") for k in keywords)
    return f"(?<![a-z0-9])(?:{words})(?![a-z0-9])"


def has_any(hay: Column, keywords: tuple[str, ...], pattern: str | None = None) -> Column:
    """Whether hay has one of keywords as a whole word, in the way of pattern if one is given. Most texts have none of them
    at all, which is seen without an expression."""
    held = F.lit(False)
    for k in dict.fromkeys(k.strip() for k in keywords):
        held |= hay.contains(k)
    return held & hay.rlike(pattern or any_of(keywords))


_let = tx.let


#: Not right after a word of equipment: `hayon electrique` is a tailgate.
_NOT_EQUIPMENT = f"(?<!(?:^|\\s)(?:{'|'.join(v.EQUIPMENT)})\\s{{1,9}})"


def first_class(hay: Column, table: dict[str, tuple[str, ...]], guarded: tuple[str, ...] = ()) -> Column:
    """The first class of table with a keyword in hay, or NULL."""
    out = F.lit(None).cast("string")
    for name, words in reversed(table.items()):
        # The words come first: a look behind of many lengths at every letter costs more than all words together.
        out = F.when(has_any(hay, words, f"(?={any_of(words)}){_NOT_EQUIPMENT}" if name in guarded else None), F.lit(name)).otherwise(out)
    return out


def _fuel_of(hay: Column) -> Column:
    found = first_class(hay, v.FUEL, ("electric", "phev", "hybrid"))
    badge = F.lit(None).cast("string")
    for pattern, fuel in reversed(v.BADGE_FUEL):
        badge = F.when(hay.rlike(pattern), F.lit(fuel)).otherwise(badge)
    return F.coalesce(found, badge)


def fuel_in(*hays: Column) -> Column:
    """Earlier parts win; a hybrid becomes a plug-in if a later part says so."""
    fuels = F.filter(F.transform(F.array(*hays), _fuel_of), lambda f: f.isNotNull())
    return _let(fuels, lambda found: F.when((F.get(found, 0) == "hybrid") & F.array_contains(found, "phev"), F.lit("phev")).otherwise(F.coalesce(F.get(found, 0), F.lit("unknown"))))


def detect_fuel(*parts: Column) -> Column:
    return fuel_in(*[tx.haystack(p) for p in parts])


def gearbox_in(hay: Column) -> Column:
    return F.coalesce(first_class(hay, v.GEARBOX), F.lit("unknown"))


def detect_gearbox(*parts: Column) -> Column:
    return _let(tx.haystack(*parts), gearbox_in)


def body_in(hay: Column) -> Column:
    return F.coalesce(first_class(hay, v.BODY), F.lit("unknown"))


def detect_body(*parts: Column) -> Column:
    return _let(tx.haystack(*parts), body_in)


def detect_options(*parts: Column) -> Column:
    return _let(tx.haystack(*parts), options_in)


def options_in(hay: Column) -> Column:
    found = F.array(*[F.when(has_any(hay, words), F.lit(code)) for code, words in v.OPTIONS.items()])
    return F.array_sort(F.filter(found, lambda c: c.isNotNull()))


def detect_seller(name: Column, description: Column) -> Column:
    hay = tx.haystack(name, description)
    return F.when(hay.rlike(any_of(v.PRO_HINTS)), F.lit("pro")).when(hay.rlike("|".join(v.PRIVATE_HINTS)), F.lit("private")).otherwise(F.lit("unknown"))


def is_premium(make: Column) -> Column:
    return F.coalesce(make.isin(*PREMIUM_MAKES), F.lit(False))


_LONGEST = sorted(v.MAKES, key=len, reverse=True)
#: Every alias that stands at a word of the text: at each place the longest, found by looking ahead, so that none hides another.
_ALIASES = "\\b(?=(" + "|".join(re.escape(a).replace("\\ ", " ") for a in _LONGEST) + ")\\b)"


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _best_alias(hay: Column, order: list[str]) -> Column:
    """The alias in hay that comes first in order, or NULL; one scan of hay."""
    ranks = F.transform(F.regexp_extract_all(hay, F.lit(_ALIASES), 1), lambda a: F.try_element_at(_table({x: k for k, x in enumerate(order, 1)}), a))
    return F.try_element_at(F.array(*map(F.lit, order)), F.array_min(ranks))


def _make_of(alias: Column) -> Column:
    return F.try_element_at(_table(v.MAKES), alias)


def canonical_make(value: Column) -> Column:
    """Exact alias, else the first alias found as a word in the table's order, else the name in title case."""
    named = _let(tx.strip_accents(F.lower(F.trim(value))), lambda key: F.coalesce(_make_of(key), _make_of(_best_alias(key, list(v.MAKES)))))
    return F.when(F.coalesce(value, F.lit("")) != "", F.coalesce(named, F.nullif(tx.title_case(F.trim(value)), F.lit(""))))


def detect_make(text: Column) -> Column:
    return make_in(tx.haystack(text))


def make_in(hay: Column) -> Column:
    return _make_of(_best_alias(hay, _LONGEST))


def canonical_model(make: Column, text: Column) -> Column:
    """A make's own model expressions on the text without its longest make alias, else the first usable word."""

    def bare(hay: Column) -> Column:
        return _let(_best_alias(hay, _LONGEST), lambda a: F.trim(F.when(a.isNull(), hay).otherwise(F.regexp_replace(hay, F.concat(F.lit("\\b\\Q"), a, F.lit("\\E\\b")), F.lit(" ")))))

    def model(words: Column) -> Column:
        rule = F.lit(None).cast("string")
        for name, rules in v.MODELS.items():
            found = F.lit(None).cast("string")
            for pattern, prefix in reversed(rules):
                label = F.concat(F.lit(prefix or ""), F.regexp_extract(words, pattern, 1))
                found = F.when(words.rlike(pattern), tx.title_case(F.trim(label))).otherwise(found)
            rule = F.when(make == name, found).otherwise(rule)
        tokens = F.transform(F.split(words, "\\s+"), lambda t: F.regexp_replace(t, "^[-.,()]+|[-.,()]+$", ""))
        digits = lambda t: t.rlike("^[0-9]+$")
        usable = F.filter(tokens, lambda t: (digits(t) & F.length(t).between(3, 4)) | (~digits(t) & (F.length(t) >= 2) & ~t.isin(*v.MODEL_STOPWORDS)))
        return F.coalesce(rule, tx.title_case(F.get(usable, 0)))

    return F.when(F.coalesce(text, F.lit("")) != "", _let(tx.haystack(text), lambda hay: _let(bare(hay), model)))


def power_in(text: Column) -> Column:
    return _let(tx.haystack(text), power_of)


def power_of(hay: Column) -> Column:
    """Power with its unit, else the number behind an engine badge."""
    unit = F.regexp_extract(hay, "(\\d{2,4})\\s*(ch|cv|hp|ps|bhp|kw)\\b", 0)
    badge = F.regexp_extract(hay, f"\\b({'|'.join(v.POWER_BADGES)})\\s*[- ]?(\\d{{2,3}})\\b", 2)
    found = _let(unit, lambda u: F.when(u == "", badge).otherwise(u))
    return _let(_let(found, lambda t: F.nullif(t, F.lit(""))), tx.parse_power_hp)


def km_in(text: Column) -> Column:
    return km_of(tx.haystack(text))


def km_of(hay: Column) -> Column:
    found = _let(F.regexp_extract(hay, "([\\d.,\\s]{2,12})\\s*(km|miles|mi)\\b", 0), lambda t: F.nullif(t, F.lit("")))
    return _let(found, tx.parse_km)


def enrich(df: DataFrame, as_of: Column) -> DataFrame:
    """Fill what an advert's own text tells; values that are there stay. df has the text columns of a listing."""
    blank = lambda name: F.col(name).isNull() | (F.col(name) == "unknown")
    df = df.withColumns({"title": F.coalesce(tx.clean_text(F.col("title")), F.col("title")), "description": tx.clean_text(F.col("description"))})
    # Haystacks are made once, as columns; what they are asked for comes in the next projection.
    title, version, said, whole, every, options = hays = [f"_hay_{c}" for c in ("title", "version", "description", "whole", "all", "options")]
    join = lambda *names: F.array_join(F.filter(F.array(*map(F.col, names)), lambda p: p != ""), " ")
    df = df.withColumns({title: tx.haystack(F.col("title")), version: tx.haystack(F.col("version")), said: tx.haystack(F.col("description")), options: tx.haystack(F.array_join("options", " "))})
    df = df.withColumns({whole: F.concat_ws(" ", title, said), every: join(title, version, said)})
    df = df.withColumns({"make": F.coalesce(canonical_make(F.col("make")), make_in(F.col(whole))), options: join(every, options)})
    return df.withColumns({
        "model": F.when(F.coalesce(F.col("model"), F.lit("")) == "", canonical_model(F.col("make"), F.col("title"))).otherwise(F.coalesce(canonical_model(F.col("make"), F.col("model")), F.col("model"))),
        "fuel": F.when(blank("fuel"), fuel_in(F.col(title), F.col(version), F.col(said))).otherwise(F.col("fuel")),
        "gearbox": F.when(blank("gearbox"), gearbox_in(F.col(every))).otherwise(F.col("gearbox")),
        "body": F.when(blank("body"), body_in(F.col(every))).otherwise(F.col("body")),
        "power_hp": F.coalesce(F.col("power_hp"), power_of(F.col(whole))),
        "km": F.coalesce(F.col("km"), km_of(F.col(whole))),
        "year": F.coalesce(F.col("year"), tx.parse_year(F.col("title"), as_of), F.year("first_registration")),
        "seller_type": F.when(blank("seller_type"), detect_seller(F.col("seller_name"), F.col("description"))).otherwise(F.col("seller_type")),
        "options": F.array_sort(F.array_union(F.coalesce(F.col("options"), F.array().cast("array<string>")), options_in(F.col(options)))),
        "price_eur": F.coalesce(F.col("price_eur"), tx.to_eur(F.col("price"), F.col("currency"))),
    }).drop(*hays)
