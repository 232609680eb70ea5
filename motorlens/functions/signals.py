"""Typed signals in an advert's wording, and known weaknesses of its car."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlens.functions import text as tx
from motorlens.functions import vocab as v
from motorlens.functions.classify import any_of

SIGNAL = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("code", T.StringType()), ("label", T.StringType()), ("polarity", T.StringType()), ("weight", T.DoubleType()), ("category", T.StringType()), ("cost", T.IntegerType()), ("evidence", T.StringType()))]))
WINDOW, REACH, SCALE, POSITIVE_SHARE = 90, 24, 2.2, 0.35


def signal_text(*parts: Column) -> Column:
    """The haystack without apostrophes and with single spaces."""
    return F.regexp_replace(F.regexp_replace(tx.haystack(*parts), "['`’]", ""), "\\s+", " ")


#: Every keyword with its place in the tables: signals in order, and the keywords of each in order.
_ROWS = [(*r[:2], "risk", *r[2:]) for r in v.RISKS] + [(*r[:2], "positive", *r[2:]) for r in v.POSITIVES]
_KEYWORDS = sorted({k.strip() for r in _ROWS for k in r[-1]}, key=len, reverse=True)
#: Any keyword at all: texts without one need no closer look.
ANY_KEYWORD = any_of(tuple(_KEYWORDS))


@lru_cache(1)
def _scan() -> tuple[re.Pattern, dict[str, list[str]], dict[str, list[tuple[int, int]]]]:
    """One expression that finds, at each word, the longest keyword that starts there; the shorter ones that it begins
    with; and for each keyword the signals that have it, with its rank among theirs."""
    longest = re.compile("(?<![a-z0-9])(?=(" + "|".join(map(re.escape, _KEYWORDS)) + ")(?![a-z0-9]))")
    begins = {k: [w for w in _KEYWORDS if re.match(re.escape(w) + "(?![a-z0-9])", k)] for k in _KEYWORDS}
    owners: dict[str, list[tuple[int, int]]] = {}
    for n, r in enumerate(_ROWS):
        for rank, k in enumerate(r[-1]):
            owners.setdefault(k.strip(), []).append((n, rank))
    return longest, begins, owners


def negated(hay: str, at: int) -> bool:
    """Whether one of the two words before position at negates what stands there."""
    words = hay[max(0, at - REACH) : at].rstrip(" '-").split()[-2:]
    return bool(words) and (words[-1] in v.NEGATIONS or " ".join(words) in v.NEGATIONS)


def signals_in(hay: str) -> list[dict]:
    """Signals of one text. Only a keyword's first occurrence counts; a negated one leaves it to the next keyword."""
    longest, begins, owners = _scan()
    first: dict[str, int] = {}
    for m in longest.finditer(hay):
        for k in begins[m.group(1)]:
            first.setdefault(k, m.start())
    chosen: dict[int, tuple[int, int, int]] = {}
    for k, at in first.items():
        if not negated(hay, at):
            for n, rank in owners[k]:
                if n not in chosen or rank < chosen[n][0]:
                    chosen[n] = (rank, at, len(_ROWS[n][-1][rank]))
    out = []
    for n, (_, at, size) in sorted(chosen.items()):
        code, label, polarity, weight, category, cost, _ = _ROWS[n]
        out.append({"code": code, "label": label, "polarity": polarity, "weight": weight, "category": category, "cost": cost, "evidence": hay[max(0, at - WINDOW) : at + size + WINDOW].strip()})
    return out


@F.arrow_udf(SIGNAL)
def _signals(hays: pa.Array) -> pa.Array:
    coded = hays.dictionary_encode()  # each distinct wording is looked at once
    kind = pa.list_(pa.struct([("code", pa.string()), ("label", pa.string()), ("polarity", pa.string()), ("weight", pa.float64()), ("category", pa.string()), ("cost", pa.int32()), ("evidence", pa.string())]))
    each = pa.array([signals_in(h) for h in coded.dictionary.to_pylist()] + [[]], kind)
    return each.take(coded.indices.fill_null(len(each) - 1))


def detect_signals(*parts: Column) -> Column:
    """Signals in template order. The closer look runs in Arrow batches, on texts that have a keyword."""
    hay = signal_text(*parts)
    return _signals(F.when(hay.rlike(ANY_KEYWORD), hay))


def risk_of(signals: Column) -> Column:
    """0 to 1."""
    total = lambda p: F.aggregate(F.filter(signals, lambda s: s["polarity"] == p), F.lit(0.0), lambda a, s: a + s["weight"])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (total("risk") - POSITIVE_SHARE * total("positive")) / SCALE))


def repair_budget(signals: Column) -> Column:
    return F.aggregate(F.filter(signals, lambda s: s["polarity"] == "risk"), F.lit(0), lambda a, s: a + s["cost"])


def guarded(conditions: dict[str, float], km: Column, km_per_year: Column) -> Column:
    """Whether the numeric guards of a weakness hold. An unknown km counts as 0; an unknown km a year fits no guard."""
    ok, tests = F.lit(True), {"km_per_year_max": km_per_year <= conditions.get("km_per_year_max", 0), "km_per_year_min": km_per_year >= conditions.get("km_per_year_min", 0), "km_max": F.coalesce(km, F.lit(0)) <= conditions.get("km_max", 0), "km_min": F.coalesce(km, F.lit(0)) >= conditions.get("km_min", 0)}
    for name in conditions:
        ok &= F.coalesce(tests[name], F.lit(False))
    return ok


def match_defects(df: DataFrame, km_per_year: Column) -> DataFrame:
    """df with defects: array of (code, title, verify, cost, severity), most severe first, then in the table's order.

    The knowledge base has fifteen rows, so it becomes fifteen conditions in one projection, not a join."""
    hay = tx.haystack(F.col("title"), F.col("version"), F.col("description"))
    registered = F.year("first_registration") if "first_registration" in df.columns else F.lit(None).cast("int")
    year, km, rows = F.coalesce(F.nullif("year", F.lit(0)), registered), F.col("km") if "km" in df.columns else F.lit(None).cast("int"), []
    for k, (code, title, check, cost, severity, makes, fuels, years, words, most_km) in enumerate(v.DEFECTS):
        ok = F.lit(True)
        if makes:
            ok &= F.coalesce(F.col("make").isin(*makes), F.lit(False))
        if fuels:
            ok &= F.coalesce(F.col("fuel").isin(*fuels), F.lit(False))
        ok &= year.isNull() | year.between(*years)
        if words:
            ok &= F.col("_hay").rlike(any_of(words))
        if most_km is not None:
            ok &= guarded({"km_per_year_max": most_km}, km, km_per_year)
        rows.append(F.when(ok, F.struct(F.lit(-severity).alias("turn"), F.lit(k).alias("k"), F.lit(code).alias("code"), F.lit(title).alias("title"), F.lit(check).alias("verify"), F.lit(cost).alias("cost"), F.lit(severity).alias("severity"))))
    sorted_rows = F.sort_array(F.filter(F.array(*rows), lambda d: d.isNotNull()))
    out = df.withColumn("_hay", hay).withColumn("defects", F.transform(sorted_rows, lambda d: F.struct(d["code"].alias("code"), d["title"].alias("title"), d["verify"].alias("verify"), d["cost"].alias("cost"), d["severity"].alias("severity"))))
    return out.drop("_hay")
