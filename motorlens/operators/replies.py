"""Reports by a language model: the dossier that is sent, and the check of what comes back.

A reply counts only if it is a whole report whose values are in range. Anything else falls back to the rules' report for
that advert alone, with the reason beside it, so that one bad reply costs no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens import schemas as s
from motorlens.functions import text as tx

_FLAG = "struct<label: string, severity: string, evidence: string, estimated_cost_eur: int>"
# The fields of a report, its severities and verdicts.
REPLY = (
    f"summary string, condition_score int, consistency_score int, photo_findings array<struct<photo_index: int, observation: string, severity: string>>, red_flags array<{_FLAG}>, strengths array<string>, "
    "known_issues_to_check array<string>, questions_to_seller array<string>, negotiation_levers array<string>, estimated_repairs_eur int, verdict string, confidence int"
)
FIELDS = tuple(f.strip().split(" ")[0] for f in "summary condition_score consistency_score photo_findings red_flags strengths known_issues_to_check questions_to_seller negotiation_levers estimated_repairs_eur verdict confidence".split())
SEVERITIES, VERDICTS = ("info", "attention", "serieux", "redhibitoire"), ("grab", "check", "avoid")


def dossier(photos: Column | None = None) -> Column:
    """The text that describes a valued advert with signals and defects to a model: facts that are known, the advert's own
    words, the valuation if it has one, what the rules found, and how many photos come with it."""
    facts = [
        ("make", F.col("make")), ("model", F.col("model")), ("year", F.col("year")), ("km", tx.thousands(F.col("km"), " ")), ("fuel", F.nullif(F.col("fuel"), F.lit("unknown"))), ("gearbox", F.nullif(F.col("gearbox"), F.lit("unknown"))),
        ("power (hp)", F.col("power_hp")), ("asking price (EUR)", tx.thousands(F.col("price_eur"), " ")), ("seller", F.nullif(F.col("seller_type"), F.lit("unknown"))), ("country", F.col("country")),
    ]
    line = lambda name, value: F.when(value.cast("string") != "", F.concat(F.lit(f"{name}: "), value.cast("string")))
    valued = F.when(F.col("comps_count") > 0, F.concat_ws("\n", line("fair price (EUR)", tx.thousands(F.col("fair_price_eur"), " ")), F.concat(F.lit("range (EUR): "), tx.thousands(F.col("low_eur"), " "), F.lit(" to "), tx.thousands(F.col("high_eur"), " ")), F.concat(F.lit("comparables: "), F.col("comps_count"), F.lit(", confidence "), F.col("confidence"))))
    signals = F.nullif(F.array_join(F.transform("signals", lambda x: F.concat(x["polarity"], F.lit(": "), x["label"], F.lit(" ["), F.substring(x["evidence"], 1, 140), F.lit("]"))), "\n"), F.lit(""))
    defects = F.nullif(F.array_join(F.transform("defects", lambda d: F.concat(d["title"], F.lit(", to verify: "), d["verify"])), "\n"), F.lit(""))
    n = photos if photos is not None else F.lit(0)
    block = lambda head, body: F.when(body.isNotNull(), F.concat(F.lit(f"# {head}\n"), body))
    return F.concat_ws(
        "\n\n", block("Car", F.concat_ws("\n", *[line(*f) for f in facts])), block("Advert", F.concat_ws("\n", "title", F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("(no description)")))),
        block("Market", valued), block("Found in the text", signals), block("Known weaknesses of the model", defects), block("Photos", F.when(n > 0, F.concat(n, F.lit(" attached, counted from 0"))).otherwise(F.lit("none: judge by the text and be less sure"))),
    )


def flaw(said: Column, r: Column) -> Column:
    """What is wrong with a reply (as a variant, and as a struct of REPLY), the first flaw; NULL if nothing is. A value of
    the wrong type is NULL in the struct alone."""
    there = lambda c: F.try_variant_get(said, f"$.{c}", "string").isNotNull()
    lacking = F.coalesce(*[F.when(r[c].isNull(), F.when(there(c), F.lit(f"{c} of another type")).otherwise(F.lit(f"lacks {c}"))) for c in FIELDS])
    within = F.coalesce(*[F.when(~r[c].between(0, 100), F.lit(f"{c} out of range")) for c in ("condition_score", "consistency_score", "confidence")])
    odd = F.exists(F.concat(F.transform(r["red_flags"], lambda f: f["severity"]), F.transform(r["photo_findings"], lambda p: p["severity"])), lambda x: x.isNull() | ~x.isin(*SEVERITIES))
    empty = F.exists(r["red_flags"], lambda f: f["label"].isNull() | f["evidence"].isNull() | f["estimated_cost_eur"].isNull())
    return F.coalesce(lacking, within, F.when(~r["verdict"].isin(*VERDICTS), F.lit("unknown verdict")), F.when(odd, F.lit("unknown severity")), F.when(empty, F.lit("incomplete flag")))


def checked(replies: DataFrame) -> DataFrame:
    """replies (stop_reason, body, input_tokens, output_tokens, model) with reply (the report, or NULL), degraded_reason and
    cost_eur. A reply that was refused, cut off, is no JSON or no whole report gives a reason and costs nothing."""
    fits = f"struct<{REPLY}>"
    parsed = replies.withColumn("_v", F.try_parse_json("body")).withColumn("_r", F.expr(f"try_variant_get(_v, '$', '{fits}')"))
    reason = (
        F.when(F.col("stop_reason").isNull(), F.lit("no reply")).when(F.col("stop_reason") == "refusal", F.lit("refused by the model")).when(F.col("stop_reason") == "max_tokens", F.lit("reply cut off"))
        .when(F.col("_v").isNull(), F.lit("reply is no JSON")).when(F.col("_r").isNull(), F.lit("reply is no report")).otherwise(flaw(F.col("_v"), F.col("_r")))
    )
    known = F.create_map(*[F.lit(x) for m, r in s.MODEL_RATES.items() for x in (m, F.array(F.lit(r[0]), F.lit(r[1])))]) if s.MODEL_RATES else F.create_map().cast("map<string,array<double>>")
    rates = F.coalesce(F.try_element_at(known, F.col("model")), F.array(F.lit(s.DEFAULT_PRICE[0]), F.lit(s.DEFAULT_PRICE[1])))
    cost = F.round((F.coalesce("input_tokens", F.lit(0)) * rates[0] + F.coalesce("output_tokens", F.lit(0)) * rates[1]) / 1e6 * s.USD_TO_EUR, 4)
    parsed = parsed.withColumn("degraded_reason", reason)
    ok = F.col("degraded_reason").isNull()
    return parsed.withColumns({"reply": F.when(ok, F.col("_r")), "cost_eur": F.when(ok, cost).otherwise(F.lit(0.0))}).drop("_v", "_r")


def applied(reports: DataFrame, replies: DataFrame, key: str = "id") -> DataFrame:
    """reports (key, report of the rules) with the reply's values in the report where a reply is whole; read_by (the model, or rules), photos_analyzed
    (0 for the rules), degraded_reason and cost_eur. An advert without a row in replies was not asked about."""
    points = {"info": 3, "attention": 12, "serieux": 30, "redhibitoire": 60}
    c = checked(replies).select(F.col(key).alias("_key"), F.col("model").alias("_model"), "reply", "degraded_reason", "cost_eur", "photos")
    both = reports.join(c, F.col(key) == F.col("_key"), "left")
    r, weights = F.col("reply"), F.create_map(*[F.lit(x) for p in points.items() for x in p])
    flags = F.transform(r["red_flags"], lambda f: F.struct(f["label"].alias("label"), f["severity"].alias("severity"), f["evidence"].alias("evidence"), f["estimated_cost_eur"].alias("cost")))
    risk = F.aggregate(r["red_flags"], F.lit(0), lambda a, f: a + F.element_at(weights, f["severity"])) + F.floor(F.greatest(F.lit(0), 60 - r["consistency_score"]) / 2).cast("int")
    told = F.struct(
        r["summary"].alias("summary"), r["condition_score"].alias("condition_score"), r["consistency_score"].alias("consistency_score"), flags.alias("red_flags"), r["strengths"].alias("strengths"), r["known_issues_to_check"].alias("known_issues"),
        r["questions_to_seller"].alias("questions"), r["negotiation_levers"].alias("levers"), r["estimated_repairs_eur"].alias("repairs_eur"), r["verdict"].alias("verdict"), F.greatest(F.lit(0), F.least(F.lit(100), risk)).alias("risk_score"), r["confidence"].alias("confidence"),
    )
    whole = r.isNotNull()
    return both.withColumns({
        "report": F.when(whole, told).otherwise(F.col("report")), "read_by": F.when(whole, F.col("_model")).otherwise(F.lit("rules")), "photos_analyzed": F.when(whole, F.coalesce("photos", F.lit(0))).otherwise(F.lit(0)),
        "cost_eur": F.coalesce("cost_eur", F.lit(0.0)),
    }).drop("_key", "_model", "reply", "photos")
