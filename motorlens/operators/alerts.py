"""Standing queries and exactly-once alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens import schemas as s
from motorlens.functions import text as tx
from motorlens.operators.deals import matches


def threshold(w: s.Watchlist) -> float:
    return w.min_score or s.GREAT


def upsert_watchlist(lists: list[s.Watchlist], new: s.Watchlist) -> list[s.Watchlist]:
    """By name; sources and channels that are not given stay as they were."""
    out, known = [], False
    for w in lists:
        if w.name == new.name:
            known = True
            w = s.Watchlist(w.id, w.name, new.query, new.sources or w.sources, new.min_score if new.min_score is not None else w.min_score, new.channels or w.channels)
        out.append(w)
    return out if known else [*out, new]


def matched(scored: DataFrame, lists: list[s.Watchlist]) -> DataFrame:
    """One row for each listing and watchlist that wants it. Every watchlist is a condition in one projection, so the
    listings are read once and not joined."""
    hits = []
    for w in lists:
        ok = matches(w.query) & F.col("active") & (F.col("score") >= threshold(w))
        if w.sources:
            ok &= F.col("source").isin(*w.sources)
        hits.append(F.when(ok, F.lit(w.id)))
    return scored.withColumn("watchlist_id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def new_alerts(scored: DataFrame, lists: list[s.Watchlist], sent: DataFrame, cap: int = 20) -> DataFrame:
    """Alerts to send: not sent before, the best cap of each watchlist."""
    fresh = matched(scored, lists).join(sent.select("watchlist_id", F.col("listing_id").alias("id")).distinct(), ["watchlist_id", "id"], "left_anti")
    w = Window.partitionBy("watchlist_id").orderBy(F.desc("score"), "id")
    return fresh.withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap)


def record(alerts: DataFrame, sent_at: Column) -> DataFrame:
    return alerts.select("watchlist_id", F.col("id").alias("listing_id"), "score", sent_at.alias("sent_at"))


def criteria(q: s.SearchQuery, search_url: str | None = None) -> str:
    """What a watchlist looks for: its own search address, else its criteria."""
    if search_url:
        return search_url
    bits = [x for x in (q.make, q.model) if x]
    for value, wording in ((q.price_max, "jusqu'a {:.0f} EUR"), (q.year_min, "a partir de {}"), (q.km_max, "moins de {} km")):  # fixed wording
        if value:
            bits.append(wording.format(value))
    return " ".join(bits) or "tous criteres"


def message() -> Column:
    """The text of an alert."""
    return F.concat(F.col("make"), F.lit(" "), F.col("model"), F.lit(" - "), F.col("score"), F.lit("/100 - "), tx.thousands(F.col("price_eur"), " "), F.lit(" EUR\n"), F.col("headline"))


def payload() -> Column:
    """The JSON of an alert."""
    return F.to_json(F.struct("watchlist_id", "id", "make", "model", "price_eur", "score", "verdict", "headline"))


def deliver(alerts: DataFrame, sink: str, path: str) -> None:
    """Write the alerts of a run: `parquet` or `json` at path, or `console`. An unknown sink delivers nothing."""
    if sink in ("parquet", "json"):
        alerts.withColumn("payload", payload()).select("watchlist_id", "id", "payload").write.mode("append").format(sink).save(path)
    elif sink == "console":
        alerts.select(message().alias("alert")).show(truncate=False)


STORED_REPORT = "summary string, condition_score int, consistency_score int, verdict string, confidence int, score struct<score: int, headline: string, net_gain_eur: double, verdict: string>"


def reloaded(alerts: DataFrame, valuations: DataFrame, analyses: DataFrame) -> DataFrame:
    """alerts with their stored valuation and analysis (listing_id, report as JSON). An alert without either, or whose report
    cannot be read, is not sent. What the stored score leaves out comes from the alert's own row."""
    read = analyses.select("listing_id", F.from_json("report", STORED_REPORT).alias("stored")).where("stored.summary is not null and stored.verdict is not null")
    both = alerts.join(valuations.withColumnRenamed("listing_id", "_v"), F.col("id") == F.col("_v")).join(read, F.col("id") == F.col("listing_id")).drop("_v", "listing_id")
    score = F.col("stored.score")
    return both.withColumns({
        "score": F.coalesce(score["score"], F.col("score"), F.lit(0)), "headline": F.coalesce(score["headline"], F.lit("")), "net_gain_eur": F.coalesce(score["net_gain_eur"], F.lit(0.0)), "verdict": F.coalesce(score["verdict"], F.col("verdict"), F.lit("check")),
    })
