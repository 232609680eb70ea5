"""A scan as one run: what is stale or touched is valued and scored, the best adverts are opened again, what that changes is
valued again, and the very best are read by a model.

A changed advert is a comparable of others, so the second valuation takes the changed adverts and those candidates that have
one of them in reach of their widest tier, before or after the change. All other candidates keep their first valuation; that
equals a valuation of everything anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens.functions import text as tx
from motorlens.operators import deals, expert, replies
from motorlens.operators import valuation as val
from motorlens.streaming.folders import shared_folder

#: Adverts that a scan opens again at least.
DETAILS = 20


@dataclass
class Scan:
    scored: DataFrame  # every candidate with valuation, report and score; opened, revalued
    changed: DataFrame  # adverts as their own pages tell them
    replies: DataFrame | None  # of the adverts that a model was asked about: id, degraded_reason, cost_eur
    skipped: int  # adverts of the search that are fresh


def touched_by(changed: DataFrame, candidates: DataFrame, market: DataFrame, as_of: Column) -> DataFrame:
    """id of the candidates that are changed or have a changed advert in reach. market: adverts before the change."""
    before = market.join(changed.select("id"), "id", "left_semi")
    offers = val.vehicle_factor(before.unionByName(changed.select(*market.columns)), as_of)
    reached = val.pairs(val.vehicle_factor(candidates, as_of), offers).select(F.col("t_id").alias("id"))
    return reached.union(changed.select("id")).distinct()


def fingerprinted(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", tx.fingerprint(*[F.col(c) for c in ("make", "model", "year", "km", "fuel", "power_hp")]))


def run(market: DataFrame, searched: DataFrame, candidates: DataFrame, as_of: Column, opened: DataFrame, sources: tuple[str, ...], deep: int = 0, details: int = DETAILS, ask: Callable[[DataFrame], DataFrame] | None = None) -> Scan:
    """market: all adverts, with title, version, price_dropped. searched: those of the search; candidates: those of them to be
    valued. opened: what adverts' own pages say, in columns of market, read for the adverts that are opened alone. ask: gives
    replies (see :mod:`.replies`) to the adverts that it is handed, at most deep of them."""
    folder = shared_folder(market.sparkSession, "scan")

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    def scores(targets: DataFrame, of: DataFrame) -> DataFrame:
        return expert.score(expert.report(val.value_market(of, as_of, targets, among=True), as_of), as_of)

    first = saved(scores(candidates, market), "first")
    picked = saved(deals.to_reopen(first, sources, max(deep, details)).select("id"), "picked")
    listed = market.join(F.broadcast(picked), "id", "left_semi")  # a budget of rows
    changed = saved(fingerprinted(deals.completed(listed, opened.join(F.broadcast(picked), "id", "left_semi"), "id").select(*market.columns)), "changed")
    now = market.join(F.broadcast(changed.select("id")), "id", "left_anti").unionByName(changed)
    again = saved(touched_by(changed, candidates, market, as_of), "again")
    second = scores(now.join(again.join(candidates.select("id"), "id", "left_semi"), "id", "left_semi"), now).withColumn("revalued", F.lit(True))
    kept = first.join(again, "id", "left_anti").withColumn("revalued", F.lit(False))
    both = kept.unionByName(second, allowMissingColumns=True)
    out = saved(both.join(F.broadcast(picked.withColumn("opened", F.lit(True))), "id", "left").withColumn("opened", F.coalesce("opened", F.lit(False))), "second")
    told = None
    if deep and ask:
        best = out.orderBy(F.desc("score"), "id").limit(deep)
        asked = saved(ask(best), "replies")
        told = saved(replies.checked(asked).select("id", "degraded_reason", "cost_eur"), "told")
        read = expert.score(replies.applied(best.drop("factors", "score", "net_gain_eur", "verdict", "headline"), asked).drop("read_by", "photos_analyzed", "degraded_reason", "cost_eur"), as_of)
        out = out.join(F.broadcast(best.select("id")), "id", "left_anti").unionByName(read.select(*out.columns))
    return Scan(out, changed, told, searched.count() - candidates.count())


def summary(scan: Scan, collected: DataFrame) -> DataFrame:
    """One row of figures. collected: source, seen, created of each source."""
    got = collected.agg(F.sum("seen").alias("collected"), F.sum("created").alias("created"))
    valued = scan.scored.agg(F.count(F.lit(1)).alias("valued"), F.count_if("opened").alias("opened"))
    detailed = scan.changed.agg(F.count(F.lit(1)).alias("detailed"))
    deep = scan.replies if scan.replies is not None else scan.scored.limit(0).select("id", F.lit(None).cast("string").alias("degraded_reason"), F.lit(0.0).alias("cost_eur"))
    told = deep.agg(F.count_if(F.col("degraded_reason").isNull()).alias("deep"), F.count("degraded_reason").alias("degraded"), F.round(F.coalesce(F.sum("cost_eur"), F.lit(0.0)), 4).alias("cost_eur"))
    return got.crossJoin(valued).crossJoin(detailed).crossJoin(told).withColumn("skipped_fresh", F.lit(scan.skipped).cast("long"))  # one row each
