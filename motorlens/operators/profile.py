"""Profiles of a source: how well fields are filled, what shapes its links have, and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens.functions import urls as ul
from motorlens.sources import pages as pg

CRITICAL, USEFUL = ("price", "km", "year", "make"), ("model", "fuel", "gearbox", "power_hp", "photos", "description")
#: What pages that JavaScript fills carry, and the levels of sources.
JS_MARKERS = ("__NEXT_DATA__", "window.__NUXT__", "__remixContext", "ng-version", "data-reactroot", "window.__INITIAL_STATE__", "__APOLLO_STATE__")
LEVELS = ("ok", "liste", "partiel", "extraction", "motif", "js", "interdit", "echec")


def is_filled(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull() & ~c.cast("string").isin("", "unknown")


def filled(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, filled: rows in which the field has a value."""
    kinds = dict(df.dtypes)
    one = df.agg(*[F.count_if(is_filled(f, kinds[f])).alias(f) for f in fields])
    return one.unpivot([], list(fields), "field", "filled")


def shape(path: Column) -> Column:
    """The path with digits, long identifiers and slugs with a number masked, piece by piece."""
    part = lambda p: F.when(p.rlike("^[0-9]+$"), F.lit("\\d+")).when(p.rlike("^[0-9a-f-]{30,}$"), F.lit("[0-9a-f-]{30,}")).when(p.rlike("[0-9]{4,}"), F.lit("[^/]+-?\\d{4,}")).otherwise(p)
    return F.array_join(F.transform(F.split(path, "/"), part), "/")


def link_shapes(links: DataFrame, path: Column, least: int = 3) -> DataFrame:
    """shape, n of paths whose mask has digits, most common first, from least occurrences on."""
    shaped = links.select(shape(path).alias("shape")).where(F.col("shape").contains("\\d") | F.col("shape").contains("[0-9a-f-]"))
    return shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "shape")


def verdict(error: Column, allowed: Column, status: Column, listed_complete: Column, links: Column, js_only: Column, samples: Column, usable: Column) -> Column:
    """The level of a source from what its pages show. A results page that publishes whole adverts needs no links and no
    samples; an HTTP status of 400 or more, or an error, tells nothing else."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", F.lit("echec")).when(~allowed, F.lit("interdit")).when(status >= 400, F.lit("echec"))
        .when(listed_complete > 0, F.lit("liste")).when((links == 0) & js_only, F.lit("js")).when(links == 0, F.lit("motif"))
        .when(samples == 0, F.lit("partiel")).when(usable == 0, F.lit("extraction")).when(usable < samples, F.lit("partiel")).otherwise(F.lit("ok"))
    )


def missing(samples: DataFrame, fields: tuple[str, ...] = CRITICAL, most: int = 4) -> DataFrame:
    """field, n of critical fields that samples lack, most often first: a report of the first four."""
    kinds = dict(samples.dtypes)
    one = samples.agg(*[F.count_if(~is_filled(f, kinds[f])).alias(f) for f in fields])
    return one.unpivot([], list(fields), "field", "n").where("n > 0").orderBy(F.desc("n"), "field").limit(most)


# ---------------------------------------------------------------- diagnosis

#: What to do at each level.
ACTIONS = {
    "ok": "mark the site as verified and scan it", "liste": "mark the site as verified: its results pages are enough", "partiel": "add selectors for the fields that samples lack", "extraction": "add selectors for the fields that samples lack",
    "motif": "set the link pattern from the address of an advert", "js": "use the site's own alerts or feed: its pages are filled by JavaScript", "interdit": "do not collect this address", "echec": "try again later",
}


def suggested_patterns(pages: DataFrame, least: int = 3) -> DataFrame:
    """url, suggested: the commonest shape with an identifier of each page's links to its own host, from least links on."""
    every = pg.links(pages).where(ul.host_of(F.col("link")) == ul.host_of(F.col("url")))
    shaped = every.select("url", shape(F.regexp_replace(ul.path_of(F.col("link")), "/+$", "")).alias("shape")).where(F.col("shape").contains("\\d"))
    counted = shaped.groupBy("url", "shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counted.groupBy("url").agg(F.max_by("shape", F.struct("n", "shape")).alias("suggested"))


def sampled(links: DataFrame, k: int) -> DataFrame:
    """k links of each page, the same ones on every run: those of the smallest hash."""
    turn = Window.partitionBy("url").orderBy(F.md5("link"), "link")
    return links.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k).drop("turn")


def diagnosis(results: DataFrame, adverts: DataFrame, as_of: Column, samples: int = 3) -> DataFrame:
    """One row for each results page (source, url, status, html, pattern, allowed, error) with level, action, links, suggested,
    listed, complete, samples, usable and missing (critical fields that samples or listed adverts lack).

    A page without links by its site's pattern is read again by the pattern that its links suggest. Adverts (url, status,
    html) are opened by sample; one that is not there, or not readable, is a sample that is not usable."""
    page = results.where(F.col("allowed") & F.col("error").isNull() & (F.col("status") < 400)).select("source", "url", "html", "pattern")
    lacks = lambda df: F.filter(F.array(*[F.when(~is_filled(c, k), F.lit(c)) for c, k in df.dtypes if c in CRITICAL]), lambda c: c.isNotNull())
    rows = pg.results_page(page, as_of)
    rows = rows.select("page", lacks(rows).alias("lacks"))
    listed = rows.groupBy("page").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.size("lacks") == 0).alias("complete"), F.flatten(F.collect_list("lacks")).alias("list_lacks"))
    own = pg.links(page, F.col("pattern"))
    without = page.join(own.select("url").distinct(), "url", "left_anti")
    guess = suggested_patterns(without)
    links = own.unionByName(pg.links(without.join(guess, "url"), F.col("suggested")))
    found = links.groupBy("url").agg(F.count(F.lit(1)).alias("links"))
    picked = sampled(links.select("url", "link"), samples)
    opened = adverts.select(F.col("url").alias("link"), F.col("status"), "html").join(picked.select("link").distinct(), "link", "left_semi").where("status < 400")
    read = pg.detail_page(opened.select(F.col("link").alias("url"), "html"), as_of)
    read = read.select(F.col("page").alias("link"), lacks(read).alias("lacks"))
    tried = picked.join(read, "link", "left").withColumn("lacks", F.coalesce("lacks", F.array(*map(F.lit, CRITICAL))))
    looked = tried.groupBy("url").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.size("lacks") == 0).alias("usable"), F.flatten(F.collect_list("lacks")).alias("sample_lacks"))  # few samples a page
    out = results.join(listed.withColumnRenamed("page", "url"), "url", "left").join(found, "url", "left").join(guess, "url", "left").join(looked, "url", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("listed", "complete", "links", "samples", "usable")})
    js = F.coalesce(F.exists(F.array(*map(F.lit, JS_MARKERS)), lambda m: F.contains("html", m)), F.lit(False))
    level = verdict(F.col("error"), F.col("allowed"), F.coalesce("status", F.lit(0)), F.col("complete"), F.col("links"), js, F.col("samples"), F.col("usable"))
    lacking = F.array_sort(F.array_distinct(F.coalesce(F.when(F.col("complete") > 0, F.col("list_lacks")).otherwise(F.col("sample_lacks")), F.array().cast("array<string>"))))
    todo = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return out.select("source", "url", level.alias("level"), F.element_at(todo, level).alias("action"), "links", "suggested", "listed", "complete", "samples", "usable", lacking.alias("missing"))
