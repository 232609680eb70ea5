"""Queries over sites, robots rules, caches, adapters, diagnoses and model replies, built from the pages and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens import schemas as s
from motorlens.functions import urls as ul
from motorlens.operators import expert, profile, replies
from motorlens.sources import crawl
from motorlens.sources.fixtures import DUCK, as_of, listings, spread
from motorlens.streaming.folders import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


# ---------------------------------------------------------------- sites


@query("""WITH p AS (SELECT page_id, page_id % 5 AS kind, 'f' || lpad(page_id::VARCHAR, 9, '0') AS file FROM pages)
SELECT file, CASE WHEN kind IN (0, 1) THEN 'site' || page_id END AS name, CASE kind WHEN 0 THEN least(page_id % 30, 20) WHEN 1 THEN 3 END::INT AS max_pages, CASE kind WHEN 0 THEN 'BE DE' WHEN 1 THEN 'FR' END AS countries,
CASE kind WHEN 2 THEN 'no site file' WHEN 3 THEN 'without search_url, listing_link_pattern' WHEN 4 THEN 'named before in f' || lpad((page_id - 4)::VARCHAR, 9, '0') END AS error FROM p""")
def site_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site file for each page, in JSON and YAML, some broken, some that repeat a name."""
    i, host = F.col("page_id"), ul.host_of(F.col("url"))
    good = lambda n: F.concat(F.lit('{"name": "site'), n, F.lit('", "base_url": "https://'), host, F.lit('", "search_url": "https://x/{make}", "listing_link_pattern": "/d/[0-9]+", "countries": ["BE", "DE"], "max_pages": '), i % 30, F.lit("}"))
    yaml = F.concat(F.lit("# a site\nname: site"), i, F.lit("\nsearch_url: 'https://x/{make}?page={page}'\nlisting_link_pattern: /d/\\d+\ncountries: [FR]\nselectors:\n  price: .price\n"))
    text = F.when(i % 5 == 0, good(i)).when(i % 5 == 1, yaml).when(i % 5 == 2, F.lit("{name: [")).when(i % 5 == 3, F.lit('{"name": "x"}')).otherwise(good(i - 4))
    got = crawl.sites(_pages(spark, sf_dir).select(F.concat(F.lit("f"), F.lpad(i.cast("string"), 9, "0")).alias("file"), text.alias("text")))
    return got.select("file", "name", "max_pages", F.array_join("countries", " ").alias("countries"), "error")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) SELECT page_id, CASE WHEN regexp_matches(host, '(^|[.])spam-?farm[.]') THEN 'spam-farm' WHEN regexp_matches(host, '(^|[.])cheap-?pills[.]') THEN 'pills' WHEN regexp_matches(host, '(^|[.])example[.]') THEN 'exa-mple' END AS source FROM p""")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by name or by base address; the longest label wins."""
    known = spark.createDataFrame([("exa-mple", None), ("pills", "https://www.cheap-pills.com"), ("spam-farm", "http://m.spamfarm.de:80/x"), ("blog-x", "https://nowhere.fr")], "name string, base_url string")
    return crawl.source_names(_pages(spark, sf_dir).select("page_id", "url"), known).select("page_id", "source")


_SITES = [
    ("s0", "https://s0.de/{country}/{make}/?price={price_max}&page={page}", {"DE": "D"}, "page", 3), ("s1", "https://s1.de/suche?make={make}&km={km_max}&p={page}", None, "p", 2), ("s2", "https://s2.de/{make}?page=7", None, "page", 2),
]


@query("""WITH q AS (SELECT o_orderkey AS k, 's' || o_orderkey % 3 AS source, CASE o_orderkey % 4 WHEN 0 THEN 'alfa-romeo' WHEN 1 THEN 'bmw' ELSE '' END AS make, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1000 + o_orderkey END AS price, CASE WHEN o_orderkey % 5 = 0 THEN 'D' ELSE 'FR' END AS country FROM orders),
f AS (SELECT *, CASE source WHEN 's0' THEN 'https://s0.de/' || country || CASE WHEN make = '' THEN '' ELSE '/' || make END || '?' || CASE WHEN price IS NULL THEN '' ELSE 'price=' || price || '&' END WHEN 's1' THEN 'https://s1.de/suche?' || CASE WHEN make = '' THEN '' ELSE 'make=' || make || '&' END ELSE 'https://s2.de' || CASE WHEN make = '' THEN '' ELSE '/' || make END || '?' END AS head,
CASE source WHEN 's1' THEN 'p=' ELSE 'page=' END AS param, CASE source WHEN 's2' THEN 7 ELSE 1 END AS start, CASE source WHEN 's0' THEN 3 ELSE 2 END AS n FROM q)
SELECT k AS query_id, source, (start + o)::INT AS page_no, head || param || (start + o) AS url FROM f, range(3) t(o) WHERE o < n""")
def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks one site; templates have codes of countries, page parameters and first pages of their own."""
    known = spark.createDataFrame([(n, u, c, p, m, None) for n, u, c, p, m in _SITES], "name string, search_url string, country_codes map<string, string>, page_param string, max_pages int, error string")
    k = F.col("o_orderkey")
    asked = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")).select(
        k.alias("query_id"), F.concat(F.lit("s"), k % 3).alias("source"), F.when(k % 4 == 0, "Alfa Romeo").when(k % 4 == 1, "BMW").alias("make"), F.when(k % 7 != 0, 1000 + k).cast("string").alias("price_max"), F.when(k % 5 == 0, "de").alias("country")
    )
    return crawl.requests(known, asked).select("query_id", "source", "page_no", "url")


# ---------------------------------------------------------------- robots, cache, adapters

_ALL = "User-agent: *\nDisallow: /en/  # not these\nAllow: /en/4\nDisallow: /*.html$\nCrawl-delay: 2\n\nUser-agent: badbot\nDisallow: /\n"
_NAMED = "user-agent: other\nUser-Agent: motorlens\nDisallow: /fr\nDisallow: /*?page=\nAllow: /fr/1*\nDisallow: /es/\nAllow: /es/\nDisallow:\nCrawl-delay: 9\nCrawl-delay: 4\n\nUser-agent: *\nDisallow: /\n"


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots files by the length of the host's name: for everyone, by name, none."""
    hosts = _pages(spark, sf_dir).select(ul.host_of(F.col("url")).alias("host")).distinct()
    text = F.when(F.length("host") % 3 == 0, F.lit(_ALL)).when(F.length("host") % 3 == 1, F.lit(_NAMED))
    return crawl.robots_rules(hosts.select("host", text.alias("text")).where("text is not null"))


@query("""WITH p AS (SELECT page_id, length(lower(regexp_extract(url, '://([^/?#]*)', 1))) % 3 AS kind, regexp_extract(regexp_replace(url, '#.*$', ''), '://[^/]*(.*)$', 1) AS path FROM pages)
SELECT page_id, CASE kind WHEN 0 THEN CASE WHEN regexp_matches(path, '[.]html$') THEN false WHEN starts_with(path, '/en/4') THEN true ELSE NOT starts_with(path, '/en/') END
WHEN 1 THEN CASE WHEN contains(path, '?page=') THEN false WHEN starts_with(path, '/fr/1') THEN true WHEN starts_with(path, '/es/') THEN true ELSE NOT starts_with(path, '/fr') END ELSE true END AS allowed FROM p""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.robots_allowed(_pages(spark, sf_dir).select("page_id", "url"), _robots(spark, sf_dir), "motorlens/1.0").select("page_id", "allowed")


@query("SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, CASE length(lower(regexp_extract(url, '://([^/?#]*)', 1))) % 3 WHEN 0 THEN 2.5 ELSE 9.0 END::DOUBLE AS delay FROM pages WHERE length(lower(regexp_extract(url, '://([^/?#]*)', 1))) % 3 < 2")
def robots_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_delays(_robots(spark, sf_dir), "motorlens", 2.5)


@query("""WITH k AS (SELECT url, CASE WHEN count(*) FILTER (page_id % 4 = 3) > 0 THEN 3 WHEN count(*) FILTER (page_id % 4 = 1) > 0 THEN 1 WHEN count(*) FILTER (page_id % 4 = 2) > 0 THEN 2 ELSE 0 END AS kind, max(html || '+') FILTER (page_id % 4 = 1) AS renewed FROM pages WHERE url IS NOT NULL GROUP BY url)
SELECT page_id, coalesce(kind = 1, false) AS hit, CASE kind WHEN 1 THEN length(renewed) END AS size, coalesce(kind IN (1, 2), false) AS hit_any_age, coalesce(kind = 2, false) AS hit_before FROM pages LEFT JOIN k USING (url)""")
def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads, the first of which comes again: pages are too old, renewed, not there, or read after the time asked for. Pages
    of one URL share what was read last."""
    cache, i = crawl.PageCache(spark, shared_folder(spark, "pages"), 16), F.col("page_id")
    pages = _pages(spark, sf_dir)
    load = lambda rows, html, at: rows.select("url", F.lit(200).alias("status"), html.alias("html"), F.lit(at).cast("timestamp").alias("fetched_at"))
    first = load(pages.where(i % 4 != 3).where(i % 4 != 0), F.col("html"), "2026-01-01 00:00:00")
    second = load(pages.where(i % 4 == 1), F.concat("html", F.lit("+")), "2026-01-01 10:00:00").unionByName(load(pages.where(i % 4 == 3), F.col("html"), "2026-01-02 00:00:00"))
    cache.load(0, first)
    cache.load(1, second)
    cache.load(0, first)
    at = lambda t: F.lit(t).cast("timestamp")
    wanted = pages.select("page_id", "url")
    got = cache.look_up(wanted, at("2026-01-01 15:00:00"), 12).select("page_id", "hit", F.length("html").alias("size"))
    old = cache.look_up(wanted, at("2026-01-01 15:00:00"), None).select("page_id", F.col("hit").alias("hit_any_age"))
    early = cache.look_up(wanted, at("2026-01-01 09:00:00"), 12).select("page_id", F.col("hit").alias("hit_before"))
    return got.join(old, "page_id").join(early, "page_id")


def _one(url: str, html: str) -> list[dict]:
    return [{"url": url, "size": len(html)}]


def _broken(url: str, html: str) -> list[dict]:
    raise ValueError("the page has changed")


def _partly(url: str, html: str) -> list[dict]:
    if "/es/" in url:
        raise KeyError("price")
    return [{"url": url}, {"url": url + "#2"}]


@query("""WITH p AS (SELECT CASE WHEN contains(url, '://blog.') THEN 'blog' ELSE regexp_extract(url, 'example[.]([a-z]+)', 1) END AS source, url FROM pages)
SELECT source, count(*) AS pages, sum(CASE source WHEN 'com' THEN 1 WHEN 'org' THEN CASE WHEN contains(url, '/es/') THEN 0 ELSE 2 END ELSE 0 END)::BIGINT AS listings, count(*) FILTER (source IN ('net', 'blog') OR source = 'org' AND contains(url, '/es/')) AS failed,
any_value(CASE source WHEN 'net' THEN 'ValueError: the page has changed' WHEN 'org' THEN CASE WHEN contains(url, '/es/') THEN 'KeyError: ''price''' END WHEN 'blog' THEN 'KeyError: "no source ''blog''"' END) AS error FROM p GROUP BY source""")
def sources_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One adapter reads, one breaks on every page, one on some, and one source has none."""
    source = F.when(F.col("url").contains("://blog."), "blog").otherwise(F.regexp_extract("url", "example[.]([a-z]+)", 1))
    pages = spread(_pages(spark, sf_dir).select(source.alias("source"), "url", "html"))
    got = crawl.extract(pages, {"com": _one, "net": _broken, "org": _partly})
    read = got.groupBy(F.col("source").alias("_source")).agg(F.count("listing").alias("listings"), F.count("error").alias("failed"), F.max("error").alias("error"))
    # Counted before they are read: a page may give several adverts, and pages may share a URL.
    each = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    return each.join(read, F.col("source").eqNullSafe(F.col("_source"))).select("source", "pages", "listings", "failed", "error")


# ---------------------------------------------------------------- diagnosis

#: Adverts of a source, and what its pages are like: a level of each kind, and one whose pattern must be suggested.
_EACH, _KINDS = 10, ("ok", "liste", "partiel", "extraction", "motif", "js", "interdit", "echec", "suggested")


def _diagnosed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey").cast("long")
    a = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"))).withColumns({"src": F.expr(f"id div {_EACH}"), "kind": F.expr(f"(id div {_EACH}) % {len(_KINDS)}")})
    kind = lambda *names: F.col("kind").isin(*[_KINDS.index(n) for n in names])
    n = F.col("id") + 1000000
    path = F.when(kind("suggested"), F.concat(F.lit("/annonce/golf-"), n)).otherwise(F.concat(F.lit("/auto/"), n))
    node = F.concat(F.lit('{"@type":"Car","name":"Golf '), F.col("id"), F.lit('","brand":"Volkswagen","modelDate":"2018","mileageFromOdometer":5000,"offers":{"price":9000}'))
    item = F.concat(node, F.lit(',"url":"'), path, F.lit('"}'))
    link = F.when(kind("motif") & (F.col("id") % _EACH > 1) | kind("js"), F.lit(None)).when(kind("motif"), F.lit('<a href="/about/us">x</a>')).otherwise(F.concat(F.lit('<a href="'), path, F.lit('?ref=x">x</a>')))
    whole = a.groupBy("src", "kind").agg(F.concat_ws("", F.collect_list(F.when(~kind("liste"), link))).alias("links"), F.concat_ws(",", F.collect_list(F.when(kind("liste"), item))).alias("items"))
    html = F.concat(F.lit("<html>"), F.col("links"), F.when(kind("liste"), F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":['), F.col("items"), F.lit("]}</script>"))).otherwise(""), F.when(kind("js"), F.lit('<script id="__NEXT_DATA__">{}</script>')).otherwise(""), F.lit("</html>"))
    host = F.concat(F.lit("https://s"), F.col("src"), F.lit(".de"))
    results = whole.select("src", F.col("src").cast("string").alias("source"), F.concat(host, F.lit("/suche")).alias("url"), F.when(kind("echec"), 503).otherwise(200).alias("status"), html.alias("html"), F.lit("/auto/\\d+").alias("pattern"), F.lit(None).cast("string").alias("error"))
    rules = crawl.robots_rules(whole.where(kind("interdit")).select(F.concat(F.lit("s"), F.col("src"), F.lit(".de")).alias("host"), F.lit("User-agent: *\nDisallow: /suche").alias("text")))
    results = crawl.robots_allowed(results, rules, "motorlens").drop("src")
    poor = kind("extraction") | kind("partiel") & (F.col("id") % 2 == 0)
    page = F.when(poor, F.lit("<html>nothing</html>")).otherwise(F.concat(F.lit('<script type="application/ld+json">'), node, F.lit("}</script>")))
    return results, a.select(F.concat(host, path).alias("url"), F.lit(200).alias("status"), page.alias("html"))


@query(f"""WITH a AS (SELECT o_orderkey::BIGINT AS id, o_orderkey // {_EACH} AS src, o_orderkey // {_EACH} % {len(_KINDS)} AS kind FROM orders), b AS (SELECT *, 'https://s' || src || '.de' || CASE kind WHEN 8 THEN '/annonce/golf-' ELSE '/auto/' END || (1000000 + id) AS link, kind = 3 OR kind = 2 AND id % 2 = 0 AS poor FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5(link), link) <= 3 AS picked FROM b),
d AS (SELECT src, kind, count(*) AS n, count(*) FILTER (picked) AS samples, count(*) FILTER (picked AND NOT poor) AS usable FROM c GROUP BY ALL),
e AS (SELECT *, CASE WHEN kind IN (0, 2, 3) OR kind = 8 AND n >= 3 THEN n ELSE 0 END AS links FROM d), f AS (SELECT *, CASE kind WHEN 1 THEN 'liste' WHEN 4 THEN 'motif' WHEN 5 THEN 'js' WHEN 6 THEN 'interdit' WHEN 7 THEN 'echec' ELSE CASE WHEN links = 0 THEN 'motif' WHEN usable = 0 THEN 'extraction' WHEN usable < samples THEN 'partiel' ELSE 'ok' END END AS level FROM e)
SELECT src::VARCHAR AS source, level, links, CASE WHEN kind = 8 AND n >= 3 THEN '/annonce/[^/]+-?\\d{{4,}}' END AS suggested, CASE kind WHEN 1 THEN n ELSE 0 END AS listed, CASE WHEN links > 0 THEN samples ELSE 0 END AS samples, CASE WHEN links > 0 THEN usable ELSE 0 END AS usable,
CASE WHEN links > 0 AND usable < samples THEN 'km make price year' ELSE '' END AS missing FROM f""")
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of many sources is worth; all levels arise from its pages."""
    results, adverts = _diagnosed(spark, sf_dir)
    got = profile.diagnosis(results, adverts, as_of())
    return got.select("source", "level", "links", "suggested", "listed", "samples", "usable", F.array_join("missing", " ").alias("missing"))


# ---------------------------------------------------------------- model replies

GOOD_REPLY = '{"summary":"fine","condition_score":80,"consistency_score":50,"photo_findings":[],"red_flags":[{"label":"rust","severity":"serieux","evidence":"photo 1","estimated_cost_eur":300}],"strengths":["one owner"],"known_issues_to_check":[],"questions_to_seller":[],"negotiation_levers":[],"estimated_repairs_eur":300,"verdict":"avoid","confidence":70}'
_BODIES = [
    GOOD_REPLY, None, GOOD_REPLY[:200], GOOD_REPLY[:-20], GOOD_REPLY.replace('"verdict":"avoid",', ""), GOOD_REPLY.replace('"condition_score":80', '"condition_score":180'), GOOD_REPLY.replace('"condition_score":80', '"condition_score":"good"'), GOOD_REPLY.replace("serieux", "huge"),
    GOOD_REPLY.replace('"avoid"', '"maybe"'), GOOD_REPLY.replace('"red_flags":[{', '"red_flags":[null,{'),
]
_REASONS = [None, "refused by the model", "reply cut off", "reply is no JSON", "lacks verdict", "condition_score out of range", "condition_score of another type", "unknown severity", "unknown verdict", "unknown severity"]


@query(DUCK + f""" SELECT id, CASE WHEN id % 11 = 0 THEN 'm' ELSE 'rules' END AS model, CASE WHEN id % 11 = 0 THEN 'avoid' END AS told, CASE WHEN id % 11 = 0 THEN 35 END AS risk, CASE WHEN id % 11 = 0 THEN 3 ELSE 0 END AS photos, {"CASE id % 11 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_REASONS) if r) + " END"} AS degraded_reason,
CASE WHEN id % 11 = 0 THEN round((id % 9000 * {s.DEFAULT_PRICE[0]} + 100 * {s.DEFAULT_PRICE[1]}) / 1e6 * {s.USD_TO_EUR}::DOUBLE, 4) ELSE 0 END AS cost_eur FROM listings""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, refused, cut, broken and false replies, and adverts that were not asked about; each falls back by itself."""
    i, n = F.col("id"), len(_BODIES)
    df = listings(spark, sf_dir).withColumns({"title": F.concat_ws(" ", "make", "model", "year"), "version": F.lit(None).cast("string"), "delta_pct": F.lit(None).cast("double"), "comps_count": F.lit(None).cast("int")})
    told = df.where(i % (n + 1) < n).select(
        "id", F.when(i % (n + 1) == 1, "refusal").when(i % (n + 1) == 2, "max_tokens").otherwise("end_turn").alias("stop_reason"), F.element_at(F.array(*map(F.lit, _BODIES)), (i % (n + 1) + 1).cast("int")).alias("body"),
        (i % 9000).alias("input_tokens"), F.lit(100).alias("output_tokens"), F.lit("m").alias("model"), F.lit(3).alias("photos"),
    )
    got = replies.applied(expert.report(df, as_of()).select("id", "report"), told)
    mine = F.col("read_by") == "m"
    return got.select("id", F.col("read_by").alias("model"), F.when(mine, F.col("report.verdict")).alias("told"), F.when(mine, F.col("report.risk_score")).alias("risk"), F.col("photos_analyzed").alias("photos"), "degraded_reason", "cost_eur")


@query(DUCK + """ SELECT id, '# Car' || chr(10) || 'make: ' || make || chr(10) || 'model: ' || model || chr(10) || 'year: ' || year || chr(10) || 'km: ' || replace(format('{:,}', km), ',', ' ') || chr(10) || 'fuel: ' || fuel || chr(10) || 'gearbox: ' || gearbox || chr(10) || 'power (hp): ' || power_hp
|| CASE WHEN price_eur IS NULL THEN '' ELSE chr(10) || 'asking price (EUR): ' || replace(format('{:,}', price_eur::BIGINT), ',', ' ') END || CASE WHEN seller_type = 'unknown' THEN '' ELSE chr(10) || 'seller: ' || seller_type END || chr(10) || 'country: ' || country || chr(10) || chr(10) || '# Advert' || chr(10) || make || ' ' || year || chr(10) || '(no description)' || chr(10) || chr(10)
|| CASE WHEN id % 2 = 0 THEN '# Market' || chr(10) || 'fair price (EUR): 12 000' || chr(10) || 'range (EUR): 11 000 to 13 000' || chr(10) || 'comparables: 7, confidence 0.5' || chr(10) || chr(10) ELSE '' END || '# Photos' || chr(10) || CASE WHEN id % 3 = 0 THEN 'none: judge by the text and be less sure' ELSE (id % 3) || ' attached, counted from 0' END AS dossier FROM listings""")
def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be sent for each advert, here for adverts without wording."""
    i, even = F.col("id"), F.col("id") % 2 == 0
    df = listings(spark, sf_dir).withColumns({
        "title": F.concat_ws(" ", "make", "year"), "description": F.lit(""), "comps_count": F.when(even, 7), "fair_price_eur": F.lit(12000.0), "low_eur": F.lit(11000.0), "high_eur": F.lit(13000.0), "confidence": F.lit(0.5),
        "signals": F.expr("cast(array() as array<struct<polarity:string,label:string,evidence:string>>)"), "defects": F.expr("cast(array() as array<struct<title:string,verify:string>>)"),
    })
    return df.select("id", replies.dossier(i % 3).alias("dossier"))
