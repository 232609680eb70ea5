"""Queries over price observations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.functions import urls as ul
from motorlens.functions import vocab as v
from motorlens.operators import history, profile, state
from motorlens.sources import pages as pg
from motorlens.sources.fixtures import observations, observations_sql
from motorlens.streaming import prices
from motorlens.streaming.folders import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(observations_sql() + " SELECT listing_id, arg_max(price_eur, (seen_at, event_id)) AS price_eur FROM obs GROUP BY listing_id")
def latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(observations(spark, sf_dir), ("listing_id",), ("seen_at", "event_id")).select("listing_id", "price_eur")


@query(observations_sql() + ", x AS (SELECT listing_id, arg_min(price_eur, (seen_at, event_id)) AS first_price, arg_max(price_eur, (seen_at, event_id)) AS last_price FROM obs GROUP BY listing_id) SELECT *, last_price < first_price - 1 AS dropped FROM x")
def price_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.first_and_last(observations(spark, sf_dir))


@query(observations_sql(True) + " SELECT event_id, listing_id, price_eur, previous FROM (SELECT *, lag(price_eur) OVER (PARTITION BY listing_id ORDER BY seen_at, event_id) AS previous FROM obs) WHERE previous IS NULL OR abs(price_eur - previous) > 1")
def price_changes_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.price_changes(observations(spark, sf_dir, True)).select("event_id", "listing_id", "price_eur", "previous")


_FOLD = observations_sql(True).replace("WITH", "WITH RECURSIVE") + """,
o AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY seen_at, event_id) AS rn FROM obs),
f AS (SELECT listing_id, rn, price_eur, event_id, price_eur AS held, true AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.listing_id, o.rn, o.price_eur, o.event_id, CASE WHEN abs(o.price_eur - f.held) > 1 THEN o.price_eur ELSE f.held END, abs(o.price_eur - f.held) > 1 FROM f JOIN o ON o.listing_id = f.listing_id AND o.rn = f.rn + 1)
SELECT listing_id, price_eur, event_id::BIGINT AS event_id FROM f WHERE kept"""


@query(_FOLD)
def price_history_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recorded_points(observations(spark, sf_dir, True)).select("listing_id", "price_eur", "event_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of observations."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(sf_dir))
    price = (1000 + F.floor("value") / 10).alias("price_eur")
    return raw.select(F.col("user_id").cast("long").alias("listing_id"), price, F.col("ts").cast("timestamp").alias("seen_at"), F.col("event_id").cast("long").alias("event_id")).where("event_id is not null")


@query(_FOLD)
def stream_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold as a stream over the events table, run until all is read."""
    return prices.follow_prices(_events(spark, sf_dir), shared_folder(spark, "stream")).select("listing_id", "price_eur", "event_id")


@query("WITH l AS (SELECT user_id AS listing_id, max(ts) AS last_seen FROM events GROUP BY user_id) SELECT listing_id::BIGINT AS listing_id, last_seen, false AS active FROM l WHERE last_seen + INTERVAL 6 HOUR + INTERVAL 10 MINUTE < (SELECT max(last_seen) FROM l)")
def stream_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that six hours without a sighting have ended, told by timers."""
    rows = prices.follow_activity(_events(spark, sf_dir), shared_folder(spark, "activity"), "6 hours", "10 minutes").where("not active")
    return rows.select("listing_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "active")


def _folder(sf_dir: str) -> str:
    """A stream reads folders or globs; the table may be one file or a folder."""
    return f"{sf_dir}/events.parque[t]"


@query("WITH o AS (SELECT o_orderkey % 3000 AS k, o_orderkey AS seen, o_totalprice AS price FROM orders) SELECT k, arg_max(price, seen) AS price FROM o GROUP BY k")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after two batches: orders taken as sightings of 3,000 adverts, old ones first."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 3000).alias("k"), F.col("o_orderkey").alias("seen"), F.col("o_totalprice").alias("price"))
    half = o.agg(F.expr("max(seen) div 2").alias("half"))
    o = o.crossJoin(F.broadcast(half))  # one row
    stored = state.latest(o.where("seen <= half").drop("half"), ("k",), ("seen",))
    return state.upsert(stored, o.where("seen > half").drop("half"), ("k",), "seen").select("k", "price")


@query("SELECT o_orderkey // 2 AS id, CASE WHEN NOT bool_or(o_orderkey % 2 = 1) THEN CASE WHEN (o_orderkey // 2) % 7 = 0 THEN 'photos' ELSE 'old' END WHEN bool_or(o_orderkey % 2 = 0) AND (o_orderkey // 2) % 7 = 0 AND (o_orderkey // 2) % 5 <> 0 THEN 'photos' ELSE 'new' END AS kind FROM orders GROUP BY o_orderkey // 2")
def protected_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all orders: even keys are the old analyses, odd keys the new ones."""
    k, n = F.col("o_orderkey"), F.expr("o_orderkey div 2")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    old = o.where(k % 2 == 0).select(n.alias("id"), F.when(n % 7 == 0, 4).otherwise(0).alias("photos"), F.when(n % 7 == 0, "photos").otherwise("old").alias("kind"))
    new = o.where(k % 2 == 1).select(n.alias("id"), F.when(n % 5 == 0, 3).otherwise(0).alias("photos"), F.lit("new").alias("kind"))
    return state.protect(old, new, "id").select("id", "kind")


# ---------------------------------------------------------------- pages

_TRACK = ", ".join(f"'{p}'" for p in v.TRACKING)
_PARTS = "SELECT page_id, url, regexp_replace(url, '#.*$', '') AS u FROM pages"


@query(f"WITH a AS ({_PARTS}), b AS (SELECT page_id, regexp_replace(u, '\\?.*$', '') AS base, list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT list_contains([{_TRACK}], lower(regexp_extract(p, '^([^=]*)', 1)))) AS kept FROM a) SELECT page_id, CASE WHEN len(kept) > 0 THEN base || '?' || array_to_string(kept, '&') ELSE base END AS url FROM b")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ul.canonical(F.col("url")).alias("url"))


@query(f"WITH a AS ({_PARTS}), b AS (SELECT page_id, regexp_extract(regexp_replace(regexp_extract(regexp_replace(u, '\\?.*$', ''), '://[^/]*(.*)$', 1), '/+$', ''), '([^/]*)$', 1) AS tail FROM a) SELECT page_id, CASE WHEN regexp_extract(tail, '([0-9]{{5,}})', 1) <> '' THEN regexp_extract(tail, '([0-9]{{5,}})', 1) ELSE tail END AS listing_id FROM b")
def listing_id_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ul.listing_id(F.col("url")).alias("listing_id"))


@query("SELECT page_id, coalesce(try_cast(regexp_extract(regexp_replace(url, '#.*$', ''), '[?&]page=([0-9]+)', 1) AS INT), 1) AS page_no FROM pages")
def page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ul.page_number(F.col("url")).alias("page_no"))


_HREF = "(?is)<a\\s[^>]*href\\s*=\\s*[\"'']([^\"''#][^\"'']*)[\"'']"
_LINKS = f"""WITH a AS (SELECT url, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href, generate_subscripts(regexp_extract_all(html, '{_HREF}', 1), 1) - 1 AS position FROM pages),
b AS (SELECT *, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS root, regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '://[^/]*(.*)$', 1), '[^/]*$', '') AS folder FROM a),
c AS (SELECT url, position, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z]+:)', 1) || href WHEN starts_with(href, '/') THEN root || href ELSE root || CASE WHEN folder = '' THEN '/' ELSE folder END || href END AS l FROM b),
d AS (SELECT url, position, regexp_replace(regexp_replace(l, '#.*$', ''), '\\?.*$', '') AS base, list_filter(string_split(regexp_extract(regexp_replace(l, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT list_contains([{_TRACK}], lower(regexp_extract(p, '^([^=]*)', 1)))) AS kept FROM c),
e AS (SELECT url, position, CASE WHEN len(kept) > 0 THEN base || '?' || array_to_string(kept, '&') ELSE base END AS link, regexp_extract(regexp_replace(regexp_extract(base, '://[^/]*(.*)$', 1), '/+$', ''), '([^/]*)$', 1) AS tail FROM d),
f AS (SELECT *, CASE WHEN regexp_extract(tail, '([0-9]{{5,}})', 1) <> '' THEN regexp_extract(tail, '([0-9]{{5,}})', 1) WHEN tail <> '' THEN tail ELSE link END AS listing_id FROM e WHERE regexp_matches(link, '^https?://'))
SELECT url, position::INT AS position, link, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY url, listing_id ORDER BY position) AS rn FROM f) WHERE rn = 1"""


@query(_LINKS)
def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(r"""WITH p AS (SELECT string_split(regexp_extract(regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', ''), '://[^/]*(.*)$', 1), '/') AS parts FROM pages),
s AS (SELECT array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '\d+' WHEN regexp_matches(x, '^[0-9a-f-]{30,}$') THEN '[0-9a-f-]{30,}' WHEN regexp_matches(x, '[0-9]{4,}') THEN '[^/]+-?\d{4,}' ELSE x END), '/') AS shape FROM p)
SELECT shape, count(*) AS n FROM s WHERE contains(shape, '\d') OR contains(shape, '[0-9a-f-]') GROUP BY shape HAVING count(*) >= 3""")
def link_shape_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.link_shapes(spark.read.parquet(f"{sf_dir}/pages.parquet"), ul.path_of(F.col("url")))


@query("WITH r AS (SELECT o_orderkey // 4000 * 20 + o_custkey % 20 AS search, o_orderkey // 20 AS page_no, o_orderkey % 20 AS position, (o_orderkey * 7) % 900 AS listing_id FROM orders), m AS (SELECT *, row_number() OVER (PARTITION BY search, listing_id ORDER BY page_no, position) = 1 AS fresh FROM r), s AS (SELECT search, min(page_no) AS stop FROM (SELECT search, page_no FROM m GROUP BY ALL HAVING count(*) FILTER (fresh) = 0) GROUP BY search), k AS (SELECT m.*, row_number() OVER (PARTITION BY search ORDER BY page_no, position) AS rn FROM m LEFT JOIN s USING (search) WHERE fresh AND (stop IS NULL OR page_no < stop)) SELECT search, listing_id FROM k WHERE rn <= 30")
def paginated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all orders: each 4,000 keys are the results of twenty searches more."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.expr("o_orderkey div 4000 * 20 + o_custkey % 20").alias("search"), F.expr("o_orderkey div 20").alias("page_no"), (F.col("o_orderkey") % 20).alias("position"), ((F.col("o_orderkey") * 7) % 900).alias("listing_id"))
    return pg.paginate(rows, 30).select("search", "listing_id")
