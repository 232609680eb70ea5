"""Sites and what is read from them, as tables: site files, requests for searches, robots rules, a page cache, and adapters
whose failures are rows.

Nothing here opens a connection. Pages come from a table, or from a function of the caller's (:class:`SiteSource`, a data
source with one partition for each run of pages of a site); one that fails leaves a row with its error and stops nothing.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from motorlens.functions import text as tx
from motorlens.functions import urls as ul
from motorlens.streaming.store import Store

# ---------------------------------------------------------------- site files

SITE = (
    "name string, label string, base_url string, countries array<string>, country_codes map<string, string>, default_country string, search_url string, page_param string, "
    "max_pages int, listing_link_pattern string, selectors map<string, string>, requires_js boolean"
)
NEEDED = ("name", "search_url", "listing_link_pattern")
MAX_PAGES, DEFAULT_PAGES = 20, 3


def _as_json(text: str | None) -> str | None:
    """A site file, JSON or YAML, as one JSON object; NULL if it is none."""
    try:
        import yaml
    except ImportError:  # JSON files alone, then
        yaml = None
    try:
        found = json.loads(text) if (text or "").lstrip().startswith("{") or yaml is None else yaml.safe_load(text)
    except Exception:  # whatever is wrong with one file is told in its row
        return None
    return json.dumps(found, default=str) if isinstance(found, dict) else None


def sites(files: DataFrame) -> DataFrame:
    """file, the columns of SITE, error, from site files (file, text). A file that cannot be read, lacks what is needed or
    names a site that an earlier file names has an error and no site."""
    run = F.arrow_udf(lambda texts: pa.array([_as_json(t) for t in texts.to_pylist()], pa.string()), "string")
    read = files.select("file", run(F.col("text")).alias("json")).withColumn("site", F.from_json("json", SITE))
    site = F.col("site")
    open_ = F.array_join(F.filter(F.array(*[F.when(F.coalesce(site[c], F.lit("")) == "", F.lit(c)) for c in NEEDED]), lambda c: c.isNotNull()), ", ")
    read = read.withColumn("error", F.when(F.col("json").isNull(), "no site file").when(open_ != "", F.concat(F.lit("without "), open_)))
    firsts = read.where("error is null").groupBy(site["name"].alias("name_")).agg(F.min("file").alias("first_"))
    both = read.join(firsts, site["name"] == F.col("name_"), "left")
    error = F.coalesce("error", F.when(F.col("file") != F.col("first_"), F.concat(F.lit("named before in "), F.col("first_"))))
    both = both.select("file", "site", error.alias("error")).withColumn("site", F.when(F.col("error").isNull(), site))
    with_defaults = {"max_pages": F.least(F.coalesce(F.col("max_pages"), F.lit(DEFAULT_PAGES)), F.lit(MAX_PAGES)), "page_param": F.coalesce("page_param", F.lit("page")), "default_country": F.coalesce("default_country", F.lit("FR"))}
    out = both.select("file", "site.*", "error")
    return out.withColumns({c: F.when(F.col("error").isNull(), e) for c, e in with_defaults.items()})


def source_names(urls: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """urls with source: the site whose name or base address shares a label with the URL's host; the longest label wins.

    known: name, base_url. Labels join, so each URL meets the few sites of its labels."""
    labels = lambda host: F.filter(F.transform(F.split(host, "\\."), lambda x: F.replace(x, F.lit("-"))), lambda x: x != "")
    plain = lambda host, out: F.filter(labels(host), lambda x: ~x.isin(*out))
    names = known.select("name", F.explode(F.array_distinct(F.concat(F.array(F.replace("name", F.lit("-"))), plain(F.coalesce(ul.host_of(F.col("base_url")), F.lit("")), ("www", "com", "fr", "de"))))).alias("label"))
    mine = urls.select(F.col(url).alias("_k")).distinct().select("_k", F.explode(F.array_distinct(plain(F.regexp_replace(ul.host_of(F.col("_k")), ":.*$", ""), ("www", "m")))).alias("label"))
    best = mine.join(names, "label").groupBy("_k").agg(F.max_by("name", F.struct(F.length("label"), "name")).alias("source"))
    return urls.join(best, F.col(url) == F.col("_k"), "left").drop("_k")


# ---------------------------------------------------------------- requests


def requests(known: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, source, page_no, url: the results pages to read for each query (query_id, source and any of country, make,
    model, keywords, price_min, ... as text). Codes of countries are the site's own. Parameters without a value go."""
    fields = ("make", "model", "keywords", "price_min", "price_max", "year_min", "year_max", "km_max", "postcode", "radius")
    # Sites are few and have no figures of their size: without the hint queries travel, to as many tasks as there are sites.
    q = queries.join(F.broadcast(known.where("error is null").withColumnRenamed("name", "source")), "source")
    country = F.upper(F.coalesce(F.col("country"), F.lit("FR"))) if "country" in queries.columns else F.lit("FR")
    url = F.replace("search_url", F.lit("{country}"), F.coalesce(F.try_element_at("country_codes", country), country))
    for name in fields:
        value = F.col(name).cast("string") if name in queries.columns else F.lit(None).cast("string")
        value = tx.slugify(value) if name in ("make", "model") else value
        url = F.replace(url, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    url = F.regexp_replace(F.replace(url, F.lit("{page}"), F.lit("1")), "(?<=[?&])[\\w\\[\\]%.-]+=(?=&|$)", "")
    url = F.regexp_replace(F.regexp_replace(url, "\\?&+", "?"), "&{2,}", "&")
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "(?<!:)/{2,}", "/"), "/+\\?", "?"), "[?&/]+$", "")
    pages = q.select("query_id", "source", "page_param", url.alias("first"), F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("max_pages"))), lambda o: o < F.col("max_pages"))).alias("offset"))
    return pages_from(pages)


def pages_from(pages: DataFrame) -> DataFrame:
    """pages (first, page_param, offset) with page_no and url: the first URL as it is, later ones with its page number moved on."""
    known = F.regexp_extract(F.concat(F.lit("&"), ul.query_of(F.col("first"))), "&page=(\\d+)", 1)
    other = F.expr("regexp_extract(concat('&', regexp_extract(first, '[?]([^#]*)', 1)), concat('&', page_param, '=([0-9]+)'), 1)")
    start = F.greatest(F.lit(1), F.coalesce(F.when(F.col("page_param") == "page", known).otherwise(other).try_cast("int"), F.lit(1)))
    kept = F.filter(F.split(ul.query_of(F.col("first")), "&"), lambda p: (p != "") & ~p.startswith(F.concat("page_param", F.lit("="))))
    number = (start + F.col("offset")).cast("int")
    later = F.concat(F.regexp_replace(ul.without_fragment(F.col("first")), "\\?.*$", ""), F.lit("?"), F.array_join(F.concat(kept, F.array(F.concat("page_param", F.lit("="), number))), "&"))
    return pages.withColumn("page_no", number).withColumn("url", F.when(F.col("offset") == 0, F.col("first")).otherwise(later)).drop("first", "page_param", "offset")


# ---------------------------------------------------------------- robots


def robots_rules(texts: DataFrame) -> DataFrame:
    """host, agent, kind (allow, disallow, crawl-delay), value of every rule in robots files (host, text), for each agent of
    its group. A group's agents are the User-agent lines before its first rule."""
    lines = F.transform(F.split("text", "\\r?\\n|\\r"), lambda t: F.trim(F.regexp_replace(t, "#.*$", "")))
    step = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("ruled"), F.array().cast("array<struct<agents:array<string>,kind:string,value:string>>").alias("out"))

    def add(at: Column, line: Column) -> Column:
        kind, value = F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
        agents = F.when(at["ruled"], F.array(F.lower(value))).otherwise(F.concat(at["agents"], F.array(F.lower(value))))
        rule = kind.isin("allow", "disallow", "crawl-delay")
        return (
            F.when(kind == "user-agent", F.struct(agents.alias("agents"), F.lit(False).alias("ruled"), at["out"].alias("out")))
            .when(rule, F.struct(at["agents"].alias("agents"), F.lit(True).alias("ruled"), F.concat(at["out"], F.array(F.struct(at["agents"].alias("agents"), kind.alias("kind"), value.alias("value")))).alias("out")))
            .otherwise(at)
        )

    rules = texts.select("host", F.inline(F.aggregate(lines, step, add, lambda at: at["out"])))
    return rules.select("host", F.explode("agents").alias("agent"), "kind", "value").where("value <> ''")


def mine(rules: DataFrame, agent: str) -> DataFrame:
    """The rules that an agent follows at each host: those of its own name, else those of every agent (*)."""
    named = rules.where(F.lit(agent.lower()).startswith(F.col("agent")) & (F.col("agent") != "")).select("host", "agent")
    chosen = named.groupBy("host").agg(F.max_by("agent", F.length("agent")).alias("agent_"))
    both = rules.join(chosen, "host", "left")
    return both.where(F.col("agent") == F.coalesce("agent_", F.lit("*"))).drop("agent_", "agent")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """urls with allowed: the longest rule that fits path and query decides, allow before disallow on ties; without one, and
    without a robots file, everything is allowed.

    A rule is filed under the folder of its part before the first wildcard. A URL looks under the folders of its own path,
    so it meets the rules that may fit and no others, however long a host's list is."""
    own = mine(rules, agent).where("kind <> 'crawl-delay'")
    fixed = F.regexp_extract("value", "^[^*$]*", 0)
    regex = F.concat(F.lit("^\\Q"), F.replace(F.replace(F.regexp_replace("value", "\\$$", ""), F.lit("\\E"), F.lit("")), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"), F.when(F.col("value").endswith("$"), "$").otherwise(""))
    filed = own.select("host", F.regexp_extract(fixed, "^.*/", 0).alias("folder"), regex.alias("regex"), F.length("value").alias("size"), (F.col("kind") == "allow").alias("allow"))
    path = F.concat(F.when(ul.path_of(F.col("_k")) == "", "/").otherwise(ul.path_of(F.col("_k"))), F.regexp_extract(ul.without_fragment(F.col("_k")), "\\?.*$", 0))
    each = urls.select(F.col(url).alias("_k")).distinct()
    parts = F.split(F.regexp_replace("_path", "\\?.*$", ""), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i < F.size(parts), F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))).otherwise(F.lit("")))
    looked = each.select("_k", ul.host_of(F.col("_k")).alias("host"), path.alias("_path")).withColumn("folder", F.explode(folders))
    hits = looked.join(filed, ["host", "folder"]).where(F.expr("_path rlike regex")).groupBy("_k").agg(F.max_by("allow", F.struct("size", "allow")).alias("allow"))
    return urls.join(hits, F.col(url) == F.col("_k"), "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("_k", "allow")


def crawl_delays(rules: DataFrame, agent: str, least: float) -> DataFrame:
    """host, delay: seconds between requests, the host's largest or our own if that is longer."""
    said = mine(rules, agent).where("kind = 'crawl-delay'").groupBy("host").agg(F.max(F.expr("try_cast(value AS double)")).alias("said"))
    return rules.select("host").distinct().join(said, "host", "left").select("host", F.greatest(F.coalesce("said", F.lit(0.0)), F.lit(least)).alias("delay"))


# ---------------------------------------------------------------- page cache

PAGE = "url string, status int, html string, fetched_at timestamp"


class PageCache:
    """Pages as they were last read, in buckets by their URL; a load is applied once and rewrites the buckets it meets."""

    def __init__(self, spark, root: str, buckets: int = 64):
        self.store = Store(spark, root, ("url",), PAGE, buckets)

    def load(self, number: int, pages: DataFrame) -> bool:
        """Keep pages (PAGE), the newest of each URL; of several read at one time, that of the largest status and html."""
        newest = lambda df: df.groupBy("url").agg(F.max(F.struct("fetched_at", "status", "html")).alias("r")).select("url", "r.*")
        return self.store.apply("pages", number, pages, lambda old, new: newest(old.unionByName(new.select(*old.columns))))

    def look_up(self, wanted: DataFrame, at: Column, ttl_hours: float | None) -> DataFrame:
        """wanted (url, ...) with status, html, fetched_at of pages that are in the cache at a time and no older than ttl_hours
        (None: any age), and hit."""
        held = self.store.read().where(F.col("fetched_at") <= at)
        if ttl_hours is not None:
            held = held.where(F.unix_micros(at) - F.unix_micros("fetched_at") <= int(ttl_hours * 3_600_000_000))
        return wanted.join(held.withColumn("hit", F.lit(True)), "url", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


# ---------------------------------------------------------------- adapters


def extract(pages: DataFrame, adapters: dict[str, Callable[[str, str], list[dict]]]) -> DataFrame:
    """source, url, listing (JSON, one row for each advert), error: what the adapter of each page's source reads from it.

    pages: source, url, html. An adapter that raises, and a source without one, leave a row with the error; the other pages
    of the batch are read all the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, url, html in zip(*(b.column(c).to_pylist() for c in range(3))):
                try:
                    if source not in adapters:
                        raise KeyError(f"no source {source!r}")
                    rows += [(source, url, json.dumps(x, default=str), None) for x in adapters[source](url, html or "")]
                except Exception as e:  # one broken source stops nothing
                    rows.append((source, url, None, f"{type(e).__name__}: {e}"[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["source", "url", "listing", "error"])

    return pages.select("source", "url", "html").mapInArrow(run, "source string, url string, listing string, error string")


class Run(InputPartition):
    def __init__(self, source: str, urls: list[str]):
        self.source, self.urls = source, urls


class _Reader(DataSourceReader):
    def __init__(self, runs: list[Run], getter: str, only: str | None):
        self.runs, self.getter, self.only = runs, getter, only

    def pushFilters(self, filters):
        """source = ... decides which runs are read at all."""
        for f in filters:
            if type(f).__name__ == "EqualTo" and tuple(f.attribute) == ("source",):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[Run]:
        return [r for r in self.runs if self.only is None or r.source == self.only] or [Run("", [])]

    def read(self, run: Run) -> Iterator[tuple]:
        module, _, name = self.getter.partition(":")
        get = getattr(importlib.import_module(module), name)
        for url in run.urls:
            try:
                yield run.source, url, get(url), None
            except Exception as e:  # a page that fails is a row
                yield run.source, url, None, f"{type(e).__name__}: {e}"[:200]


class SiteSource(DataSource):
    """Pages of sites: spark.read.format("motor_sites"). Options: requests, a JSON object of source: list of URLs; getter,
    "module:function" of what returns the html of a URL on an executor; run, pages of a partition (20)."""

    @classmethod
    def name(cls) -> str:
        return "motor_sites"

    def schema(self) -> str:
        return "source string, url string, html string, error string"

    def reader(self, schema) -> _Reader:
        size = int(self.options.get("run", 20))
        asked = json.loads(self.options["requests"])
        return _Reader([Run(s, urls[i : i + size]) for s, urls in asked.items() for i in range(0, len(urls), size)], self.options["getter"], None)


def register(spark) -> None:
    """Make motor_sites known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SiteSource)
