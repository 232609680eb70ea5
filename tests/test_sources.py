"""Sites, robots rules, the data source of pages, model replies, alerts and the scan."""

import json

import pytest
from pyspark.sql import functions as F

from motorlens import schemas as s
from motorlens.operators import alerts, replies
from motorlens.plans.crawl_queries import GOOD_REPLY
from motorlens.sources import crawl


def page_of(url):
    """Read by the data source on an executor."""
    if "broken" in url:
        raise OSError("no answer")
    return f"<html>{url}</html>"


def test_pages_of_sites_as_a_source(spark):
    """One run of pages each for two sites; a page that fails is a row, the rest are read."""
    crawl.register(spark)
    asked = {"a": [f"u/a{k}" for k in range(45)], "b": ["u/b1", "u/broken", "u/b2"]}
    df = spark.read.format("motor_sites").option("requests", json.dumps(asked)).option("getter", "tests.test_sources:page_of").load()
    assert df.rdd.getNumPartitions() == 4
    got = {r["url"]: r for r in df.collect()}
    assert len(got) == 48 and got["u/b2"]["html"] == "<html>u/b2</html>"
    assert got["u/broken"]["html"] is None and got["u/broken"]["error"] == "OSError: no answer"
    assert df.where("source = 'b'").count() == 3


def test_filter_on_source_is_pushed():
    class EqualTo:
        attribute, value = ("source",), "b"

    class GreaterThan:
        attribute, value = ("url",), "x"

    reader = crawl._Reader([crawl.Run("a", ["1"]), crawl.Run("b", ["2"])], "m:f", None)
    left = list(reader.pushFilters([EqualTo(), GreaterThan()]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"] and [p.source for p in reader.partitions()] == ["b"]


def test_adapters_fail_alone(spark):
    rows = [("a", f"u{k}", "x") for k in range(10)] + [("b", "u10", None), ("c", "u11", "y"), (None, "u12", "y")]

    def some(url, html):
        if url == "u3":
            raise ZeroDivisionError("u3")
        return [{"n": len(html)}]

    got = crawl.extract(spark.createDataFrame(rows, "source string, url string, html string").coalesce(1), {"a": some, "b": some}).collect()
    assert sum(r["listing"] is not None for r in got) == 10
    assert sorted(r["url"] for r in got if r["error"]) == ["u11", "u12", "u3"]


def test_site_files(spark):
    files = [("1", None), ("2", ""), ("3", "[1, 2]"), ("4", "name: a\nsearch_url: u\nlisting_link_pattern: p\nmax_pages: 99\n"), ("5", "name: a\nsearch_url: u\nlisting_link_pattern: p\n"), ("6", "name: [unclosed"), ("7", '{"name": "b", "search_url": "u", "listing_link_pattern": ""}')]
    got = {r["file"]: r for r in crawl.sites(spark.createDataFrame(files, "file string, text string")).collect()}
    assert [got[k]["error"] for k in "12345"] == ["no site file", "no site file", "no site file", None, "named before in 4"]
    assert got["6"]["error"] == "no site file" and got["7"]["error"] == "without listing_link_pattern"
    assert (got["4"]["max_pages"], got["4"]["page_param"], got["4"]["default_country"]) == (20, "page", "FR") and got["5"]["name"] is None


ROBOTS = """User-agent: *
Disallow: /private/
Allow: /private/open
Disallow: /*.pdf$
Disallow: /a*b/c
Allow: /a
Crawl-delay: 3

User-agent: mot
User-agent: x
Disallow: /only-mot
Sitemap: z
User-agent: y
Disallow: /
"""


@pytest.mark.parametrize("agent, path, want", [
    ("other", "/", True), ("other", "", True), ("other", "/private/x", False), ("other", "/private/open/x", True), ("other", "/x.pdf", False), ("other", "/x.pdf?y", True), ("other", "/axxb/c", False), ("other", "/ab/d", True),
    ("motorlens/2", "/private/x", True), ("motorlens/2", "/only-mot", False), ("y", "/", False), ("x", "/only-mot/", False),
])
def test_robots(spark, agent, path, want):
    rules = crawl.robots_rules(spark.createDataFrame([("h.de", ROBOTS), ("n.de", None)], "host string, text string"))
    urls = spark.createDataFrame([("https://h.de" + path,), ("https://other.de/private/",), (None,)], "url string")
    got = {r["url"]: r["allowed"] for r in crawl.robots_allowed(urls, rules, agent).collect()}
    assert got["https://h.de" + path] is want and got["https://other.de/private/"] is True and got[None] is True


def checked(spark, body, stop="end_turn"):
    df = spark.createDataFrame([(1, stop, body, 1000, 10, "m", 2)], "id long, stop_reason string, body string, input_tokens long, output_tokens long, model string, photos int")
    return replies.checked(df).head()


@pytest.mark.parametrize("change, reason", [
    ({}, None), ({"confidence": 101}, "confidence out of range"), ({"confidence": None}, "lacks confidence"), ({"confidence": "x"}, "confidence of another type"), ({"verdict": "buy"}, "unknown verdict"), ({"strengths": "none"}, "strengths of another type"),
    ({"red_flags": [{"label": "l", "severity": "serieux", "evidence": "e"}]}, "incomplete flag"), ({"photo_findings": [{"photo_index": 0, "observation": "o", "severity": "bad"}]}, "unknown severity"),
])
def test_replies_are_whole_or_not_used(spark, change, reason):
    got = checked(spark, json.dumps(json.loads(GOOD_REPLY) | change))
    assert got["degraded_reason"] == reason and (got["reply"] is None) == (reason is not None) and (got["cost_eur"] > 0) == (reason is None)


def test_replies_that_did_not_come(spark):
    assert [checked(spark, b, x)["degraded_reason"] for b, x in ((None, None), (None, "refusal"), ("{", "max_tokens"), ("{", "end_turn"), ("[]", "end_turn"), (None, "end_turn"))][:4] == ["no reply", "refused by the model", "reply cut off", "reply is no JSON"]
    assert checked(spark, "[]")["reply"] is None and checked(spark, None)["degraded_reason"] == "reply is no JSON"


def test_alert_helpers(spark, tmp_path):
    q = s.SearchQuery(make="BMW", price_max=12000, year_min=2015, km_max=90000)
    assert alerts.criteria(q) == "BMW jusqu'a 12000 EUR a partir de 2015 moins de 90000 km"
    assert alerts.criteria(s.SearchQuery()) == "tous criteres" and alerts.criteria(q, "https://x") == "https://x"
    assert alerts.threshold(s.Watchlist(1, "n", q)) == s.GREAT and alerts.threshold(s.Watchlist(1, "n", q, min_score=60)) == 60
    lists = alerts.upsert_watchlist([s.Watchlist(1, "n", q, ("a",), 60, ("mail",))], s.Watchlist(9, "n", s.SearchQuery(make="Audi"), (), None, ()))
    assert lists == [s.Watchlist(1, "n", s.SearchQuery(make="Audi"), ("a",), 60, ("mail",))]
    assert len(alerts.upsert_watchlist(lists, s.Watchlist(2, "m", q))) == 2
    df = spark.createDataFrame([(1, 5, "BMW", "X1", 12500.0, 80, "grab", "h")], "watchlist_id int, id long, make string, model string, price_eur double, score int, verdict string, headline string")
    assert df.select(alerts.message()).head()[0] == "BMW X1 - 80/100 - 12 500 EUR\nh"
    assert json.loads(df.select(alerts.payload()).head()[0])["price_eur"] == 12500.0
    alerts.deliver(df, "json", f"{tmp_path}/out")
    alerts.deliver(df, "pigeon", f"{tmp_path}/none")
    assert spark.read.json(f"{tmp_path}/out").count() == 1 and not (tmp_path / "none").exists()


def test_pages_that_follow_a_pasted_search(spark):
    df = spark.createDataFrame([("https://a.de/s?x=1&p=4&page=9", "p", 0), ("https://a.de/s?x=1&p=4&page=9", "p", 2), ("https://a.de/s", "page", 1)], "first string, page_param string, offset int")
    got = [(r["page_no"], r["url"]) for r in crawl.pages_from(df).collect()]
    assert got == [(4, "https://a.de/s?x=1&p=4&page=9"), (6, "https://a.de/s?x=1&page=9&p=6"), (2, "https://a.de/s?page=2")]


def test_cache_keeps_the_newest(spark, tmp_path):
    cache = crawl.PageCache(spark, f"file://{tmp_path}/c", 4)
    page = lambda html, at: spark.createDataFrame([("u", 200, html, at)], "url string, status int, html string, at string").select("url", "status", "html", F.col("at").cast("timestamp").alias("fetched_at"))
    assert cache.load(0, page("new", "2026-01-02")) and cache.load(1, page("old", "2026-01-01")) and not cache.load(1, page("other", "2026-01-03"))
    wanted = spark.createDataFrame([("u", 1), ("v", 2)], "url string, k int")
    got = {r["k"]: (r["hit"], r["html"]) for r in cache.look_up(wanted, F.lit("2026-01-02 11:00:00").cast("timestamp"), 12).collect()}
    assert got == {1: (True, "new"), 2: (False, None)}


def _both(spark, folder, name, rows):
    """Rows of a query and of its SQL over pages (page_id, url, html)."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    want = c.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.select(*columns).collect()))), sorted(map(repr, want))


def test_shapes_of_links_with_numbered_slugs(spark, tmp_path):
    rows = [(i, f"https://a.example.com/{'en' if i % 2 else 'fr'}/{p}#x", "") for i, p in enumerate([f"{n}.html" for n in range(996, 1006)] + [f"golf-{n}" for n in range(12345, 12351)] + ["7", "8", "9", "10", "11", "12"])]
    got, want = _both(spark, tmp_path / "a", "link_shape_topk", rows)
    assert got == want and any("[^/]+" in r for r in got)


def test_pages_that_share_a_url(spark, tmp_path):
    rows = [(i, f"https://x.example.{('com', 'net', 'org')[i // 3 % 3]}/en/{i // 3}", f"<p>{'x' * (i * 7 % 5)}</p>") for i in range(60)]
    for name in ("page_cache", "sources_isolated"):
        got, want = _both(spark, tmp_path / name, name, rows)
        assert got == want, name


def test_search_requests_are_made_where_the_queries_are(spark):
    """Sites go to the queries, not queries to the few tasks that hold a site."""
    import __spark_entry__ as entry

    df = entry.queries()["search_requests"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
