"""Trees of tags, selectors, cards and JSON-LD of pages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from motorlens.plans import registry
from motorlens.sources import jsonld, pages, trees
from motorlens.sources.fixtures import as_of

HTML = """<!DOCTYPE html><html><body><!-- <p>no</p> --><div id=a class="x y"><p>one<p>two<b>bold</b><span class=z title="T &amp; U">s</span></div>
<ul><li>1<li class=k>2<ul><li>in</ul><li>3</ul><script>var a = "<div class=x>";</script><div><div class=x data-a="p q"><i>deep</i></div></div><br><img src=1.jpg></p></nosuch>tail</body>"""


def said(spark, selector, html=HTML):
    tree = F.col("tree")
    df = trees.trees(spark.createDataFrame([(html,)], "html string"))
    return df.select(F.transform(trees.select(tree, selector), lambda n: trees.text_of(tree, n))).first()[0]


@pytest.mark.parametrize("selector, want", [
    ("div > .x", ["deep"]), ("#a.x p", ["one", "two bold s"]), ("ul > li:nth-child(2)", ["2 in"]), ("li:nth-child(odd)", ["1", "in", "3"]), ("p + p", ["two bold s"]), ("li ~ li.k", ["2 in"]), ("[title='T & U']", ["s"]),
    ("[class*=y]", ["one two bold s"]), ("[data-a~=q]", ["deep"]), ("[data-a^='p ']", ["deep"]), ("[data-a$=q]", ["deep"]), ("[data-a*='']", []), ("b, i", ["bold", "deep"]), ("i,b", ["bold", "deep"]), ("p:not(:first-child)", ["two bold s"]),
    ("body > div", ["one two bold s", "deep"]), ("li li", ["in"]), ("li:nth-child(-n+1)", ["1", "in"]), ("li:nth-child(2n+3)", ["3"]), ("html .x .x", []), ("body", ["one two bold s 1 2 in 3 deep tail"]), (".nosuch > p", []), ("img", [None]),
])
def test_selectors(spark, selector, want):
    assert said(spark, selector) == want


@pytest.mark.parametrize("selector", ["", "p >", "p::before", "..x", "p:hover", "li:nth-child(x)"])
def test_selectors_that_are_none(selector):
    with pytest.raises(ValueError):
        trees.select(F.col("tree"), selector)


def test_intervals_nest(spark):
    """Any soup of tags gives intervals that nest, and texts that lie in their parents."""
    r = random.Random(3)
    bits = ["<div>", "</div>", "<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "text", "<br>", "<b class='", "'>", "<", ">", "<!--", "-->", "<script>", "</script>", "&lt;", "<a href=x>", "</a>", '"', "<x/>"]
    for _ in range(500):
        nodes, texts = trees.parse("".join(r.choice(bits) for _ in range(60)))
        for n in nodes:
            assert n[0] <= n[1] and 0 <= n[5] and n[5] + n[6] <= len(texts)
        for a in nodes:
            for b in nodes:
                assert a is b or b[0] > a[1] or b[1] <= a[1] or b[0] < a[0] or b[0] == a[0]
    deep, _ = trees.parse("<i>" * 50_000)
    assert len(deep) == 50_000 and deep[-1][2] == 49_999


def test_null_and_empty_pages(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "plain")], "url string, html string")
    rules = {"t": "p", "l": {"selector": "a", "attr": "href"}}
    assert [tuple(r) for r in trees.css_fields(df, rules).orderBy("url").collect()] == [("a", None, None), ("b", None, None), ("c", None, None)]
    assert pages.card_texts(df).count() == 0 and pages.vehicles(df, as_of()).count() == 0
    assert pages.detail_page(df, as_of(), {"price": "p"}).count() == 0


def test_objects_at_any_depth():
    node = {"@type": "Car", "name": "x", "offers": {"price": 1}}
    deep = node
    for _ in range(400):
        deep = [{"@graph": [deep]}]
    assert jsonld.entries_of([json.dumps(deep)], "vehicle")[0]["name"] == "x"
    inner = {"@graph": [{"@type": "Car", "brand": "b"}], "@type": "Car", "model": "m"}
    assert [n.get("brand") for n in jsonld.objects(inner)] == ["b", None]
    assert jsonld.entries_of(["{broken", "[" * 100_000, '{"@type":"Car","brand":"b",}', "3", "null"], "vehicle")[0]["brand"] == "b"
    assert jsonld.entries_of([], "item") == []


@pytest.mark.parametrize("value, want", [
    (None, None), ("  x ", "x"), ("", None), (3, "3"), ({"name": "n", "value": "v"}, "n"), ({"name": None, "value": "v"}, None), ({"@value": {"text": "t"}}, "t"), ([None, "", {"name": "n"}, "z"], "n"), ({"other": 1}, None), ([[["a"]]], "a"),
])
def test_what_values_say(value, want):
    assert jsonld.said(value) == want


def test_ranges_and_units(spark):
    def page(**node):
        return f'<script type="application/ld+json">{json.dumps({"@type": "Car", "name": "n", "brand": "b"} | node)}</script>'

    rows = [
        ("u/1", page(mileageFromOdometer={"value": 50000, "unitCode": "SMI"}, vehicleEngine={"enginePower": {"value": 85, "unitCode": "KWT"}})), ("u/2", page(mileageFromOdometer=98_000_000, vehicleEngine={"enginePower": 9000})),
        ("u/3", page(fuelType="Gasoline", offers={"price": "12.500", "seller": {"@type": "Individual", "name": "Ann", "address": {"addressLocality": "Lyon"}}}, numberOfDoors="5", modelDate="2018")),
    ]
    got = {r["url"]: r for r in pages.vehicles(spark.createDataFrame(rows, "url string, html string"), as_of()).collect()}
    assert (got["u/1"]["km"], got["u/1"]["power_hp"]) == (80467, 85)
    assert (got["u/2"]["km"], got["u/2"]["power_hp"]) == (None, None)
    r = got["u/3"]
    assert (r["price"], r["seller_type"], r["seller_name"], r["city"], r["doors"], r["seats"], r["year"], r["title"]) == (12500.0, "private", "Ann", "Lyon", 5, None, 2018, "n essence")


def test_pages_to_open(spark):
    """Pages whose rows are complete give listings, the others their advert links."""
    item = lambda k, price: {"@type": "ListItem", "item": {"@type": "Car", "name": f"c{k}", "url": f"/d/{10000 + k}"} | ({"offers": {"price": price}, "mileageFromOdometer": 5} if price else {})}
    html = lambda items: f'<script type="application/ld+json">{json.dumps({"@type": "ItemList", "itemListElement": items})}</script><a href="/d/77777">x</a>'
    df = spark.createDataFrame([("https://a.de/1", html([item(1, 5), item(2, None)])), ("https://a.de/2", html([item(3, None)])), ("https://a.de/3", html([]))], "url string, html string")
    rows, links = pages.collect(df, "/d/", as_of())
    assert sorted(r["source_id"] for r in rows.collect()) == ["10001", "10002"]
    assert sorted((r["url"], r["listing_id"]) for r in links.collect()) == [("https://a.de/2", "77777"), ("https://a.de/3", "77777")]


def test_filters_on_scores_do_not_score_twice(spark):
    plan = registry.QUERIES["deals_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_batches_and_tasks_stay_small(spark):
    """However many pages there are, a worker holds few of them at a time, and a task has few rows."""
    from motorlens.sources import fixtures, trees

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    pages = spark.range(1000).selectExpr("cast(id AS string) AS url", "concat('<p>', id) AS html")
    assert trees.trees(pages).count() == 1000 and 0 < int(spark.conf.get(key)) <= trees.BATCH_PAGES
    assert fixtures.spread(spark.range(20 * fixtures.TASK_ROWS)).rdd.getNumPartitions() == 20


def test_detail_pages_are_joined_without_the_driver(spark):
    """Pages that share a URL, and pages without one, are told as before; nothing is broadcast however small it seems, and
    JSON-LD is walked once."""
    car = '<script type="application/ld+json">{"@type":"Car","name":"Golf","offers":{"price":"%d"}}</script>'
    meta = '<meta property="og:title" content="%s"><p id="k">%d km</p>'
    rows = [("u", car % 5000), ("u", meta % ("other", 7)), ("v", meta % ("Polo", 9)), ("v", "<p>gone</p>"), ("w", car % 6000), ("w", car % 7000), (None, car % 8000), (None, meta % ("lost", 1)), ("x", None), ("y", "<script>ld+json")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = pages.detail_page(df, as_of(), {"km": "#k"}).select("page", "title", "price", "km")
    want = [("u", "Golf", 5000.0, None), ("u", "Golf", 5000.0, 7), ("v", "Polo", None, 9), ("v", "Polo", None, None), *[("w", "Golf", p, None) for p in (6000.0, 7000.0) for _ in "ww"], (None, "Golf", 8000.0, None), (None, "lost", None, None)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("walk(") == plan.count("ArrowEvalPython [walk(") > 0
    found = pages.vehicles(df, as_of())._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("ArrowEvalPython") == 1
