"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from motorlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Of the slow chain fair_price, confidence and deal_score run here; all of it is compared on sf0.01.
CHAIN = {"comps_tier", "mad", "fitted_price", "risk_score", "score_factors", "report_questions", "scan_run", "scan_summary", "best_per_vehicle", "vehicle_groups_spread", "alerts_new", "watchlist_matches", "dashboard_stats", "scan_report", "population_medians", "top20"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def plain(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - CHAIN))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    wanted = duck.sql(f"select {', '.join(columns)} from want").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(wanted)


def test_slugs_of_whole_texts(spark):
    df = entry.queries()["slugify"](spark, SF)
    assert df.where("length(slug) > 60").count() > 100


def test_whole_scan_and_overwrite_take_every_order(spark):
    """The result grows with the table."""
    big = "/root/testdata/sf0.01"
    keys = spark.read.parquet(f"{big}/orders.parquet").selectExpr("o_orderkey div 2 AS id").distinct()
    assert entry.queries()["protected_overwrite"](spark, big).count() == keys.count()
    assert entry.queries()["paginated_scan"](spark, big).where("search >= 20").count() > 0


def test_newest_first(spark):
    days = [r["seen_days"] for r in entry.queries()["candidates_newest"](spark, SF).collect()]
    assert days == sorted(days) and len(days) > 500


def test_every_query_grows_with_the_tables(spark):
    """No query runs on made-up rows alone: each plan reads a table of the folder that it is given."""
    for name, f in registry.QUERIES.items():
        if name not in CHAIN and not name.startswith("stream_") and name not in ("ingest_twice", "page_cache"):
            assert any(SF in x for x in f(spark, SF).inputFiles()), name


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_links(spark):
    df = entry.queries()["link_harvest"](spark, SF)
    assert df.count() > 50
    assert df.groupBy("url", "listing_id").count().where("count > 1").count() == 0
