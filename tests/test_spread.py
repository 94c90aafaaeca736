"""Listings and pages are built by many tasks, although the table they are built from is one row group."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom.queries import entities, leads, web
from leadloom.queries.base import raw_listings


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    customers = [(k, k % 25, k * 1.5, "FURNITURE") for k in range(1, 401)] + [(7, 3, 1.0, "BUILDING")]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{d}/customer.parquet")
    orders = [(i, i % 300 + 1, dt.date(2000, 1, 1 + i % 28)) for i in range(600)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").coalesce(1).write.parquet(f"{d}/orders.parquet")
    return d


def tasks(rows) -> int:
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_companies_are_dealt_out_before_markup(spark, tables):
    assert tasks(web.contact_pages(spark, tables)) > 4
    assert tasks(web.member_pages(spark, tables)) > 4


def test_listings_are_dealt_out_before_they_are_read(spark, tables):
    rows = raw_listings(spark, tables)
    assert tasks(rows) > 4
    assert rows.count() == 401 and rows.where("pos = 7").count() == 2


def test_listing_pages_shuffle_keys_only(spark, tables, capsys):
    pages = web.listing_pages(spark, tables, "egydir", web.CARD)
    assert tasks(pages) > 4
    assert sorted(r.page_id for r in pages.select("page_id").collect()) == list(range(21))
    pages.explain()
    assert capsys.readouterr().out.count("Exchange ") == 1


def test_phrases_of_a_listing_are_read_once(spark, tables, capsys):
    rows = leads.target_markets(spark, tables)
    rows.explain()
    assert capsys.readouterr().out.count("regexp_extract_all(") == 1
    found = {r.pos: r.markets for r in rows.collect()}
    assert "GCC" in found[8] and "Europe" in found[8]  # "We export ready-made goods to the GCC and Europe."


def test_pages_of_websites_are_written_from_sites_found_once(spark, tables, capsys):
    pages = entities.web_pages(spark, tables)
    pages.explain()
    assert "customer.parquet" not in capsys.readouterr().out
    assert pages.where("url like '%/about'").count() > 0
