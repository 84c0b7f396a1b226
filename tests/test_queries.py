"""Every registered query against its SQL, and what the plans must not contain."""

import pytest

import __spark_entry__ as driver
from compare import compare, connect
from reviewlens.suite import CHECKS, QUERIES, runner

FOLDER = "/root/testdata/sf0.001"
#: Pages are read by one Arrow function; no other plan holds Python.
PAGES = {"parse_listings", "parse_review_pages"}
STREAMS = {name for name in QUERIES if name.startswith("stream_")}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, con, name):
    problem = compare(spark, con, FOLDER, name)
    assert problem is None


def test_contract(spark):
    assert set(driver.queries()) >= set(QUERIES) and set(driver.oracle_sql()) >= set(CHECKS)
    assert driver.entry(spark).columns


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - {"related_reach"}))
def test_plan(spark, name):
    plan = runner(name)(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("Python") == (name in PAGES) and "Pandas" not in plan
    assert plan.count("MapInArrow") == (name == "annotate_reviews")


def test_scan_reads_only_what_it_needs(spark):
    def scans(name):
        return runner(name)(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()

    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_size:int>" in scans("scan_items")
    assert "EqualTo(o_orderpriority,1-URGENT)" in scans("match_refunds")
    assert "l_extendedprice" not in scans("recency_factor")


def test_latest_reviews_limits_before_the_shuffle(spark):
    plan = runner("latest_reviews")(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
