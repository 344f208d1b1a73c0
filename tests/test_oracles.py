"""Every registered query against DuckDB on the benchmark tables, and sums that must agree."""

import math
import os
from dataclasses import replace

import duckdb
import pytest

import __spark_entry__ as registry
from orderlens.operators import quality
from orderlens.operators.cleaning import clean_all
from orderlens.operators.delivered import order_values
from orderlens.plans import business_cases, chart_data, kpis
from orderlens.sources.benchmark_tables import BENCHMARK_SETTINGS, raw_tables
from tests.shop import dicts

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
FILES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in FILES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def in_order(columns, rows):
    """Rows with columns by name, sorted; NULL and NaN alike."""

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return (0, "")
        return (1, v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


# The queries of the training-data operators have their own tests.
OTHERS = {"pipeline", *(registry.llm.QUERIES if registry.llm else ())}
SHOP_QUERIES = [name for name in registry.queries() if name not in OTHERS]


def test_every_query_has_an_oracle():
    assert set(SHOP_QUERIES) == set(registry.oracle_sql()) - OTHERS


@pytest.mark.parametrize("name", SHOP_QUERIES)
def test_oracle(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    expected = in_order(columns, cursor.fetchall())
    assert expected
    assert in_order(found.columns, [tuple(r) for r in found.collect()]) == expected


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def shop(spark):
    return clean_all(raw_tables(spark, FOLDER))


def total(df, column):
    return sum(r[column] for r in dicts(df))


def test_totals_agree(shop):
    s = BENCHMARK_SETTINGS
    whole = dicts(kpis.late_delivery_rate(shop, s))[0]
    states = kpis.state_totals(shop)
    assert total(states, "orders") == whole["delivered_orders"]
    assert total(states, "late_orders") == whole["late_orders"]
    assert total(kpis.delay_vs_review(shop, s), "delivered_orders") == whole["delivered_orders"]

    from datetime import date

    from orderlens.settings import DateRange

    always = replace(s, analysis=DateRange(date(1900, 1, 1), date(2100, 1, 1)))
    months = kpis.monthly_trend(shop, always)
    itemless = (
        quality.itemless_orders(
            {**shop, "orders": kpis.delivered_facts(shop["orders"]).selectExpr(
                "order_id", "'delivered' AS order_status")}
        ).first()["orders"]
    )
    assert total(months, "delivered_orders") == whole["delivered_orders"] - itemless
    # Status-only orders include the undated ones.
    status_only = dicts(kpis.baseline_kpis(shop, s))[0]["total_revenue"]
    assert total(months, "gmv") < status_only
    items = shop["order_items"].selectExpr("SUM(price) + SUM(freight_value) AS value")
    cents = order_values(shop["order_items"]).selectExpr("SUM(cents) AS cents")
    assert total(items, "value") * 100 == total(cents, "cents")


def test_periods_agree(shop):
    s = BENCHMARK_SETTINGS
    late = {r["period"][-4:]: r["late_orders"] for r in dicts(business_cases.late_by_period(shop, s))}
    split = {
        r["period"]: r["orders"]
        for r in dicts(business_cases.low_score_period_x_status(shop, s))
        if r["delivery_status"] == "late"
    }
    assert late == split


def test_shares_sum_to_a_hundred(shop):
    shares: dict[str, float] = {}
    for r in dicts(chart_data.review_score_distribution(shop, BENCHMARK_SETTINGS)):
        shares[r["group"]] = shares.get(r["group"], 0) + r["percentage"]
    assert shares == {"Late": pytest.approx(100), "On-time": pytest.approx(100)}


def test_cleaning_leaves_no_gaps(shop):
    assert shop["order_reviews"].count() == shop["order_reviews"].select("order_id").distinct().count()
    measures = "product_weight_g product_length_cm product_height_cm product_width_cm".split()
    filled = [*measures, "product_category_name", "product_category_name_english"]
    assert shop["products"].dropna(subset=filled).count() == shop["products"].count()
