"""Every query on hand-written shops with the awkward rows."""

from dataclasses import replace
from datetime import date

import numpy as np
import pytest

from orderlens.operators.delivered import DELIVERED_COLUMNS, delivered_orders
from orderlens.plans import business_cases, chart_data, kpis, reported_kpis, statistics
from orderlens.settings import Settings
from tests.shop import dicts, item, order, product, review, rows, shop

S = Settings()
SMALL = replace(
    S, min_state_orders=1, min_late_reviews=1, min_seller_orders=1, min_category_orders=1
)


@pytest.fixture(scope="module")
def market(spark):
    return shop(
        spark,
        orders=[
            # Delivered on the promised day, in the evening: on time.
            order("evening", "2017-01-01 00:00:00", "2017-01-11 18:00:00", "2017-01-11 00:00:00",
                  carrier="2017-01-03 00:00:00"),
            # One day after the promise: late.
            order("late", "2017-01-10 12:00:00", "2017-01-21 00:00:00", "2017-01-20 00:00:00",
                  carrier="2017-01-12 12:00:00"),
            # Delivered without a date: counted by status only.
            order("undated", "2017-02-01 00:00:00", None, "2017-02-20 00:00:00"),
            # No promise: lateness unknown.
            order("unpromised", "2017-02-03 00:00:00", "2017-02-05 00:00:00", None,
                  carrier="2017-02-04 00:00:00"),
            # Canceled after arriving.
            order("canceled", "2017-02-03 00:00:00", "2017-02-09 00:00:00", "2017-02-05 00:00:00",
                  status="canceled"),
            # Carrier date before the purchase, after the delivery, missing.
            order("backwards", "2017-02-10 00:00:00", "2017-02-20 00:00:00", "2017-02-25 00:00:00",
                  carrier="2017-02-09 00:00:00"),
            order("swapped", "2017-03-10 00:00:00", "2017-03-20 00:00:00", "2017-03-15 00:00:00",
                  carrier="2017-03-21 00:00:00"),
            order("carrierless", "2017-03-11 00:00:00", "2017-03-20 00:00:00",
                  "2017-03-25 00:00:00"),
            # At the bounds of the window.
            order("before", "2016-12-31 23:59:59", "2017-01-05 00:00:00", "2017-01-09 00:00:00",
                  carrier="2017-01-01 00:00:00"),
            order("after", "2018-09-01 00:00:00", "2018-09-05 00:00:00", "2018-09-09 00:00:00",
                  carrier="2018-09-02 00:00:00"),
            # Delivered without items, and without a review.
            order("itemless", "2017-04-01 00:00:00", "2017-04-03 00:00:00", "2017-04-09 00:00:00",
                  carrier="2017-04-02 00:00:00"),
        ],
        items=[
            item("evening", 1, "p1", "s1", "10.00", "1.00"),
            item("evening", 2, "p2", "s2", "20.00", "2.00"),
            item("late", 1, "p1", "s1", "100.00", "0.50"),
            item("late", 2, "p1", "s1", "100.00", "0.50"),
            item("undated", 1, "p3", "s1", "5.00"),
            item("unpromised", 1, "p3", "s2", "7.00"),
            item("canceled", 1, "p1", "s1", "1000.00"),
            item("backwards", 1, "p2", "s2", "40.00"),
            item("swapped", 1, "p2", "s2", "60.00"),
            item("carrierless", 1, "p4", "s2", "80.00"),
            item("before", 1, "p1", "s1", "3.00"),
            item("after", 1, "p1", "s1", "4.00"),
        ],
        reviews=[
            review("r1", "evening", 5, "2017-01-12 00:00:00"),
            review("r2", "late", 3, "2017-01-22 00:00:00"),
            review("r3", "late", 2, "2017-01-23 00:00:00"),
            review("r4", "unpromised", 1, "2017-02-06 00:00:00"),
            review("r5", "canceled", 1, "2017-02-10 00:00:00"),
            review("r6", "backwards", 3, "2017-02-21 00:00:00"),
            review("r7", "swapped", 1, "2017-03-21 00:00:00"),
            review("r8", "before", 4, "2017-01-06 00:00:00"),
        ],
        products=[
            product("p1", "casa", 100, 1),
            product("p2", "arte", 300, 1),
            product("p3", None, 50, 1),
            product("p4", "sem traducao", None, 1),
        ],
        sellers=[("s1", "SP"), ("s2", "BA")],
    )


def test_delivered_orders(market):
    view = delivered_orders(market["orders"])
    assert tuple(view.columns) == DELIVERED_COLUMNS
    found = {r["order_id"]: r for r in dicts(view)}
    assert len(found) == 9
    assert {k: r["is_late"] for k, r in found.items()} == {
        "evening": False, "late": True, "unpromised": None, "backwards": False, "swapped": True,
        "carrierless": False, "before": False, "after": False, "itemless": False}
    assert found["late"]["delivery_days"] == 10.5


def test_baseline_counts_by_status_and_needs_items(market):
    assert dicts(kpis.baseline_kpis(market, S)) == [
        {"total_orders": 9, "total_revenue": pytest.approx(433), "aov": 48.11}]


def test_late_delivery_rate(market):
    # Days: 10.75, 10.5, 2, 10, 10, 9, 4.0000116, 4, 2
    assert dicts(kpis.late_delivery_rate(market, S)) == [
        {"delivered_orders": 9, "late_orders": 2, "late_rate_pct": 25.0, "avg_delivery_days": 6.92,
         "median_delivery_days": 9.0}]


def test_no_orders_at_all(spark):
    empty = shop(spark)
    assert dicts(kpis.baseline_kpis(empty, S)) == [
        {"total_orders": 0, "total_revenue": None, "aov": None}]
    assert dicts(kpis.late_delivery_rate(empty, S)) == [
        {"delivered_orders": 0, "late_orders": 0, "late_rate_pct": None, "avg_delivery_days": None,
         "median_delivery_days": None}]
    assert rows(kpis.monthly_trend(empty, S)) == []
    assert rows(kpis.promised_vs_actual(empty, S)) == []


def test_delay_vs_review(market):
    # Unknown lateness is a row of its own, labelled on_time.
    assert rows(kpis.delay_vs_review(market, S)) == [
        ("on_time", 6, 3, 4.0, 0.0), ("late", 2, 2, 1.5, 100.0), ("on_time", 1, 1, 1.0, 100.0)]


def test_low_score_boundary(spark):
    t = shop(
        spark,
        orders=[order(f"o{i}", "2017-05-01 00:00:00", "2017-05-02 00:00:00", "2017-05-09 00:00:00")
                for i in (1, 2, 3, 4)],
        reviews=[review(f"r{i}", f"o{i}", i, None) for i in (1, 2, 3)],
    )
    assert rows(kpis.delay_vs_review(t, S)) == [("on_time", 4, 3, 2.0, 66.67)]


def test_state_queries(spark):
    orders, reviews, customers = [], [], []
    for state, late, on_time in (("AL", 40, 60), ("BA", 29, 70), ("CE", 0, 101)):
        for i in range(late + on_time):
            key = f"{state}{i}"
            arrived = "2017-05-20 00:00:00" if i < late else "2017-05-06 00:00:00"
            orders.append(order(key, "2017-05-01 00:00:00", arrived, "2017-05-10 00:00:00"))
            customers.append((f"c-{key}", f"u-{key}", "0", "x", state))
            if i % 2 == 0 or state != "AL":
                reviews.append(review(f"r{key}", key, 2 if i < late else 4, None))
    t = shop(spark, orders=orders, reviews=reviews, customers=customers)
    # BA has 99 orders, one too few.
    assert rows(kpis.state_performance(t, S)) == [
        ("AL", 100, 40.0, 10.6, 3.2), ("CE", 101, 0.0, 5.0, 4.0)]
    # AL has 20 late reviews, BA 29, both too few; lower the bar to see them.
    assert rows(kpis.state_confounding(t, S)) == []
    assert rows(kpis.state_confounding(t, replace(S, min_late_reviews=29))) == [
        ("BA", 29, 4.0, 2.0, 2.0)]
    interval = {r["customer_state"]: r for r in dicts(statistics.state_late_rate_interval(t, S))}
    assert (interval["AL"]["ci_low_pct"], interval["AL"]["ci_high_pct"]) == (30.4, 49.6)


def test_state_queries_sum_repeat_customers(spark):
    t = shop(
        spark,
        orders=[order(f"o{i}", "2017-05-01 00:00:00", f"2017-05-0{2 + i} 00:00:00",
                      "2017-05-03 00:00:00", customer="same") for i in range(3)],
        reviews=[review("r0", "o0", 5, None), review("r2", "o2", 1, None)],
        customers=[("same", "u", "0", "x", "SP"), ("none", "v", "0", "x", "SP")],
    )
    assert rows(kpis.state_performance(t, SMALL)) == [("SP", 3, 33.33, 2.0, 3.0)]
    assert rows(kpis.state_confounding(t, SMALL)) == [("SP", 1, 5.0, 1.0, 4.0)]


def test_monthly_trend(market):
    assert rows(kpis.monthly_trend(market, S)) == [
        (date(2017, 1, 1), 2, 234, None, 50.0),
        (date(2017, 2, 1), 2, 47, -79.91, 0.0),
        (date(2017, 3, 1), 2, 140, 197.87, 50.0),
    ]


def test_growth_after_a_month_without_value(spark):
    t = shop(
        spark,
        orders=[order("a", "2017-01-05 00:00:00", "2017-01-06 00:00:00", "2017-01-09 00:00:00"),
                order("b", "2017-02-05 00:00:00", "2017-02-06 00:00:00", "2017-02-09 00:00:00")],
        items=[item("a", 1, "p", "s", "0.00"), item("b", 1, "p", "s", "5.00")],
    )
    assert [r["gmv_mom_growth_pct"] for r in dicts(kpis.monthly_trend(t, S))] == [None, None]


def test_seller_vs_carrier(market):
    assert rows(kpis.seller_vs_carrier(market, S)) == [
        (date(2017, 1, 1), 2.0, 8.63, 50.0, None),
        (date(2017, 2, 1), 1.0, 1.0, 0.0, None),
        (date(2017, 3, 1), None, None, 50.0, 33.33),
        (date(2017, 4, 1), 1.0, 1.0, 0.0, 16.67),
    ]
    share = dicts(reported_kpis.carrier_share(market, S))
    # Seller 2 + 2 + 1 + 0 + 1 + 1 = 7 days, carrier 8.75 + 8.5 + 1 + 4 + 3 + 1 = 26.25.
    assert share == [{"orders": 6, "avg_seller_days": 1.17, "avg_carrier_days": 4.38,
                      "carrier_share_pct": 78.95}]


def test_promised_vs_actual(market):
    assert rows(kpis.promised_vs_actual(market, S)) == [
        (date(2017, 1, 1), 10.0, 10.5, -0.5, 50.0, 100.0),
        (date(2017, 2, 1), 15.0, 6.0, 5.0, 0.0, 50.0),
        (date(2017, 3, 1), 9.5, 9.5, 0.0, 50.0, 100.0),
        (date(2017, 4, 1), 8.0, 2.0, 6.0, 0.0, 100.0),
    ]


def test_seller_late_rate(market):
    # An order counts once per seller; a late order is late for each of them.
    assert rows(kpis.seller_late_rate(market, SMALL)) == [
        ("s1", "SP", 4, 25.0, 219), ("s2", "BA", 5, 20.0, 209)]
    assert rows(kpis.seller_late_rate(market, replace(S, min_seller_orders=5))) == [
        ("s2", "BA", 5, 20.0, 209)]


def test_category_analysis(market):
    found = rows(kpis.category_analysis(market, SMALL))
    # p4's missing weight is filled with the median of 50, 100 and 300; unknown
    # holds the product without category and the one without translation.
    assert found == [
        ("art", 3, 33.33, 300.0, 122), ("home", 4, 25.0, 100.0, 219), ("unknown", 2, 0.0, 75.0, 87)]
    assert rows(kpis.category_analysis(market, S)) == []
    corr = dicts(reported_kpis.category_weight_correlation(market, SMALL))[0]
    assert corr == {"categories": 3, "r": pytest.approx(
        np.corrcoef([300, 100, 75], [33.33, 25, 0])[0, 1], abs=1e-6)}


def test_purchase_quarters_keep_itemless_orders(market):
    s = replace(S, quarters=S.analysis)
    assert rows(business_cases.gmv_by_purchase_quarter(market, s)) == [
        (date(2017, 1, 1), 8, 1426, 7, 426, 60.86), (date(2017, 4, 1), 1, None, 1, None, None)]


def test_delivery_quarters_drop_them(market):
    s = replace(S, quarters=S.analysis)
    assert rows(business_cases.gmv_by_delivery_quarter(market, s)) == [
        (date(2017, 1, 1), 7, 424, 60.57)]


def test_growth_by_quarter(spark):
    t = shop(
        spark,
        orders=[order("a", "2017-11-05 00:00:00", "2017-12-06 00:00:00", "2017-12-09 00:00:00"),
                order("b", "2017-12-30 00:00:00", "2018-01-02 00:00:00", "2018-02-09 00:00:00"),
                order("c", "2018-03-30 00:00:00", "2018-04-01 00:00:00", "2018-04-09 00:00:00")],
        items=[item("a", 1, "p", "s", "10.00"), item("b", 1, "p", "s", "30.00"),
               item("c", 1, "p", "s", "50.00")],
    )
    assert rows(reported_kpis.period_growth(t, S)) == [
        ("delivery", date(2017, 10, 1), 10, None), ("delivery", date(2018, 1, 1), 30, 200.0),
        ("purchase", date(2017, 10, 1), 40, None), ("purchase", date(2018, 1, 1), 50, 25.0)]


def test_review_coverage(market):
    assert rows(business_cases.review_coverage(market, S)) == [
        (date(2017, 1, 1), 2, 2, 100.0), (date(2017, 2, 1), 2, 2, 100.0),
        (date(2017, 3, 1), 2, 1, 50.0), (date(2017, 4, 1), 1, 0, 0.0)]


@pytest.fixture(scope="module")
def two_periods(spark):
    """Published shares and rates: late 3.87% -> 8.63%, low 9.32/57.98 -> 9.75/66.00."""
    orders, reviews = [], []
    for year, late, low_late, low_on_time in ((2017, 387, 224, 896), (2018, 863, 570, 891)):
        for i in range(10_000):
            key = f"{year}-{i}"
            is_late = i < late
            arrived = f"{year}-05-20 00:00:00" if is_late else f"{year}-05-05 00:00:00"
            orders.append(order(key, f"{year}-05-01 00:00:00", arrived, f"{year}-05-10 00:00:00"))
            low = i < low_late if is_late else i - late < low_on_time
            reviews.append(review(f"r{key}", key, 2 if low else 3, None))
    # Outside both periods, and inside without a review.
    orders += [order("out", "2017-07-01 00:00:00", "2017-07-02 00:00:00", "2017-07-01 00:00:00"),
               order("mute", "2018-06-30 23:59:59", "2018-07-02 00:00:00", "2018-07-09 00:00:00")]
    return shop(spark, orders=orders, reviews=reviews)


def test_periods(two_periods):
    assert rows(business_cases.low_score_by_period(two_periods, S)) == [
        ("Jan-Jun 2017", 10_000, 10_000, 1120, 11.2), ("Jan-Jun 2018", 10_001, 10_000, 1461, 14.61)]
    assert rows(business_cases.late_by_period(two_periods, S)) == [
        ("Jan-Jun 2017", 10_000, 387, 3.87), ("Jan-Jun 2018", 10_001, 863, 8.63)]
    assert rows(business_cases.low_score_period_x_status(two_periods, S)) == [
        ("2017", "late", 387, 387, 57.88), ("2017", "on_time", 9613, 9613, 9.32),
        ("2018", "late", 863, 863, 66.05), ("2018", "on_time", 9138, 9137, 9.75)]


def test_change_in_low_scores(two_periods):
    test = dicts(statistics.low_score_change(two_periods, S))[0]
    p = 2581 / 20000
    assert test["z"] == pytest.approx((0.1461 - 0.112) / (p * (1 - p) * 2 / 10000) ** 0.5)
    assert 0 < test["p_value"] < 1e-11
    split = dicts(statistics.low_score_decomposition(two_periods, S))[0]
    # The published split is 68.5% mix and 31.5% within groups.
    assert split["mix_share_pct"] == pytest.approx(68.0, abs=0.6)
    assert split["mix_share_pct"] + split["within_share_pct"] == pytest.approx(100.0)
    assert split["mix_pp"] + split["within_pp"] == pytest.approx(split["change_pp"], abs=2e-4)


def test_chart_data(market):
    assert rows(chart_data.monthly_late_rate(market, S)) == [
        (date(2017, 1, 1), 50.0), (date(2017, 2, 1), 0.0), (date(2017, 3, 1), 50.0),
        (date(2017, 4, 1), 0.0)]
    # Only reviewed orders of known lateness; shares are within each group.
    third = pytest.approx(100 / 3)
    assert rows(chart_data.review_score_distribution(market, S)) == [
        ("Late", 1, 50.0), ("Late", 2, 50.0), ("On-time", 3, third), ("On-time", 4, third),
        ("On-time", 5, third)]
    assert rows(chart_data.monthly_buffer_vs_late(market, S)) == [
        (date(2017, 1, 1), -0.5, 50.0), (date(2017, 2, 1), 5.0, 0.0), (date(2017, 3, 1), 0.0, 50.0),
        (date(2017, 4, 1), 6.0, 0.0)]


def test_buffer_statistics(market):
    x, y = np.array([-0.5, 5.0, 0.0, 6.0]), np.array([50.0, 0.0, 50.0, 0.0])
    slope, intercept = np.polyfit(x, y, 1)
    r = np.corrcoef(x, y)[0, 1]
    assert dicts(statistics.buffer_late_correlation(market, S)) == [
        {"months": 4, "r": pytest.approx(r, abs=1e-6)}]
    assert dicts(statistics.buffer_late_line(market, S)) == [
        {"slope": pytest.approx(slope, abs=1e-6), "intercept": pytest.approx(intercept, abs=1e-6)}]
    # With two degrees of freedom the two-sided p-value is 1 - |r|.
    assert dicts(statistics.buffer_late_significance(market, S))[0]["p_value"] == pytest.approx(
        1 - abs(r), abs=1e-8)
    flags = [(r["below_threshold"], r["double_digit_late_rate"])
             for r in dicts(reported_kpis.buffer_threshold(market, S))]
    assert flags == [(True, True), (True, False), (True, True), (True, False)]


def test_p_value_matches_the_regression_slope_test(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    pairs = spark.createDataFrame(
        [(float(i), (i * 37 % 11) - 0.4 * i) for i in range(20)], "x double, y double")
    found = statistics.correlation_test(pairs, "x", "y").first()
    points = VectorAssembler(inputCols=["x"], outputCol="features").transform(pairs)
    fit = LinearRegression(labelCol="y", solver="normal").fit(points)
    assert found["n"] == 20
    assert found["p_value"] == pytest.approx(fit.summary.pValues[0], rel=1e-8)


def test_late_rate_by_definition(market):
    assert dicts(reported_kpis.late_rate_by_definition(market, S)) == [
        {"late_rate_by_date_pct": 25.0, "late_rate_by_time_pct": 37.5}]


def test_repeat_purchases(spark):
    t = shop(
        spark,
        orders=[order("a", "2017-01-01 00:00:00", customer="c1"),
                order("b", "2017-01-01 00:00:00", customer="c2", status="canceled"),
                order("c", "2017-01-01 00:00:00", customer="c3"),
                order("d", "2017-01-01 00:00:00", customer="c4")],
        customers=[("c1", "ana", "0", "x", "SP"), ("c2", "ana", "0", "x", "SP"),
                   ("c3", "bia", "0", "x", "SP"), ("c4", "cao", "0", "x", "SP"),
                   ("c5", "noorder", "0", "x", "SP")],
    )
    assert dicts(reported_kpis.repeat_purchase_rate(t, S)) == [
        {"customers": 3, "repeat_customers": 1, "repeat_purchase_pct": 33.33}]
