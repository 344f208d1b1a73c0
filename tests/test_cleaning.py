import random
import statistics
from datetime import datetime
from decimal import Decimal

from orderlens.operators.cleaning import (
    clean_orders,
    clean_products,
    clean_reviews,
    impute_medians,
)
from tests.shop import dicts, order, product, raw_shop, review


def test_malformed_timestamps_become_null(spark):
    raw = raw_shop(
        spark,
        orders=[
            order("o1", "2017-05-01 10:00:00", "not a date", "2017-05-20 00:00:00"),
            order("o2", None, "2017-05-09 01:02:03", "", carrier="2017-13-45 00:00:00"),
        ],
    )["orders"]
    found = {r["order_id"]: r for r in clean_orders(raw).collect()}
    assert found["o1"]["order_purchase_timestamp"] == datetime(2017, 5, 1, 10)
    assert found["o1"]["order_delivered_customer_date"] is None
    assert found["o2"]["order_delivered_customer_date"] == datetime(2017, 5, 9, 1, 2, 3)
    assert found["o2"]["order_purchase_timestamp"] is None
    assert found["o2"]["order_estimated_delivery_date"] is None
    assert found["o2"]["order_delivered_carrier_date"] is None
    assert all(
        t == "timestamp_ntz" for c, t in clean_orders(raw).dtypes if c.endswith(("_timestamp", "_date", "_at"))
    )


def test_latest_review_is_kept(spark):
    raw = raw_shop(
        spark,
        reviews=[
            review("r1", "two", 1, "2018-01-01 00:00:00"),
            review("r2", "two", 5, "2018-01-02 00:00:00"),
            review("r3", "tie", 2, "2018-01-01 00:00:00"),
            review("r4", "tie", 3, "2018-01-01 00:00:00"),
            review("r5", "open", 4, None),
            review("r6", "open", 1, "2018-01-09 00:00:00"),
            review("r7", "one", 2, "broken"),
        ],
    )["order_reviews"]
    kept = {r["order_id"]: r["review_id"] for r in clean_reviews(raw).collect()}
    # A review without an answer time counts as the latest one.
    assert kept == {"two": "r2", "tie": "r4", "open": "r5", "one": "r7"}


def test_latest_review_against_brute_force_with_a_hot_order(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else f"o{rng.randrange(400)}"
        answered = None if rng.random() < 0.01 else f"2018-01-{rng.randrange(1, 29):02d} 00:00:00"
        data.append(review(f"r{i:05d}", key, rng.randint(1, 5), answered))
    best = {}
    for r in data:
        rank = (r[6] is None, r[6] or "", r[0])
        if r[1] not in best or rank > best[r[1]][0]:
            best[r[1]] = (rank, r[0])
    raw = raw_shop(spark, reviews=data)["order_reviews"].repartition(6)
    kept = {r["order_id"]: r["review_id"] for r in clean_reviews(raw).collect()}
    assert kept == {k: v[1] for k, v in best.items()}


def test_categories_are_filled_and_translated(spark):
    raw = raw_shop(
        spark,
        products=[
            product("p1", "casa", Decimal(1), Decimal(1)),
            product("p2", None, Decimal(1), Decimal(1)),
            product("p3", "sem traducao", Decimal(1), Decimal(1)),
        ],
    )
    cleaned = clean_products(raw["products"], raw["category_translation"])
    found = {
        r["product_id"]: (r["product_category_name"], r["product_category_name_english"])
        for r in cleaned.collect()
    }
    assert found == {
        "p1": ("casa", "home"),
        "p2": ("unknown", "unknown"),
        "p3": ("sem traducao", "unknown"),
    }
    assert cleaned.columns == [*raw["products"].columns, "product_category_name_english"]


def test_medians_fill_missing_measures(spark):
    rng = random.Random(5)
    weights = [Decimal(rng.randint(1, 3_000_000)) / 100 for _ in range(400)]
    raw = raw_shop(
        spark,
        products=[product(f"p{i}", "casa" if i % 3 else "arte", w, w / 2 if w == 1 else Decimal(i))
                  for i, w in enumerate(weights)]
        + [product("gap-casa", "casa"), product("gap-arte", "arte"), product("gap-none", None)],
    )
    products = raw["products"]
    expected = statistics.median(weights)
    found = {r["product_id"]: r for r in impute_medians(products).collect()}
    for gap in ("gap-casa", "gap-arte", "gap-none"):
        assert found[gap]["product_weight_g"] == expected
        assert found[gap]["product_length_cm"] == statistics.median(
            [w / 2 if w == 1 else Decimal(i) for i, w in enumerate(weights)]
        )
    assert found["p7"]["product_weight_g"] == weights[7]

    by_category = {
        r["product_id"]: r["product_weight_g"]
        for r in impute_medians(products, by="product_category_name").collect()
    }
    assert by_category["gap-casa"] == statistics.median([w for i, w in enumerate(weights) if i % 3])
    assert by_category["gap-arte"] == statistics.median(
        [w for i, w in enumerate(weights) if i % 3 == 0]
    )


def test_a_median_between_cents_is_kept_exactly(spark):
    raw = raw_shop(
        spark,
        products=[
            product("a", "casa", Decimal("1.01"), Decimal(1)),
            product("b", "casa", Decimal("1.02"), Decimal(1)),
            product("gap", "casa", None, Decimal(1)),
        ],
    )
    found = {r["product_id"]: r["product_weight_g"] for r in impute_medians(raw["products"]).collect()}
    assert found["gap"] == Decimal("1.015")


def test_no_measure_at_all_stays_null(spark):
    raw = raw_shop(spark, products=[product("a", "casa"), product("b", None)])
    assert {r["product_weight_g"] for r in dicts(impute_medians(raw["products"]))} == {None}
