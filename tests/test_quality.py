from datetime import date
from decimal import Decimal

import pytest

from orderlens.operators import quality
from orderlens.settings import RowFloor, Settings
from orderlens.sources.warehouse import MissingColumnsError, published_form
from tests.shop import dicts, item, order, product, raw_shop, review, shop


@pytest.fixture(scope="module")
def audited(spark):
    return shop(
        spark,
        orders=[
            order("good", "2017-03-01 00:00:00", "2017-03-05 00:00:00", "2017-03-10 00:00:00",
                  carrier="2017-03-02 00:00:00"),
            order("undated", "2017-03-01 00:00:00", None, "2017-03-10 00:00:00"),
            order("early", "2017-03-03 00:00:00", "2017-03-05 00:00:00", "2017-03-10 00:00:00",
                  carrier="2017-03-02 00:00:00"),
            order("swapped", "2017-03-01 00:00:00", "2017-03-05 00:00:00", "2017-03-10 00:00:00",
                  carrier="2017-03-06 00:00:00"),
            order("nocarrier", "2016-12-31 23:00:00", "2017-01-05 00:00:00", "2017-03-10 00:00:00"),
            order("gone", "2017-03-01 00:00:00", status="unavailable"),
        ],
        items=[item("good", 1, "p1", "s1", "1"), item("good", 1, "p9", "s1", "1"),
               item("lost", 1, "p1", "s9", "1"), item("lost", 2, "p1", "s9", "1")],
        reviews=[review("r1", "good", 5, None), review("r2", "good", 4, None)],
        products=[product("p1", "casa", Decimal(1), Decimal(1)), product("p2", None)],
        sellers=[("s1", "SP")],
        customers=[("c-good", "u1", "01037", "x", "SP"), ("c-undated", "u1", None, "x", "SP"),
                   ("c-early", "u2", "01037", "x", "SP")],
    )


@pytest.fixture(scope="module")
def raw(spark):
    return raw_shop(
        spark,
        orders=[order("a", "2017-01-01 00:00:00"), order("a", "2017-01-01 00:00:00")],
        reviews=[review("r1", "a", 1, None), review("r2", "a", 1, None), review("r3", None, 1, None),
                 review("r4", None, 1, None)],
    )


def by(df, *key):
    return {tuple(r[k] for k in key): r for r in dicts(df)}


def test_row_counts_and_floors(spark, audited):
    counts = by(quality.row_counts(audited), "table_name")
    assert counts[("orders",)]["row_count"] == 6
    assert counts[("products",)] == {"table_name": "products", "row_count": 2, "column_count": 10}
    floors = [RowFloor("orders", 7), RowFloor("customers", 3)]
    status = by(quality.row_floors(audited, floors), "table_name")
    assert status[("orders",)]["status"] == "below expected"
    assert status[("customers",)]["status"] == "passed"


def test_repeated_keys(raw, audited):
    found = by(quality.primary_keys(raw), "table_name")
    assert (found[("orders",)]["repeated_keys"], found[("orders",)]["extra_rows"]) == (1, 1)
    # NULL keys repeat each other.
    assert (found[("order_reviews",)]["repeated_keys"], found[("order_reviews",)]["extra_rows"]) == (2, 2)
    assert found[("order_payments",)]["extra_rows"] == 0
    with pytest.raises(quality.DuplicateKeyError, match="order_reviews: 2 rows"):
        quality.require_unique(raw["order_reviews"], ("order_id",), "order_reviews")
    quality.require_unique(audited["order_reviews"], ("order_id",), "order_reviews")


def test_nulls(raw, audited):
    required = by(quality.required_columns(raw), "table_name", "column_name")
    assert required[("order_reviews", "order_id")]["null_count"] == 2
    assert required[("orders", "order_id")]["null_count"] == 0
    assert ("customers", "customer_city") not in required
    profile = by(quality.null_profile(audited), "table_name", "column_name")
    assert profile[("customers", "customer_zip_code_prefix")]["null_pct"] == 33.33
    assert profile[("geolocation", "geolocation_lat")] == {
        "table_name": "geolocation", "column_name": "geolocation_lat", "row_count": 0,
        "null_count": 0, "null_pct": None,
    }


def test_columns_missing_in_the_same_rows(spark):
    products = raw_shop(
        spark, products=[product("a", None), product("b", "casa"), product("c", None)]
    )["products"]
    found = by(quality.missing_together(products, ["product_category_name", "product_photos_qty"]),
               "column_name")
    assert found[("product_category_name",)]["null_count"] == 2
    assert found[("product_photos_qty",)]["null_count"] == 3
    assert {(r["all_null"], r["any_null"]) for r in found.values()} == {(2, 3)}


def test_orphans(audited):
    found = by(quality.foreign_keys(audited), "table_name", "column_name")
    pick = lambda *k: (found[k]["orphan_keys"], found[k]["orphan_rows"])
    assert pick("order_items", "order_id") == (1, 2)
    assert pick("order_items", "product_id") == (1, 1)
    assert pick("order_items", "seller_id") == (1, 2)
    assert pick("orders", "customer_id") == (3, 3)
    assert pick("order_reviews", "order_id") == (0, 0)


def test_orders_without_reviews_or_items(audited):
    assert by(quality.unreviewed_orders(audited), "population")[("without review",)]["orders"] == 5
    assert {(r["order_status"], r["orders"]) for r in dicts(quality.itemless_orders(audited))} == {
        ("delivered", 4), ("unavailable", 1)}


def test_delivery_anomalies(audited):
    assert dicts(quality.undated_deliveries(audited)) == [
        {"delivered_orders": 5, "undated_orders": 1}]
    assert dicts(quality.impossible_durations(audited)) == [
        {"delivered_orders": 4, "carrier_before_purchase": 1, "delivered_before_carrier": 1,
         "carrier_missing": 1}]


def test_batch_deliveries(spark):
    shared = "2017-09-19 10:00:00"
    orders = [
        order(f"o{i}", f"2017-02-{1 + 3 * i:02d} 00:00:00", shared, "2017-03-10 00:00:00")
        for i in range(8)
    ] + [order("other", "2017-08-01 00:00:00", "2017-09-20 00:00:00", "2017-09-18 00:00:00")]
    found = by(quality.batch_deliveries(shop(spark, orders=orders), Settings()), "delivery_date")
    batch = found[(date(2017, 9, 19),)]
    assert (batch["late_orders"], batch["purchase_spread_days"], batch["max_days_late"]) == (8, 21, 193)
    assert batch["is_batch"] is True
    assert found[(date(2017, 9, 20),)]["is_batch"] is False


def test_identity_and_coverage(audited):
    found = by(quality.customer_identity(audited), "id_column")
    assert found[("customer_id",)]["distinct_ids"] == 3
    assert found[("customer_unique_id",)] == {
        "id_column": "customer_unique_id", "distinct_ids": 2, "max_rows_per_id": 2}
    assert dicts(quality.window_coverage(audited, Settings())) == [
        {"first_purchase_date": date(2016, 12, 31), "last_purchase_date": date(2017, 3, 3),
         "delivered_orders": 4, "delivered_in_window": 3, "in_window_pct": 75.0}]


def test_published_form_checks_columns(audited):
    extra = audited["sellers"].selectExpr("*", "1 AS extra")
    assert published_form("sellers", extra).columns == [
        "seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]
    with pytest.raises(MissingColumnsError, match="seller_city"):
        published_form("sellers", extra.drop("seller_city"))


def test_audits_share_one_pass_over_each_table(spark, audited, tmp_path):
    """The shared pass gives the rows that each audit gives alone, from one scan a table."""
    import re

    from orderlens.plans import etl_job
    from orderlens.plans.catalogue import AUDITS

    paths = {name: f"{tmp_path}/{name}" for name in audited}
    for name, path in paths.items():
        audited[name].write.parquet(path)
    saved = {name: spark.read.parquet(path) for name, path in paths.items()}
    scanning = [q for q in AUDITS.values() if isinstance(q, quality.ScanAudit)]
    assert len(scanning) == 8
    shared = quality.profile(saved, quality.shared_measures(scanning, saved, Settings()))
    text = shared._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", text)) == len(saved)
    etl_job.audit(saved, str(tmp_path / "audits"))
    for name, query in AUDITS.items():
        kept = spark.read.parquet(f"{tmp_path}/audits/{name}.parquet")
        alone = query(audited, Settings())
        assert kept.columns == alone.columns
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, alone.collect())), name


def test_missing_groups_are_found_without_a_list(spark):
    import random

    draw = random.Random(2)
    rows = []
    for i in range(400):
        a, b = draw.random() < 0.2, draw.random() < 0.1
        rows.append((i, None if a else 1, None if a else "x", None if b else 2.0, None if b and i % 2 else 3,
                     None if b else "y", None if a else True))
    df = spark.createDataFrame(rows, "id int, a1 int, a2 string, b1 double, c int, b2 string, a3 boolean")
    tables = {"t": df.repartition(7), "none": df.select("id"), "empty": df.limit(0), "all": df.selectExpr(
        "CAST(NULL AS INT) AS x", "CAST(NULL AS INT) AS y", "id")}
    found = {(r.table_name, r.column_names): r.null_count for r in quality.missing_groups(tables).collect()}
    assert found == {
        ("t", "a1, a2, a3"): sum(r[1] is None for r in rows),
        ("t", "b1, b2"): sum(r[3] is None for r in rows),
        ("all", "x, y"): 400,
    }


def test_the_catalogue_group_is_found(spark):
    """In raw tables; cleaning fills the categories."""
    one = Decimal(1)
    tables = raw_shop(spark, products=[("p1", "casa", *[one] * 7), ("p2", *[None] * 4, *[one] * 4)])
    found = {r.table_name: r.column_names for r in quality.missing_groups(tables).collect()}
    assert "product_category_name" in found["products"]


def test_key_relations(spark):
    rows = [(f"c{i}", f"u{i // 2}", f"k{i}", f"o{i % 7}" if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows + rows[:9], "customer_id string, person_id string, other_id string, group_id string")
    found = {(r.determinant, r.dependent): (r.distinct_values, r.both_ways)
             for r in quality.key_relations({"t": df, "empty": df.limit(0)}).collect()}
    assert found == {
        ("customer_id", "person_id"): (500, False), ("customer_id", "other_id"): (500, True),
        ("customer_id", "group_id"): (400, False), ("other_id", "customer_id"): (500, True),
        ("other_id", "person_id"): (500, False), ("other_id", "group_id"): (400, False),
    }
    assert ("person_id", "group_id") not in quality.possible_dependencies(df, quality.identifiers("t", df))
    assert quality.key_relations({"t": df.select("customer_id")}).collect() == []


def test_one_broken_value_is_seen(spark):
    """A sketch cannot tell one exception among many values; the exact check does."""
    df = spark.range(3000).selectExpr("CAST(id AS STRING) AS a_id", "CAST(id div 2 AS STRING) AS b_id")
    broken = df.unionByName(spark.createDataFrame([("7", "x")], "a_id string, b_id string"))
    assert ("a_id", "b_id") in quality.possible_dependencies(broken, ["a_id", "b_id"])
    assert [(r.determinant, r.dependent) for r in quality.key_relations({"t": df}).collect()] == [("a_id", "b_id")]
    assert quality.key_relations({"t": broken}).collect() == []
