import logging
from datetime import datetime
from decimal import Decimal

import pytest

from orderlens.__main__ import main
from orderlens.operators.delivered import DELIVERED_COLUMNS, delivered_orders
from orderlens.plans import etl_job
from orderlens.session import shuffle_settings, size_shuffles, stored_bytes, use_checkpoint_dir
from orderlens.sources import warehouse
from orderlens.sources.csv_files import read_all, read_table
from orderlens.sources.parquet_files import load_all, save_all, table_path
from orderlens.sources.tables import ALL_TABLES, ORDER_REVIEWS, PRODUCTS, SELLERS, published_columns
from orderlens.sources.warehouse import (
    MissingColumnsError,
    current_database,
    publish,
    published_tables,
    register_views,
)

FILES = {
    "shop_customers_dataset.csv": """customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state
c1,u1,01037,sao paulo,SP
c2,u1,14409,franca,SP
""",
    "shop_sellers_dataset.csv": """seller_id,seller_zip_code_prefix,seller_city,seller_state
s1,00123,campinas,SP
""",
    "shop_products_dataset.csv": """product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm
p1,casa,40,287,1,225,16,10,14
p2,,,,,1000,30,18,20
p3,casa,41,288,2,,,,
""",
    "product_category_name_translation.csv": "﻿product_category_name,product_category_name_english\ncasa,home\n",
    "shop_orders_dataset.csv": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date
o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,2017-10-04 19:55:00,2017-10-10 21:25:13,2017-10-18 00:00:00
o2,c2,shipped,2018-07-24 20:41:37,,oops,,2018-08-13 00:00:00
""",
    "shop_order_items_dataset.csv": """order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value
o1,1,p1,s1,2017-10-06 11:07:15,58.90,13.29
o1,2,p2,s1,2017-10-06 11:07:15,0.10,0.01
""",
    "shop_order_payments_dataset.csv": """order_id,payment_sequential,payment_type,payment_installments,payment_value
o1,1,credit_card,8,72.30
""",
    "shop_order_reviews_dataset.csv": '''review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp
r1,o1,4,,"Chegou antes,
do prazo ""ok""",2017-10-11 00:00:00,2017-10-12 03:43:48
r2,o1,5,,,2017-10-12 00:00:00,2017-10-13 03:43:48
''',
    "shop_geolocation_dataset.csv": """geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state
01037,-23.54562128115268,-46.63929204800168,sao paulo,SP
""",
}


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "raw"
    source.mkdir()
    for name, text in FILES.items():
        (source / name).write_text(text, encoding="utf-8")
    return source


def test_csv_types(spark, folder):
    raw = read_all(spark, str(folder))
    assert list(raw) == list(ALL_TABLES)
    assert [r[0] for r in raw["customers"].select("customer_zip_code_prefix").collect()] == [
        "01037", "14409"]
    assert raw["sellers"].first()["seller_zip_code_prefix"] == "00123"
    assert raw["order_items"].first()["price"] == Decimal("58.90")
    assert raw["category_translation"].columns[0] == "product_category_name"
    assert dict(raw["orders"].dtypes)["order_approved_at"] == "string"
    review = raw["order_reviews"].where("review_id = 'r1'").first()
    assert review["review_comment_message"] == 'Chegou antes,\ndo prazo "ok"'
    assert raw["products"].where("product_id = 'p2'").first()["product_category_name"] is None


def test_csv_columns_match_by_name(spark, folder):
    (folder / "shop_sellers_dataset.csv").write_text(
        "seller_state,note,seller_id,seller_zip_code_prefix,seller_city\nSP,x,s1,00123,campinas\n")
    sellers = read_table(spark, str(folder), SELLERS)
    assert sellers.first().asDict() == {
        "seller_state": "SP", "note": "x", "seller_id": "s1", "seller_zip_code_prefix": "00123",
        "seller_city": "campinas"}


def test_several_files_per_table(spark, folder):
    (folder / "more_sellers_dataset.csv").write_text(
        "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns2,00001,x,RJ\n")
    assert read_table(spark, str(folder), SELLERS).count() == 2


def test_missing_file_is_named(spark, folder):
    (folder / "shop_products_dataset.csv").rename(folder / "unused.txt")
    with pytest.raises(FileNotFoundError, match="products"):
        read_table(spark, str(folder), PRODUCTS)


def test_whole_job(spark, folder, tmp_path, caplog):
    target = str(tmp_path / "processed")
    with caplog.at_level(logging.INFO, logger="orderlens.plans.etl_job"):
        saved = etl_job.run(spark, str(folder), target, database="shop_a", batch="one")
    assert "orders: 2 rows, below expected" in caplog.text
    for name, table in ALL_TABLES.items():
        assert saved[name].columns == published_columns(table)
        assert spark.table(f"shop_a__one.{name}").columns == published_columns(table)
    assert current_database(spark, "shop_a") == "shop_a__one"
    view = spark.table("shop_a__one.v_delivered_orders")
    expected = delivered_orders(saved["orders"])
    assert tuple(view.columns) == DELIVERED_COLUMNS and dict(view.dtypes) == dict(expected.dtypes)
    assert view.collect() == expected.collect()
    orders = {r["order_id"]: r for r in saved["orders"].collect()}
    assert orders["o1"]["order_delivered_carrier_date"] == datetime(2017, 10, 4, 19, 55)
    assert orders["o2"]["order_delivered_carrier_date"] is None
    assert saved["order_reviews"].count() == 1
    products = {r["product_id"]: r for r in saved["products"].collect()}
    assert products["p3"]["product_weight_g"] == Decimal("612.5")
    assert products["p2"]["product_category_name_english"] == "unknown"

    # The job again, with other data: the old batch stays until there are too many.
    (folder / "shop_sellers_dataset.csv").write_text(
        "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,a,SP\ns2,2,b,RJ\n")
    etl_job.run(spark, str(folder), target, database="shop_a", batch="two")
    assert published_tables(spark, "shop_a")["sellers"].count() == 2
    assert spark.table("shop_a__one.sellers").count() == 1
    etl_job.run(spark, str(folder), target, database="shop_a", batch="zero")
    kept = [row[0] for row in spark.sql("SHOW DATABASES LIKE 'shop_a__*'").collect()]
    assert sorted(kept) == ["shop_a__two", "shop_a__zero"]


def test_duplicate_reviews_stop_the_job(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(
        etl_job, "clean_all", lambda raw, impute_by=None: dict(raw))
    with pytest.raises(ValueError, match="order_reviews: 1 rows repeat"):
        etl_job.run(spark, str(folder), str(tmp_path / "processed"))
    assert not (tmp_path / "processed" / "orders.parquet").exists()


def test_malformed_numbers_stop_the_job(spark, folder, tmp_path):
    items = folder / "shop_order_items_dataset.csv"
    items.write_text(items.read_text().replace("58.90", "12.3.4").replace("0.01", ""))
    with pytest.raises(etl_job.MalformedNumbersError, match="order_items.price: 1$"):
        etl_job.run(spark, str(folder), str(tmp_path / "processed"))
    assert not (tmp_path / "processed").exists()


def test_audits_see_the_raw_tables(spark, folder, tmp_path):
    orders = folder / "shop_orders_dataset.csv"
    orders.write_text(orders.read_text().replace("2017-10-04 19:55:00", "oops") + (
        "o3,c1,delivered,2018-01-01 00:00:00,,2018-01-02 00:00:00,2018-01-09 00:00:00,bad-date\n"))
    target = tmp_path / "p"
    etl_job.run(spark, str(folder), str(target))

    def audit(name):
        return spark.read.parquet(table_path(str(target / "audits"), name))

    durations = audit("audit_impossible_durations").first().asDict()
    assert durations == {"delivered_orders": 2, "carrier_before_purchase": 0,
                         "delivered_before_carrier": 0, "carrier_missing": 1}
    assert audit("audit_batch_deliveries").count() == 0
    assert tuple(audit("audit_duplicate_reviews").first()) == (1, 1)
    missing = {r["column_name"]: r["null_count"] for r in audit("audit_null_profile").where(
        "table_name = 'products'").collect()}
    assert missing["product_category_name"] == 1
    joint = audit("audit_missing_together").collect()
    assert any(1 in tuple(row) for row in joint)


def test_failed_publish_leaves_the_old_batch(spark, folder, tmp_path):
    saved = etl_job.run(spark, str(folder), str(tmp_path / "p"), database="shop_b", batch="one")
    broken = {**saved, "geolocation": saved["geolocation"].drop("geolocation_lat")}
    with pytest.raises(MissingColumnsError, match="geolocation_lat"):
        publish(spark, broken, "shop_b", "two")
    assert "shop_b__two" not in [row[0] for row in spark.sql("SHOW DATABASES").collect()]
    assert published_tables(spark, "shop_b")["orders"].count() == 2


def test_failed_switch_leaves_every_old_table(spark, folder, tmp_path, monkeypatch):
    saved = etl_job.run(spark, str(folder), str(tmp_path / "p"), database="shop_e", batch="one")

    def broken(*args):
        raise RuntimeError("lost the catalog")

    monkeypatch.setattr(warehouse, "_switch", broken)
    with pytest.raises(RuntimeError):
        publish(spark, {n: df.limit(0) for n, df in saved.items()}, "shop_e", "two")
    found = published_tables(spark, "shop_e")
    assert all(found[name].count() == saved[name].count() > 0 for name in ALL_TABLES)


def test_nothing_published(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop_empty")
    with pytest.raises(LookupError, match="shop_empty"):
        published_tables(spark, "shop_empty")


def test_bucketed_tables_join_without_a_shuffle(spark, folder, tmp_path):
    from orderlens.operators.delivered import order_values

    saved = etl_job.run(spark, str(folder), str(tmp_path / "p"))
    publish(spark, saved, "shop_c", "one",
            buckets={"orders": ("order_id", 4), "order_items": ("order_id", 4)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = published_tables(spark, "shop_c")
        joined = t["orders"].join(order_values(t["order_items"]), "order_id")
        assert joined.count() == 1
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_views_for_sql(spark, folder, tmp_path):
    saved = etl_job.run(spark, str(folder), str(tmp_path / "p"))
    register_views(saved)
    view = spark.sql("SELECT * FROM v_delivered_orders")
    assert tuple(view.columns) == DELIVERED_COLUMNS
    total = spark.sql(
        "SELECT SUM(i.price + i.freight_value) FROM v_delivered_orders v"
        " JOIN order_items i ON i.order_id = v.order_id").first()[0]
    assert total == Decimal("72.30")


def test_command_line(spark, folder, tmp_path, capsys):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    main(["load", str(folder), str(tmp_path / "p"), "--database", "shop_d", "--batch", "one"])
    assert spark.table("shop_d__one.orders").count() == 2
    main(["query", "late_delivery_rate", "--database", "shop_d"])
    assert "|1               |0          |0.0          |8.44" in capsys.readouterr().out
    out = str(tmp_path / "result")
    main(["query", "delivered_orders", "--database", "shop_d", "--output", out])
    assert spark.read.parquet(out).count() == 1
    main(["query", "audit_duplicate_reviews", "--source", str(folder)])
    main(["query", "audit_duplicate_reviews", "--tables", str(tmp_path / "p" / "raw")])
    assert capsys.readouterr().out.count("|1            |1         |") == 2
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffle_partitions_follow_the_data():
    assert shuffle_settings(0) == {"spark.sql.shuffle.partitions": "200"}
    assert shuffle_settings(25 << 40) == {"spark.sql.shuffle.partitions": "204800"}


def test_shuffle_partitions_follow_the_files(spark, tmp_path):
    for name, size in (("a", 1000), ("b", 24)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part").write_bytes(b"x" * size)
    assert stored_bytes(spark, str(tmp_path)) == 1024
    assert stored_bytes(spark, str(tmp_path / "a"), f"file://{tmp_path}/b") == 1024
    before = spark.conf.get("spark.sql.shuffle.partitions")
    size_shuffles(spark, 100 << 30)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "800"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_orders_are_sorted_by_purchase_inside_files(spark, folder, tmp_path):
    raw = read_all(spark, str(folder))
    save_all({"orders": raw["orders"].orderBy("order_id", ascending=False)}, str(tmp_path))
    kept = spark.read.parquet(table_path(str(tmp_path), "orders")).collect()
    bought = [r["order_purchase_timestamp"] for r in kept]
    assert bought == sorted(bought)


def test_text_with_line_breaks_is_only_expected_in_reviews():
    assert [t.name for t in ALL_TABLES.values() if t.quoted_newlines] == [ORDER_REVIEWS.name]


def test_checkpoints_go_to_the_folder_the_cluster_names():
    class Context:
        def __init__(self, master, folder=None):
            self.master, self.folder = master, folder

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, folder=None, setting=None):
            self.sparkContext = Context(master, folder)
            self.conf = {"spark.checkpoint.dir": setting} if setting else {}

    cluster = Session("yarn", setting="hdfs:///shared/checkpoints")
    use_checkpoint_dir(cluster)
    assert cluster.sparkContext.folder == "hdfs:///shared/checkpoints"
    already = Session("yarn", folder="hdfs:///other", setting="hdfs:///shared/checkpoints")
    use_checkpoint_dir(already)
    assert already.sparkContext.folder == "hdfs:///other"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        use_checkpoint_dir(Session("yarn"))
    local = Session("local[4]")
    use_checkpoint_dir(local)
    assert local.sparkContext.folder


def test_malformed_values_are_counted_and_kept(spark, folder, tmp_path, caplog):
    items = folder / "shop_order_items_dataset.csv"
    items.write_text(items.read_text().replace("58.90", "12.3.4").replace("o1,2,p2,s1,2017", "o1,2,p2,s1,x2017"))
    (folder / "more_sellers_dataset.csv").write_text(
        "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns2,00001,x,RJ\n")
    target = str(tmp_path / "p")
    with caplog.at_level(logging.WARNING, logger="orderlens.plans.etl_job"):
        assert etl_job.ingest(spark, str(folder), target, allow_malformed=True) == 3
    assert "order_items.price: 1 malformed" in caplog.text and "order_items.freight_value" not in caplog.text
    kept = spark.read.parquet(table_path(target, etl_job.QUARANTINE)).collect()
    found = sorted((r.table_name, r.column_name, r.value, r.file.rsplit("/", 1)[1]) for r in kept)
    assert found == [
        ("order_items", "price", "12.3.4", "shop_order_items_dataset.csv"),
        ("order_items", "shipping_limit_date", "x2017-10-06 11:07:15", "shop_order_items_dataset.csv"),
        ("orders", "order_delivered_carrier_date", "oops", "shop_orders_dataset.csv"),
    ]
    raw = load_all(spark, f"{target}/raw")
    assert raw["order_items"].columns == ALL_TABLES["order_items"].schema.names
    prices = {r.order_item_id: (r.price, r.shipping_limit_date) for r in raw["order_items"].collect()}
    assert prices == {1: (None, datetime(2017, 10, 6, 11, 7, 15)), 2: (Decimal("0.10"), None)}
    assert raw["sellers"].count() == 2

    # the values are gone from the next load, and from its quarantine
    items.write_text(FILES["shop_order_items_dataset.csv"])
    assert etl_job.ingest(spark, str(folder), target) == 1
    assert spark.read.parquet(table_path(target, etl_job.QUARANTINE)).count() == 1


def test_a_stopped_load_leaves_the_one_before(spark, folder, tmp_path):
    target = str(tmp_path / "p")
    assert etl_job.ingest(spark, str(folder), target) == 1
    reviews = folder / "shop_order_reviews_dataset.csv"
    reviews.write_text(reviews.read_text().replace("r2,o1,5", "r2,o1,five"))
    with pytest.raises(etl_job.MalformedNumbersError, match="order_reviews.review_score: 1$"):
        etl_job.ingest(spark, str(folder), target)
    assert load_all(spark, f"{target}/raw")["order_reviews"].count() == 2
    assert len(list((tmp_path / "p" / "raw").glob("batch-*"))) == 1


def test_each_file_is_scanned_once(spark, folder, tmp_path):
    """One scan of the files a table in the plans that ran, apart from the headers."""
    plans = []
    from orderlens.sources import csv_files

    for table in ALL_TABLES.values():
        part = csv_files.parsed(spark, str(folder), table)
        plan = part.rows._jdf.queryExecution().executedPlan().toString()
        plans.append(plan.count("FileScan csv"))
    assert plans == [1] * len(ALL_TABLES)


def test_saved_rows_against_raw_rows(spark, folder, tmp_path, caplog):
    target = str(tmp_path / "p")
    with caplog.at_level(logging.INFO, logger="orderlens.plans.etl_job"):
        saved = etl_job.run(spark, str(folder), target)
    found = {r.table_name: r for r in etl_job.saved_rows(spark, target).collect()}
    raw = load_all(spark, f"{target}/raw")
    assert set(found) == set(ALL_TABLES)
    for name, row in found.items():
        assert (row.rows_before, row.rows_after) == (raw[name].count(), saved[name].count())
        assert f"saved {name}: {row.rows_after} of {row.rows_before} rows" in caplog.text
    assert sum(r.lost for r in found.values()) > 0
