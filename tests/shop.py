"""A small shop written out by hand."""

from decimal import Decimal

from orderlens.operators.cleaning import clean_all

ORDER_COLUMNS = (
    "order_id string, customer_id string, order_status string, order_purchase_timestamp string,"
    " order_approved_at string, order_delivered_carrier_date string,"
    " order_delivered_customer_date string, order_estimated_delivery_date string"
)
REVIEW_COLUMNS = (
    "review_id string, order_id string, review_score int, review_comment_title string,"
    " review_comment_message string, review_creation_date string, review_answer_timestamp string"
)
ITEM_COLUMNS = (
    "order_id string, order_item_id int, product_id string, seller_id string,"
    " shipping_limit_date string, price decimal(12,2), freight_value decimal(12,2)"
)
PRODUCT_COLUMNS = (
    "product_id string, product_category_name string, product_name_lenght decimal(10,0),"
    " product_description_lenght decimal(10,0), product_photos_qty decimal(10,0),"
    " product_weight_g decimal(12,2), product_length_cm decimal(12,2),"
    " product_height_cm decimal(12,2), product_width_cm decimal(12,2)"
)


def order(
    order_id, bought, delivered=None, promised=None, carrier=None, status="delivered", customer=None
):
    return (order_id, customer or f"c-{order_id}", status, bought, None, carrier, delivered, promised)


def review(review_id, order_id, score, answered):
    return (review_id, order_id, score, None, None, None, answered)


def item(order_id, line, product, seller, price, freight="0.00"):
    return (order_id, line, product, seller, None, Decimal(price), Decimal(freight))


def product(product_id, category, weight=None, size=None):
    weight, size = (None if v is None else Decimal(v) for v in (weight, size))
    return (product_id, category, None, None, None, weight, size, size, size)


def raw_shop(
    spark,
    orders=(),
    reviews=(),
    items=(),
    products=(),
    sellers=(),
    customers=None,
    translation=(("casa", "home"), ("arte", "art")),
):
    """Raw tables; every order gets a customer of its own in state SP unless given."""
    orders = list(orders)
    if customers is None:
        customers = [(c, f"u-{c}", "01037", "x", "SP") for c in sorted({o[1] for o in orders})]
    return {
        "customers": spark.createDataFrame(
            list(customers),
            "customer_id string, customer_unique_id string, customer_zip_code_prefix string,"
            " customer_city string, customer_state string",
        ),
        "sellers": spark.createDataFrame(
            [(s, "09999", "x", state) for s, state in sellers],
            "seller_id string, seller_zip_code_prefix string, seller_city string,"
            " seller_state string",
        ),
        "products": spark.createDataFrame(list(products), PRODUCT_COLUMNS),
        "category_translation": spark.createDataFrame(
            list(translation),
            "product_category_name string, product_category_name_english string",
        ),
        "orders": spark.createDataFrame(orders, ORDER_COLUMNS),
        "order_items": spark.createDataFrame(list(items), ITEM_COLUMNS),
        "order_payments": spark.createDataFrame(
            [],
            "order_id string, payment_sequential int, payment_type string,"
            " payment_installments int, payment_value decimal(12,2)",
        ),
        "order_reviews": spark.createDataFrame(list(reviews), REVIEW_COLUMNS),
        "geolocation": spark.createDataFrame(
            [],
            "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double,"
            " geolocation_city string, geolocation_state string",
        ),
    }


def shop(spark, **parts):
    return clean_all(raw_shop(spark, **parts))


def rows(df):
    return [tuple(r) for r in df.collect()]


def dicts(df):
    return [r.asDict() for r in df.collect()]
