"""The nine source tables: columns, types, keys and references.

Identifiers and zip prefixes are strings, so leading zeros survive. Columns
declared as timestamps arrive as text in the CSV files and are parsed during
cleaning. ``nullable=False`` marks columns the audits check for NULLs; Spark
itself does not enforce it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TEXT = T.StringType()
WHOLE = T.IntegerType()
COUNT = T.DecimalType(10, 0)
MONEY = T.DecimalType(12, 2)
MEASURE = T.DecimalType(12, 2)
DEGREES = T.DoubleType()
MOMENT = T.TimestampNTZType()


@dataclass(frozen=True)
class Reference:
    """A column whose values must exist as the key of another table."""

    column: str
    table: str
    key: str


@dataclass(frozen=True)
class Table:
    name: str
    file_pattern: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    references: tuple[Reference, ...] = ()
    quoted_newlines: bool = False

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]

    @property
    def moments(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.dataType == MOMENT]


def _schema(**columns) -> T.StructType:
    """Columns by name; a type wrapped in a one-element list is NOT NULL."""
    return T.StructType(
        [
            T.StructField(name, kind[0], False)
            if isinstance(kind, list)
            else T.StructField(name, kind, True)
            for name, kind in columns.items()
        ]
    )


CUSTOMERS = Table(
    "customers",
    "*customers_dataset.csv",
    _schema(
        customer_id=[TEXT],
        customer_unique_id=[TEXT],
        customer_zip_code_prefix=TEXT,
        customer_city=TEXT,
        customer_state=TEXT,
    ),
    key=("customer_id",),
)
SELLERS = Table(
    "sellers",
    "*sellers_dataset.csv",
    _schema(
        seller_id=[TEXT], seller_zip_code_prefix=TEXT, seller_city=TEXT, seller_state=TEXT
    ),
    key=("seller_id",),
)
# The spelling "lenght" is the source's own.
PRODUCTS = Table(
    "products",
    "*products_dataset.csv",
    _schema(
        product_id=[TEXT],
        product_category_name=TEXT,
        product_name_lenght=COUNT,
        product_description_lenght=COUNT,
        product_photos_qty=COUNT,
        product_weight_g=MEASURE,
        product_length_cm=MEASURE,
        product_height_cm=MEASURE,
        product_width_cm=MEASURE,
    ),
    key=("product_id",),
)
CATEGORY_TRANSLATION = Table(
    "category_translation",
    "*product_category_name_translation.csv",
    _schema(product_category_name=[TEXT], product_category_name_english=TEXT),
    key=("product_category_name",),
)
ORDERS = Table(
    "orders",
    "*orders_dataset.csv",
    _schema(
        order_id=[TEXT],
        customer_id=[TEXT],
        order_status=[TEXT],
        order_purchase_timestamp=MOMENT,
        order_approved_at=MOMENT,
        order_delivered_carrier_date=MOMENT,
        order_delivered_customer_date=MOMENT,
        order_estimated_delivery_date=MOMENT,
    ),
    key=("order_id",),
    references=(Reference("customer_id", "customers", "customer_id"),),
)
ORDER_ITEMS = Table(
    "order_items",
    "*order_items_dataset.csv",
    _schema(
        order_id=[TEXT],
        order_item_id=[WHOLE],
        product_id=[TEXT],
        seller_id=[TEXT],
        shipping_limit_date=MOMENT,
        price=[MONEY],
        freight_value=[MONEY],
    ),
    key=("order_id", "order_item_id"),
    references=(
        Reference("order_id", "orders", "order_id"),
        Reference("product_id", "products", "product_id"),
        Reference("seller_id", "sellers", "seller_id"),
    ),
)
ORDER_PAYMENTS = Table(
    "order_payments",
    "*order_payments_dataset.csv",
    _schema(
        order_id=[TEXT],
        payment_sequential=[WHOLE],
        payment_type=TEXT,
        payment_installments=WHOLE,
        payment_value=MONEY,
    ),
    key=("order_id", "payment_sequential"),
    references=(Reference("order_id", "orders", "order_id"),),
)
# order_id is the key once cleaning has kept one review per order. Review texts
# may contain quoted line breaks.
ORDER_REVIEWS = Table(
    "order_reviews",
    "*order_reviews_dataset.csv",
    _schema(
        review_id=TEXT,
        order_id=[TEXT],
        review_score=[WHOLE],
        review_comment_title=TEXT,
        review_comment_message=TEXT,
        review_creation_date=MOMENT,
        review_answer_timestamp=MOMENT,
    ),
    key=("order_id",),
    references=(Reference("order_id", "orders", "order_id"),),
    quoted_newlines=True,
)
GEOLOCATION = Table(
    "geolocation",
    "*geolocation_dataset.csv",
    _schema(
        geolocation_zip_code_prefix=TEXT,
        geolocation_lat=DEGREES,
        geolocation_lng=DEGREES,
        geolocation_city=TEXT,
        geolocation_state=TEXT,
    ),
)

# Referenced tables come before the tables that refer to them.
ALL_TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        CUSTOMERS,
        SELLERS,
        PRODUCTS,
        CATEGORY_TRANSLATION,
        ORDERS,
        ORDER_ITEMS,
        ORDER_PAYMENTS,
        ORDER_REVIEWS,
        GEOLOCATION,
    )
}

# Column added to products by cleaning.
ENGLISH_CATEGORY = "product_category_name_english"


def published_columns(table: Table) -> list[str]:
    """Columns of the published table, in order."""
    extra = [ENGLISH_CATEGORY] if table is PRODUCTS else []
    return [*table.schema.names, *extra]
