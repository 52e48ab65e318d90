"""The nine raw tables: columns, types and the way each one arrives."""

from pyspark.sql import types as T

# Column names and types of the raw tables, in file order.
RAW_COLUMNS = {
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp_ntz",
        "order_approved_at": "timestamp_ntz",
        "order_delivered_carrier_date": "timestamp_ntz",
        "order_delivered_customer_date": "timestamp_ntz",
        "order_estimated_delivery_date": "timestamp_ntz",
    },
    "order_reviews": {
        "review_id": "string",
        "order_id": "string",
        "review_score": "bigint",
        "review_comment_title": "string",
        "review_comment_message": "string",
        "review_creation_date": "timestamp_ntz",
        "review_answer_timestamp": "timestamp_ntz",
    },
    "order_items": {
        "order_id": "string",
        "order_item_id": "bigint",
        "product_id": "string",
        "seller_id": "string",
        "shipping_limit_date": "timestamp_ntz",
        "price": "double",
        "freight_value": "double",
    },
    "order_payments": {
        "order_id": "string",
        "payment_sequential": "bigint",
        "payment_type": "string",
        "payment_installments": "bigint",
        "payment_value": "double",
    },
    "customers": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_zip_code_prefix": "string",
        "customer_city": "string",
        "customer_state": "string",
    },
    "sellers": {
        "seller_id": "string",
        "seller_zip_code_prefix": "string",
        "seller_city": "string",
        "seller_state": "string",
    },
    "products": {
        "product_id": "string",
        "product_category_name": "string",
        "product_name_lenght": "bigint",
        "product_description_lenght": "bigint",
        "product_photos_qty": "bigint",
        "product_weight_g": "double",
        "product_length_cm": "double",
        "product_height_cm": "double",
        "product_width_cm": "double",
    },
    "geolocation": {
        "geolocation_zip_code_prefix": "string",
        "geolocation_lat": "double",
        "geolocation_lng": "double",
        "geolocation_city": "string",
        "geolocation_state": "string",
    },
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
}

# The tables that arrive month by month, and the column that dates a row.
MONTH_KEY = {
    "orders": "order_purchase_timestamp",
    "order_reviews": "review_creation_date",
}

STATIC_TABLES = tuple(table for table in RAW_COLUMNS if table not in MONTH_KEY)

# Free text in these files may hold line breaks inside quotes.
MULTILINE_TABLES = ("order_reviews",)

# Partition column of the month-split raw tables, "YYYY-MM".
PARTITION_MONTH = "partition_month"

# Partition column of the stored order mart, "YYYY-MM".
PURCHASE_MONTH = "purchase_month"

# Fixed value: the status that makes an order count.
DELIVERED = "delivered"

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp_ntz": T.TimestampNTZType(),
}

# Stored marts. The month of fct_orders is a partition directory, so it comes last.
MART_COLUMNS = {
    "fct_orders": {
        "purchased_at": "timestamp_ntz",
        "order_id": "string",
        "total_order_revenue": "double",
        PURCHASE_MONTH: "string",
    },
    "fct_delivery_by_state": {"state": "string", "days_to_delivery": "bigint"},
    "fct_seller_revenue": {"seller_id": "string", "item_gross_revenue": "double"},
}

# By month, a digest of the names of the raw files a mart was built from.
BUILT_FROM = {"month": "string", "files": "string"}


def struct(columns: dict[str, str]) -> T.StructType:
    """A schema with every field nullable."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


def raw_schema(table: str) -> T.StructType:
    """Declared schema of a stored raw table, partition column included."""
    schema = struct(RAW_COLUMNS[table])
    return schema.add(PARTITION_MONTH, T.StringType()) if table in MONTH_KEY else schema


def mart_schema(mart: str) -> T.StructType:
    return struct(MART_COLUMNS[mart])
