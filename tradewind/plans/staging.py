"""Staging models: cleaned names over the raw tables, rows without a key left out."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Staging:
    table: str
    keys: tuple[str, ...]
    # staged name: raw name
    columns: dict[str, str]
    # staged name: what stands in for null
    defaults: dict[str, str] = field(default_factory=dict)


# The nine models, each over one raw table.
STAGING = {
    "stg_orders": Staging("orders", ("order_id",), {
        "order_id": "order_id",
        "customer_id": "customer_id",
        "order_status": "order_status",
        "purchased_at": "order_purchase_timestamp",
        "approved_at": "order_approved_at",
        "delivered_to_carrier_at": "order_delivered_carrier_date",
        "delivered_to_customer_at": "order_delivered_customer_date",
        "estimated_delivery_at": "order_estimated_delivery_date",
    }),
    "stg_order_items": Staging("order_items", ("order_id",), {
        "order_id": "order_id",
        "order_item_id": "order_item_id",
        "product_id": "product_id",
        "seller_id": "seller_id",
        "shipping_limit_at": "shipping_limit_date",
        "item_price": "price",
        "freight_value": "freight_value",
    }),
    "stg_order_payments": Staging("order_payments", ("order_id",), {
        "order_id": "order_id",
        "payment_sequential": "payment_sequential",
        "payment_type": "payment_type",
        "payment_installments": "payment_installments",
        "payment_value": "payment_value",
    }),
    "stg_order_reviews": Staging("order_reviews", ("review_id", "order_id"), {
        "review_id": "review_id",
        "order_id": "order_id",
        "review_score": "review_score",
        "comment_title": "review_comment_title",
        "comment_message": "review_comment_message",
        "created_at": "review_creation_date",
        "answered_at": "review_answer_timestamp",
    }),
    "stg_customers": Staging("customers", ("customer_id",), {
        "customer_id": "customer_id",
        "customer_unique_id": "customer_unique_id",
        "zip_code_prefix": "customer_zip_code_prefix",
        "city": "customer_city",
        "state": "customer_state",
    }),
    "stg_sellers": Staging("sellers", ("seller_id",), {
        "seller_id": "seller_id",
        "zip_code_prefix": "seller_zip_code_prefix",
        "city": "seller_city",
        "state": "seller_state",
    }),
    "stg_products": Staging("products", ("product_id",), {
        "product_id": "product_id",
        "category_name": "product_category_name",
        "product_name_length": "product_name_lenght",
        "product_description_length": "product_description_lenght",
        "photos_qty": "product_photos_qty",
        "weight_g": "product_weight_g",
        "length_cm": "product_length_cm",
        "height_cm": "product_height_cm",
        "width_cm": "product_width_cm",
    }, {"category_name": "unknown"}),
    "stg_geolocation": Staging("geolocation", ("geolocation_zip_code_prefix",), {
        "zip_code_prefix": "geolocation_zip_code_prefix",
        "latitude": "geolocation_lat",
        "longitude": "geolocation_lng",
        "city": "geolocation_city",
        "state": "geolocation_state",
    }),
    "stg_category_translation": Staging("category_translation", ("product_category_name",), {
        "category_name": "product_category_name",
        "category_name_english": "product_category_name_english",
    }),
}


def stage(model: str, raw: DataFrame) -> DataFrame:
    """The staging model over its raw table."""
    staging = STAGING[model]
    has_keys = " AND ".join(f"{key} IS NOT NULL" for key in staging.keys)
    renamed = rename(model, raw.where(has_keys))
    return renamed.fillna(staging.defaults) if staging.defaults else renamed


def rename(model: str, raw: DataFrame) -> DataFrame:
    """Staged names over every raw row, for running the checks on the raw tables."""
    columns = STAGING[model].columns.items()
    return raw.selectExpr(*[f"{source} AS {name}" for name, source in columns])
