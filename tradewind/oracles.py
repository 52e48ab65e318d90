"""The queries as ANSI SQL over the driver's tables, to check the Spark results against."""

from tradewind.operators.quality import ACCEPTED, CHECKS, NOT_NULL, UNIQUE, Check
from tradewind.queries import LATER_FROM, MID_MONTH, MONTH, MONTH_CHECKS
from tradewind.schemas import MART_COLUMNS, RAW_COLUMNS, STATIC_TABLES
from tradewind.standins import DELIVERED_STANDIN



def _exact_sum(amount: str) -> str:
    """Sum of doubles as the decimals they stand for, by way of text, which rounds nothing."""
    exact = f"CAST(CAST({amount} AS VARCHAR) AS DECIMAL(38, 18))"
    return f"CAST(CAST(sum({exact}) AS VARCHAR) AS DOUBLE)"


# Fixed names: tables and columns are those of the schemas and staging models.
# The raw tables, the staging models and the marts, each as a named subquery.
_MODELS = f"""
WITH raw_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp,
         CAST(NULL AS TIMESTAMP) AS order_approved_at,
         CAST(NULL AS TIMESTAMP) AS order_delivered_carrier_date,
         last_shipped AS order_delivered_customer_date,
         CAST(NULL AS TIMESTAMP) AS order_estimated_delivery_date
  FROM orders LEFT JOIN
       (SELECT l_orderkey, max(l_shipdate) AS last_shipped FROM lineitem GROUP BY l_orderkey) s
       ON l_orderkey = o_orderkey
), raw_order_reviews AS (
  SELECT CAST(event_id AS VARCHAR) AS review_id,
         CAST(user_id AS VARCHAR) AS order_id,
         CAST(trunc(value) AS BIGINT) AS review_score,
         event_type AS review_comment_title,
         props AS review_comment_message,
         ts AS review_creation_date,
         ts AS review_answer_timestamp
  FROM events
), raw_order_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         CAST(l_linenumber AS BIGINT) AS order_item_id,
         CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(l_suppkey AS VARCHAR) AS seller_id,
         l_shipdate AS shipping_limit_date,
         l_extendedprice AS price,
         l_tax AS freight_value
  FROM lineitem
), raw_order_payments AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         CAST(l_linenumber AS BIGINT) AS payment_sequential,
         l_returnflag AS payment_type,
         CAST(trunc(l_quantity) AS BIGINT) AS payment_installments,
         l_extendedprice AS payment_value
  FROM lineitem
), raw_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
         c_name AS customer_unique_id,
         CAST(c_nationkey AS VARCHAR) AS customer_zip_code_prefix,
         c_mktsegment AS customer_city,
         n_name AS customer_state
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
), stg_orders AS (
  SELECT order_id, customer_id, order_status,
         order_purchase_timestamp AS purchased_at,
         order_approved_at AS approved_at,
         order_delivered_carrier_date AS delivered_to_carrier_at,
         order_delivered_customer_date AS delivered_to_customer_at,
         order_estimated_delivery_date AS estimated_delivery_at
  FROM raw_orders WHERE order_id IS NOT NULL
), stg_order_reviews AS (
  SELECT review_id, order_id, review_score,
         review_comment_title AS comment_title,
         review_comment_message AS comment_message,
         review_creation_date AS created_at,
         review_answer_timestamp AS answered_at
  FROM raw_order_reviews WHERE review_id IS NOT NULL AND order_id IS NOT NULL
), stg_order_items AS (
  SELECT order_id, order_item_id, product_id, seller_id,
         shipping_limit_date AS shipping_limit_at, price AS item_price, freight_value
  FROM raw_order_items WHERE order_id IS NOT NULL
), stg_order_payments AS (
  SELECT * FROM raw_order_payments WHERE order_id IS NOT NULL
), stg_customers AS (
  SELECT customer_id, customer_unique_id, customer_zip_code_prefix AS zip_code_prefix,
         customer_city AS city, customer_state AS state
  FROM raw_customers WHERE customer_id IS NOT NULL
), raw_sellers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS seller_id,
         CAST(s_nationkey AS VARCHAR) AS seller_zip_code_prefix,
         s_name AS seller_city, n_name AS seller_state
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
), raw_products AS (
  SELECT * FROM part
), raw_geolocation AS (
  SELECT * FROM nation
), raw_category_translation AS (
  SELECT DISTINCT p_type FROM part
), stg_sellers AS (
  SELECT seller_id, seller_zip_code_prefix AS zip_code_prefix, seller_city AS city,
         seller_state AS state
  FROM raw_sellers WHERE seller_id IS NOT NULL
), stg_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         coalesce(p_type, 'unknown') AS category_name,
         CAST(length(p_name) AS BIGINT) AS product_name_length,
         CAST(NULL AS BIGINT) AS product_description_length,
         CAST(p_size AS BIGINT) AS photos_qty,
         p_retailprice AS weight_g,
         CAST(NULL AS DOUBLE) AS length_cm,
         CAST(NULL AS DOUBLE) AS height_cm,
         CAST(NULL AS DOUBLE) AS width_cm
  FROM part WHERE p_partkey IS NOT NULL
), stg_geolocation AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS zip_code_prefix,
         CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
         n_name AS city, r_name AS state
  FROM nation LEFT JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey IS NOT NULL
), stg_category_translation AS (
  SELECT DISTINCT p_type AS category_name, upper(p_type) AS category_name_english
  FROM part WHERE p_type IS NOT NULL
), delivered_orders AS (
  SELECT * FROM stg_orders WHERE order_status = '{DELIVERED_STANDIN}'
), int_orders_enriched AS (
  SELECT o.order_id, o.customer_id, c.state,
         CAST(date_diff('day', o.purchased_at, o.delivered_to_customer_at) AS BIGINT)
           AS days_to_delivery
  FROM delivered_orders o LEFT JOIN stg_customers c ON c.customer_id = o.customer_id
), fct_delivery_by_state AS (
  SELECT state, days_to_delivery FROM int_orders_enriched
), fct_seller_revenue AS (
  SELECT i.seller_id, i.item_price AS item_gross_revenue
  FROM stg_order_items i JOIN delivered_orders o ON o.order_id = i.order_id
), order_payments_sum AS (
  SELECT order_id,
         {_exact_sum("payment_value")} AS total_order_revenue
  FROM stg_order_payments GROUP BY order_id
), fct_orders AS (
  SELECT o.purchased_at, o.order_id, coalesce(p.total_order_revenue, 0) AS total_order_revenue
  FROM delivered_orders o LEFT JOIN order_payments_sum p ON p.order_id = o.order_id
), fct_orders_stored AS (
  SELECT *, strftime(purchased_at, '%Y-%m') AS purchase_month FROM fct_orders
), raw_orders_stored AS (
  SELECT *, strftime(order_purchase_timestamp, '%Y-%m') AS partition_month FROM raw_orders
), kpi_monthly AS (
  SELECT strftime(purchased_at, '%Y-%m') AS month,
         count(DISTINCT order_id) AS total_orders,
         round({_exact_sum("total_order_revenue")}, 2) AS total_revenue
  FROM fct_orders GROUP BY 1
), kpi_delivery_by_state AS (
  SELECT state, round(avg(days_to_delivery), 1) AS avg_days
  FROM fct_delivery_by_state
  WHERE days_to_delivery IS NOT NULL AND days_to_delivery >= 0 GROUP BY 1
), kpi_top_sellers AS (
  SELECT seller_id,
         round({_exact_sum("item_gross_revenue")}, 2) AS total_seller_revenue
  FROM fct_seller_revenue GROUP BY 1
  ORDER BY total_seller_revenue DESC NULLS LAST, seller_id NULLS FIRST LIMIT 10
)
"""


def _all_as_expected(*tables: str) -> str:
    """A comparison that finds every row of these tables and no difference."""
    return "\nUNION ALL ".join(
        f"SELECT '{table.removeprefix('raw_')}' AS table_name, count(*) AS n_rows,"
        f" CAST(0 AS BIGINT) AS n_different FROM {table}"
        for table in tables
    )


_SELECTS = {
    **{
        name: f"SELECT * FROM {name}"
        for name in (
            "stg_orders",
            "stg_order_items",
            "stg_order_payments",
            "stg_order_reviews",
            "stg_customers",
            "stg_sellers",
            "stg_products",
            "stg_geolocation",
            "stg_category_translation",
            "int_orders_enriched",
            "fct_delivery_by_state",
            "fct_seller_revenue",
            "order_payments_sum",
            "kpi_top_sellers",
        )
    },
    "fct_orders_full": "SELECT * FROM fct_orders_stored",
    "fct_orders_incremental": "SELECT * FROM fct_orders_stored",
    "fct_orders_high_water_mark": f"""
SELECT * FROM fct_orders_stored
WHERE purchase_month <> '{MID_MONTH[:7]}' OR purchased_at > (
  SELECT max(purchased_at) FROM fct_orders WHERE purchased_at < TIMESTAMP '{MID_MONTH}')""",
    "kpi_monthly": "SELECT * FROM kpi_monthly ORDER BY month NULLS FIRST",
    "kpi_delivery_by_state": """
SELECT * FROM kpi_delivery_by_state ORDER BY avg_days DESC NULLS LAST, state NULLS FIRST""",
    "kpi_top_sellers_ascending": """
SELECT * FROM kpi_top_sellers ORDER BY total_seller_revenue, seller_id DESC""",
    "kpi_summary": """
SELECT (SELECT CAST(sum(total_orders) AS BIGINT) FROM kpi_monthly) AS total_orders,
       (SELECT round(sum(total_revenue) / 1e6, 2) FROM kpi_monthly) AS total_revenue_millions,
       (SELECT round(avg(avg_days), 1) FROM kpi_delivery_by_state) AS avg_delivery_days""",
    "high_water_mark": """
SELECT coalesce(max(purchased_at), TIMESTAMP '1900-01-01') AS high_water_mark FROM fct_orders""",
    "high_water_mark_filter": f"""
SELECT * FROM fct_orders WHERE purchased_at > (
  SELECT coalesce(max(purchased_at), TIMESTAMP '1900-01-01') FROM fct_orders
  WHERE purchased_at < TIMESTAMP '{LATER_FROM}')""",
    "gated_build": "SELECT * FROM fct_seller_revenue",
    "cast_columns": _all_as_expected(*(f"raw_{t}" for t in RAW_COLUMNS)),
    "cast_order_items": "SELECT * FROM raw_order_items",
    "cast_missing_columns": """
SELECT order_id, order_item_id, product_id, seller_id, freight_value,
       CAST(order_item_id AS VARCHAR) AS note
FROM raw_order_items""",
    "month_prefix": f"SELECT * FROM raw_orders_stored WHERE partition_month = '{MONTH}'",
    "csv_roundtrip": """
SELECT * REPLACE (review_comment_message || ', "' || review_comment_title || '"' || chr(10) || ',end'
                  AS review_comment_message)
FROM raw_order_reviews""",
    "csv_roundtrip_items": "SELECT * FROM raw_order_items",
    "ingest": _all_as_expected(*(f"raw_{t}" for t in RAW_COLUMNS)),
    "ingest_reviews": """
SELECT *, strftime(review_creation_date, '%Y-%m') AS partition_month FROM raw_order_reviews""",
    "partition_by_month": "SELECT * FROM raw_orders_stored",
    "load_with_schema": "SELECT * FROM raw_order_payments",
    "load_month": f"SELECT * FROM raw_orders_stored WHERE partition_month = '{MONTH}'",
    "load_static": _all_as_expected(*(f"raw_{t}" for t in STATIC_TABLES)),
    "load_static_customers": "SELECT * FROM raw_customers",
    "append_load": "SELECT * FROM raw_orders_stored",
    "delete_month": f"""
SELECT * FROM raw_orders
WHERE date_trunc('month', CAST(order_purchase_timestamp AS DATE)) <> DATE '{MONTH}-01'
   OR order_purchase_timestamp IS NULL""",
    "delete_month_stored": f"""
SELECT * FROM raw_orders_stored
WHERE partition_month <> '{MONTH}' OR partition_month IS NULL""",
    "reload_month": "SELECT * FROM raw_orders_stored",
    "clustered_write": "SELECT * FROM fct_seller_revenue",
    "monthly_job": _all_as_expected(*MART_COLUMNS),
    "monthly_job_orders": "SELECT * FROM fct_orders_stored",
    "backfill": _all_as_expected(*MART_COLUMNS),
    "backfill_delivery": "SELECT * FROM fct_delivery_by_state",
}


def _check(check: Check) -> str:
    c = f'"{check.column}"'
    if check.kind == NOT_NULL:
        failing = f"(SELECT count(*) FROM {check.model} WHERE {c} IS NULL)"
    elif check.kind == UNIQUE:
        repeated = f"SELECT {c} FROM {check.model} WHERE {c} IS NOT NULL"
        failing = f"(SELECT count(*) FROM ({repeated} GROUP BY {c} HAVING count(*) > 1) r)"
    else:
        values = ", ".join(f"'{v}'" for v in check.values)
        failing = f"(SELECT count(DISTINCT {c}) FROM {check.model} WHERE {c} NOT IN ({values}))"
    return (
        f"SELECT '{check.model}' AS model, '{check.column}' AS \"column\","
        f" '{check.kind}' AS \"check\", {failing} AS failing"
    )


def _check_of_a_month(check: Check) -> str:
    """As above for one month; of a unique check, its values that any order has again."""
    own = f"(SELECT * FROM stg_orders WHERE strftime(purchased_at, '%Y-%m') = '{MONTH}')"
    if check.kind != UNIQUE:
        return _check(check).replace("FROM stg_orders", f"FROM {own} m")
    c = f'"{check.column}"'
    repeated = f"SELECT {c} FROM stg_orders GROUP BY {c} HAVING count(*) > 1"
    failing = f"(SELECT count(DISTINCT {c}) FROM {own} m WHERE {c} IN ({repeated}))"
    return (
        f"SELECT 'stg_orders' AS model, '{check.column}' AS \"column\","
        f" '{check.kind}' AS \"check\", {failing} AS failing"
    )


def _report(*kinds: str) -> str:
    return "\nUNION ALL ".join(_check(c) for c in CHECKS if c.kind in kinds)


ORACLES: dict[str, str] = {
    name: _MODELS + select
    for name, select in {
        **_SELECTS,
        "dq_not_null": _report(NOT_NULL),
        "dq_unique": _report(UNIQUE),
        "dq_accepted_values": _report(ACCEPTED),
        "dq_report": _report(NOT_NULL, UNIQUE, ACCEPTED),
        "dq_month": "\nUNION ALL ".join(
            _check_of_a_month(c) for c in MONTH_CHECKS if c.model == "stg_orders"
        ),
    }.items()
}
