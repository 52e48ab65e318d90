"""The enriched order view and the three fact tables, as functions of staging models."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.dates import days_between
from tradewind.functions.money import money_sum
from tradewind.operators.joins import left_join_totals
from tradewind.schemas import DELIVERED
from tradewind.session import use_filters

# A column that only spreads rows over tasks in a clustered write.
SPREAD = "_spread"


def _spread(*columns: str) -> Column:
    """16 bits of a hash: enough to cut a value into tasks, and two bytes a row instead of eight."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 48).cast("int").alias(SPREAD)


def int_orders_enriched(
    orders: DataFrame, customers: DataFrame, delivered: str = DELIVERED, whole_days: bool = False
) -> DataFrame:
    """Delivered orders with the customer's state and the days from purchase to delivery."""
    states = customers.select("customer_id", "state")
    days = days_between(F.col("purchased_at"), F.col("delivered_to_customer_at"), whole_days)
    return (
        orders.where(F.col("order_status") == delivered)
        .join(states, "customer_id", "left")
        .select("order_id", "customer_id", "state", days.alias("days_to_delivery"))
    )


def fct_delivery_by_state(enriched: DataFrame, spread: bool = False) -> DataFrame:
    """``spread`` adds a hash of the order, which keeps a hot state apart when it is written."""
    mart = ["state", "days_to_delivery"]
    return enriched.select(*mart, *[_spread("order_id")] * spread)


def fct_seller_revenue(
    items: DataFrame, orders: DataFrame, delivered: str = DELIVERED, spread: bool = False
) -> DataFrame:
    """Price of every item of a delivered order; an order stored twice counts twice.

    ``spread`` adds a hash of order and item, which keeps a hot seller apart when it is written.
    """
    use_filters(items.sparkSession, True)  # the operators on texts turn them off
    wanted = orders.where(F.col("order_status") == delivered).select("order_id")
    return items.join(wanted, "order_id").select(
        "seller_id",
        F.col("item_price").alias("item_gross_revenue"),
        *[_spread("order_id", "order_item_id")] * spread,
    )


def order_payments_sum(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        money_sum("payment_value").alias("total_order_revenue")
    )


def fct_orders(
    orders: DataFrame,
    payments: DataFrame,
    delivered: str = DELIVERED,
    orders_unique: bool = False,
) -> DataFrame:
    """Delivered orders with the sum of their payments, 0 where there is none.

    ``orders_unique`` says a check has shown order ids to be unique, so that none can be hot
    on the order side and the join may reuse the partitioning of the grouped payments.
    """
    wanted = orders.where(F.col("order_status") == delivered).select("order_id", "purchased_at")
    totals = order_payments_sum(payments)
    joined = (
        wanted.join(totals, "order_id", "left")
        if orders_unique
        else left_join_totals(wanted, totals, "order_id")
    )
    return joined.select(
        "purchased_at",
        "order_id",
        F.coalesce("total_order_revenue", F.lit(0.0)).alias("total_order_revenue"),
    )
