"""KPI queries over the marts. Every result is small: months, states, ten rows or one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.dates import month_label, month_start
from tradewind.functions.money import money_sum

TOP_SELLERS = 10


def kpi_monthly(fct_orders: DataFrame) -> DataFrame:
    """Distinct orders and revenue by purchase month, oldest first."""
    by_month = _by_month(fct_orders).orderBy("month")
    return by_month.withColumn("month", month_label(F.col("month")))


def kpi_delivery_by_state(fct_delivery: DataFrame) -> DataFrame:
    """Average delivery days by state, slowest first."""
    return _by_state(fct_delivery).orderBy(F.desc("avg_days"), "state")


def kpi_top_sellers(fct_sellers: DataFrame) -> DataFrame:
    """The ten sellers of most revenue; equal revenue goes by seller id."""
    revenue = F.round(money_sum("item_gross_revenue"), 2)
    return (
        fct_sellers.groupBy("seller_id")
        .agg(revenue.alias("total_seller_revenue"))
        .orderBy(F.desc("total_seller_revenue"), "seller_id")
        .limit(TOP_SELLERS)
    )


def kpi_top_sellers_ascending(fct_sellers: DataFrame) -> DataFrame:
    """The same ten sellers, smallest first, as a bar chart shows them."""
    return kpi_top_sellers(fct_sellers).orderBy("total_seller_revenue", F.desc("seller_id"))


def kpi_summary(fct_orders: DataFrame, fct_delivery: DataFrame) -> DataFrame:
    """One row of headline totals over the monthly and the state figures.

    Orders add up the monthly counts, and the delivery time is the plain mean of the rounded
    state averages: each state weighs the same.
    """
    none = F.lit(None)
    sales = _by_month(fct_orders).select(
        "total_orders", "total_revenue", none.cast("double").alias("avg_days")
    )
    delivery = _by_state(fct_delivery).select(
        none.cast("bigint").alias("total_orders"),
        none.cast("double").alias("total_revenue"),
        "avg_days",
    )
    return sales.unionAll(delivery).agg(
        F.sum("total_orders").alias("total_orders"),
        F.round(money_sum("total_revenue") / 1e6, 2).alias("total_revenue_millions"),
        F.round(F.avg("avg_days"), 1).alias("avg_delivery_days"),
    )


def _by_month(fct_orders: DataFrame) -> DataFrame:
    return fct_orders.groupBy(month_start(F.col("purchased_at")).alias("month")).agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.round(money_sum("total_order_revenue"), 2).alias("total_revenue"),
    )


def _by_state(fct_delivery: DataFrame) -> DataFrame:
    """Unknown and negative spans are left out, orders of an unknown state are not."""
    days = F.col("days_to_delivery")
    return (
        fct_delivery.where(days.isNotNull() & (days >= 0))
        .groupBy("state")
        .agg(F.round(F.avg(days), 1).alias("avg_days"))
    )
