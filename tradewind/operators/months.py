"""Month-wise reload of the raw tables, incremental selection by a stored maximum."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.dates import month_label, month_start, not_in_month
from tradewind.operators.writes import overwrite_months
from tradewind.schemas import MONTH_KEY, PARTITION_MONTH
from tradewind.sources.warehouse import Warehouse, drop_months, landed_months, read_months

# Fixed value: what an empty mart counts as its latest purchase.
NOTHING_STORED = "1900-01-01"


def with_month(df: DataFrame, table: str) -> DataFrame:
    """Add the partition month of a raw table; rows without a time get a null month."""
    return df.withColumn(PARTITION_MONTH, month_label(month_start(F.col(MONTH_KEY[table]))))


def without_month(df: DataFrame, time_column: str, month: str) -> DataFrame:
    """Every row outside ``month``, rows without a time included."""
    return df.where(not_in_month(F.col(time_column), month))


def reload_months(
    spark: SparkSession, warehouse: Warehouse, table: str, months: list[str]
) -> None:
    """Replace months of a raw table by what has landed; repeating it changes nothing.

    A month that has not landed ends up empty. All months that have landed go through one job.
    """
    arrived = landed_months(spark, warehouse, table, among=months)
    if arrived:
        landed = read_months(spark, warehouse.landing(table), table, arrived)
        overwrite_months(landed, warehouse.raw(table), PARTITION_MONTH, spread=False)
    gone = set(months) - set(arrived)
    drop_months(spark, warehouse.raw(table), PARTITION_MONTH, gone)


def delete_month(spark: SparkSession, warehouse: Warehouse, table: str, month: str) -> None:
    """Empty a month of a stored raw table; a table not stored yet stays so."""
    drop_months(spark, warehouse.raw(table), PARTITION_MONTH, {month})


def high_water_mark(stored: DataFrame, time_column: str) -> DataFrame:
    """One row: the latest stored time, or a date before all data."""
    latest = F.coalesce(F.max(time_column), F.lit(NOTHING_STORED).cast("timestamp_ntz"))
    return stored.agg(latest.alias("high_water_mark"))


def later_than_stored(df: DataFrame, stored: DataFrame, time_column: str) -> DataFrame:
    """Rows past the stored maximum, as one scalar subquery; rows without a time drop out."""
    return df.where(F.col(time_column) > high_water_mark(stored, time_column).scalar())


def stored_high_water_mark(stored: DataFrame, time_column: str, month_column: str) -> datetime:
    """The stored maximum as a value, read from the last month directory only."""
    # The latest time lies in the latest month, so two small queries replace a full scan.
    last_month = stored.agg(F.max(month_column)).first()[0]
    in_last: Column = F.col(month_column) == last_month if last_month else F.lit(False)
    return high_water_mark(stored.where(in_last), time_column).first()[0]
