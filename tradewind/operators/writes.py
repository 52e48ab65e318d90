"""Ways of storing a table. None of them gathers a month, key or file into one task."""

from pyspark.sql import DataFrame

from tradewind.sources.warehouse import replace_table, stored_once


def write_table(df: DataFrame, path: str) -> None:
    """Replace the whole table; safe to repeat, and a write that fails leaves the old rows."""
    replace_table(df.sparkSession, path, df.write.parquet)


def append_table(df: DataFrame, path: str, month_column: str | None = None) -> None:
    writer = df.write.mode("append")
    if month_column:
        writer = writer.partitionBy(month_column)
    writer.parquet(path)


def write_clustered(df: DataFrame, path: str, *columns: str, spread: str | None = None) -> None:
    """Replace the table, rows of equal ``columns`` side by side, so reads skip row groups.

    Files hold ranges of ``columns``, so the least and greatest value of most row groups leave
    a wanted value out. ``spread`` names a column of evenly spread numbers that is not stored:
    ranges go by it as well, so a value with a third of all rows is cut into several tasks.

    Spark samples the rows for the bounds of the ranges and then reads them again, so they are
    stored first, and what they are computed from is read once. Each task stores its rows in order:
    equal values side by side take less space there and in the shuffle by ranges. A write that
    fails leaves the old rows.
    """
    keys = [*columns, spread] if spread else list(columns)
    with stored_once(df.sortWithinPartitions(*keys), path) as rows:
        ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*columns)
        stored = ranges.drop(spread) if spread else ranges
        replace_table(df.sparkSession, path, stored.write.parquet)


def write_months(df: DataFrame, path: str, month_column: str) -> None:
    """Replace the whole table, one directory per month, in one pass over ``df``."""
    writer = _by_month(df, month_column).partitionBy(month_column)
    replace_table(df.sparkSession, path, writer.parquet)


def overwrite_months(df: DataFrame, path: str, month_column: str, spread: bool = True) -> None:
    """Replace exactly the months present in ``df``; all others stay as they are.

    ``spread=False`` saves the shuffle where the input is split by month already or has one.
    """
    writer = _by_month(df, month_column) if spread else df.write
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        month_column
    ).parquet(path)


def _by_month(df: DataFrame, month_column: str):
    return df.hint("rebalance", month_column).write
