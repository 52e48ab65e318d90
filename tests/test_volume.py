"""What the stored jobs shuffle and write: rows sent once, dropped early, packed and compressed."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from marketplace import orders, ts
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_plans import plan, settings

from tradewind import queries
from tradewind.operators.months import with_month
from tradewind.operators.quality import CHECKS, UNIQUE
from tradewind.operators.writes import write_months, write_table
from tradewind.plans import jobs, marts
from tradewind.schemas import PARTITION_MONTH
from tradewind.sources.warehouse import Warehouse
from tradewind.standins import raw_table

NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}

ROWS = [
    (None, None, None, None), ("", 0, 0.0, None), ("N", 0, 0.0, None), ("T", 0, 0.0, None),
    ("12", 0, 0.0, None), ("12\n", 0, 0.0, None), ("1|2", 0, 0.0, None), ("012", 0, 0.0, None),
    ("0:12", 0, 0.0, None), ("1,2", 0, 0.0, None), ("1E5", 0, 0.0, None), ("1e5", 0, 0.0, None),
    ("1", 2, 0.0, None), ("1", -2, 0.0, None), ("12", None, 0.0, None), ("A", 0, 0.0, None),
    ("x", 0, 1e300, None), ("x", 0, float("nan"), None), ("x", 0, float("inf"), None),
    ("x", 0, float("-inf"), None), ("x", 0, 0.1, None), ("x", 0, 0.1 + 2**-56, None),
    ("x", 9, None, ts("1970-01-10")), ("x", 9, None, ts("1970-01-10 00:00:01")),
    ("x", 9, None, ts("1970-01-10 01:00:00")), ("x", 9, None, ts("1969-12-23")),
]
SCHEMA = T.StructType([
    T.StructField("s", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("x", T.DoubleType()), T.StructField("t", T.TimestampNTZType()),
])


@pytest.mark.parametrize("columns", [["s", "n", "x", "t"], ["t", "x", "n", "s"], ["s"], ["x"], ["t"]])
def test_packed_rows_are_equal_just_where_the_rows_are(spark, columns):
    df = spark.createDataFrame(ROWS, SCHEMA)
    packed = df.select(*columns, *queries._packed(df, columns))
    both = packed.groupBy(columns).agg(F.count_distinct("_plain", "_texts").alias("forms"))
    assert {row["forms"] for row in both.collect()} == {1}
    assert packed.select("_plain", "_texts").distinct().count() == df.select(columns).distinct().count()


def test_zeros_of_both_signs_are_equal_and_digits_take_half_a_byte(spark):
    df = spark.createDataFrame([("123456", 7, -0.0, None), ("123456", 7, 0.0, None)], SCHEMA)
    packed = df.select(*queries._packed(df, df.columns)).distinct().collect()
    # 123456|7|0.0|N
    assert [len(row["_plain"]) for row in packed] == [7] and packed[0]["_texts"] == ""


def test_comparison_finds_every_changed_row(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    day, next_day = (F.lit(f"1970-01-{k}").cast("timestamp_ntz") for k in (10, 11))
    other = df.withColumn("t", F.when(F.col("t") == day, next_day).otherwise(F.col("t")))
    report = queries._compared({"a": df, "b": df, "c": df}, {"a": df, "b": other, "c": df.unionAll(df.limit(1))})
    assert {r["table_name"]: (r["n_rows"], r["n_different"]) for r in report.collect()} == {
        "a": (len(ROWS), 0), "b": (len(ROWS), 2), "c": (len(ROWS) + 1, 1),
    }


def test_orders_and_their_last_dates_are_shuffled_once_each(spark, sf_dir):
    with settings(spark, **NO_BROADCAST):
        assert plan(raw_table(spark, sf_dir, "orders")).count("Exchange hashpartitioning") == 2


def test_items_of_other_orders_are_dropped_before_the_shuffle(spark, tmp_path):
    """Also where neither side is small enough to be broadcast."""
    n = F.col("id")
    items = spark.range(0, 600_000, 1, 4).select(
        n.cast("string").alias("order_id"), n.alias("order_item_id"),
        F.md5(n.cast("string")).alias("seller_id"), n.cast("double").alias("item_price"),
    )
    status = F.when(n % 3 == 0, "delivered").otherwise("shipped").alias("order_status")
    write_table(items, str(tmp_path / "items"))
    write_table(spark.range(600_000).select(n.cast("string").alias("order_id"), status), str(tmp_path / "orders"))
    with settings(spark, **NO_BROADCAST):
        sold, bought = (spark.read.parquet(str(tmp_path / t)) for t in ("items", "orders"))
        mart = marts.fct_seller_revenue(sold, bought)
        assert "might_contain" in plan(mart)
        assert mart.count() == 200_000


def test_a_spread_is_two_bytes(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("order_id"), F.lit("SP").alias("state"), F.lit(1).alias("days_to_delivery")
    )
    spread = marts.fct_delivery_by_state(df, spread=True)
    assert spread.schema[marts.SPREAD].dataType == T.IntegerType()
    low, high, n = spread.agg(F.min(marts.SPREAD), F.max(marts.SPREAD), F.count_distinct(marts.SPREAD)).first()
    assert 0 <= low < 2**10 and 2**16 - 2**10 < high < 2**16 and n > 950


def test_ids_are_shuffled_once_where_no_other_months_are_stored(spark, tmp_path):
    warehouse = Warehouse(str(tmp_path))
    dated = with_month(orders(spark), "orders").where(F.col(PARTITION_MONTH).isNotNull())
    write_months(dated, warehouse.raw("orders"), PARTITION_MONTH)
    months = ["2017-01", "2017-02"]
    unique = tuple(c for c in CHECKS if c.kind == UNIQUE)
    report = jobs.check_months(spark, warehouse, months, unique)
    assert "Join" not in plan(report) and plan(report).count("Exchange hashpartitioning") == 1
    part = jobs.check_months(spark, warehouse, months[:1], unique)
    assert "LeftSemi" in plan(part)
    assert [r["failing"] for r in report.collect()] == [r["failing"] for r in part.collect()] == [0]


def test_stored_tables_are_compressed(spark, tmp_path):
    write_table(spark.range(10), str(tmp_path / "t"))
    file = next((tmp_path / "t").glob("*.parquet"))
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"


def test_csv_files_are_compressed_but_for_those_read_in_ranges(spark, sf_dir):
    root = Path(queries._ingested(spark, sf_dir).root.removeprefix("file:"))
    for table, end in (("order_items", ".csv.gz"), ("order_reviews", ".csv")):
        names = [f.name for f in (root / "csv" / table).glob("part-*")]
        assert names and all(name.endswith(end) for name in names)
