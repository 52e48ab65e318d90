"""What Spark makes of the queries: pruning, pushdown, skew handling, no Python in the plan."""

import glob
from contextlib import contextmanager

import pyarrow.parquet as pq
import pytest
from marketplace import orders
from pyspark.sql import functions as F

from tradewind.operators.months import with_month
from tradewind.operators.writes import overwrite_months, write_clustered, write_months
from tradewind.operators.quality import CHECKS, UNIQUE
from tradewind.plans import jobs, kpi, marts
from tradewind.queries import QUERIES
from tradewind.schemas import PARTITION_MONTH, raw_schema
from tradewind.sources.warehouse import Warehouse, read_declared, read_months, stored_months

# Queries that only compute, so that their whole plan is at hand.
PURE = sorted(
    set(QUERIES)
    - {
        "append_load", "backfill", "backfill_delivery", "clustered_write", "csv_roundtrip",
        "csv_roundtrip_items", "delete_month_stored", "fct_orders_full",
        "fct_orders_high_water_mark", "fct_orders_incremental", "gated_build", "ingest",
        "ingest_reviews", "load_month", "load_static", "load_static_customers",
        "load_with_schema", "monthly_job", "monthly_job_orders", "partition_by_month",
        "reload_month",
    }
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df._jdf.queryExecution().toRdd().count()
    return plan(df).split("== Initial Plan ==")[0]


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for key, value in names.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_partitions(spark):
    """Thresholds that make test data count as big."""
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100k",
    )


@pytest.mark.parametrize("name", PURE)
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_status_filter_reaches_the_scan(spark, sf_dir):
    text = QUERIES["kpi_top_sellers"](spark, sf_dir)
    assert "EqualTo(o_orderstatus,F)" in plan(text)
    assert "TakeOrderedAndProject" in plan(text)


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(QUERIES["kpi_top_sellers"](spark, sf_dir))
    assert "struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double>" in text
    assert "struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_one_month_opens_one_directory(spark, tmp_path):
    warehouse = Warehouse(str(tmp_path))
    path = warehouse.landing("orders")
    write_months(with_month(orders(spark), "orders"), path, PARTITION_MONTH)
    month = read_months(spark, path, "orders", ["2017-01"])
    assert "PartitionFilters: []" not in plan(month)
    files = [row[0] for row in month.select(F.input_file_name()).distinct().collect()]
    assert len(files) == 1 and "partition_month=2017-01" in files[0]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Orders, items and payments where one key holds a third of all rows."""
    path = tmp_path_factory.mktemp("hot")
    n = 300_000
    third = F.col("id") % 3 == 0
    key = F.when(third, "hot").otherwise(F.concat(F.lit("o"), F.col("id")))
    rows = spark.range(0, n, 1, 8).select(
        key.alias("order_id"),
        F.when(F.col("id") % 3 == 1, "c0").otherwise(F.concat(F.lit("c"), F.col("id")))
        .alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        F.expr("TIMESTAMP_NTZ'2017-01-01 00:00:00' + make_dt_interval(id % 90, 0, 0, id % 997)")
        .alias("purchased_at"),
        F.md5(F.col("id").cast("string")).alias("seller_id"),
        (F.col("id") % 1000 / 100).alias("amount"),
    )
    rows.write.parquet(str(path / "rows"))
    return spark.read.parquet(str(path / "rows")).withColumn(
        "delivered_to_customer_at", F.col("purchased_at")
    )


def test_hot_order_is_split_in_the_order_mart(spark, hot):
    payments = hot.select("order_id", F.col("amount").alias("payment_value"))
    with small_partitions(spark):
        mart = marts.fct_orders(hot, payments)
        assert "SortMergeJoin(skew=true)" in final_plan(mart)
        assert "SortMergeJoin(skew=true)" in final_plan(kpi.kpi_monthly(mart))
        assert mart.count() == hot.count()


def test_hot_customer_is_split_in_the_enriched_orders(spark, hot):
    customers = hot.select("customer_id").distinct().withColumn("state", F.lit("SP"))
    with small_partitions(spark):
        # Written out so that the grouping above is not part of the join's input.
        assert "SortMergeJoin(skew=true)" in final_plan(
            marts.int_orders_enriched(hot, spark.createDataFrame(customers.toPandas()))
        )


def test_hot_order_is_split_in_the_seller_mart(spark, hot):
    items = hot.select("order_id", "seller_id", F.col("amount").alias("item_price"))
    once = hot.where("order_id <> 'hot'").select("order_id", "order_status")
    once = once.unionAll(spark.sql("SELECT 'hot', 'delivered'"))
    with small_partitions(spark):
        mart = marts.fct_seller_revenue(items, once)
        assert "SortMergeJoin(skew=true)" in final_plan(mart)
        assert "SortMergeJoin(skew=true)" in final_plan(kpi.kpi_top_sellers(mart))


def test_hot_month_and_hot_state_are_written_by_several_tasks(spark, hot, tmp_path):
    state = F.when(F.col("order_id") == "hot", "SP").otherwise(F.col("amount").cast("int").cast("string"))
    df = hot.select(state.alias("state"), "seller_id")
    with small_partitions(spark):
        spread = df.withColumn("n", F.xxhash64("seller_id"))
        write_clustered(spread, str(tmp_path / "clustered"), "state", spread="n")
        write_months(df.withColumnRenamed("state", "m"), str(tmp_path / "months"), "m")
    holding = spark.read.parquet(str(tmp_path / "clustered")).where("state = 'SP'")
    assert holding.select(F.input_file_name()).distinct().count() > 1
    assert len(glob.glob(str(tmp_path / "months" / "m=SP" / "*.parquet"))) > 1
    assert holding.count() == 100_000


def test_clustered_reads_skip_row_groups_and_a_hot_state_is_spread(spark, hot, tmp_path):
    state = F.when(F.col("order_id") == "hot", "SP").otherwise(F.substring("seller_id", 1, 2))
    path = tmp_path / "sellers"
    rows = hot.select("seller_id", state.alias("state"), F.xxhash64("order_id", "seller_id").alias("n"))
    with settings(
        spark,
        spark__sql__shuffle__partitions="32",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    ):
        write_clustered(rows.drop("state"), str(path), "seller_id", spread="n")
        write_clustered(rows.drop("seller_id"), str(tmp_path / "states"), "state", spread="n")
    assert spark.read.parquet(str(path)).columns == ["seller_id"]
    wanted = spark.read.parquet(str(path)).first()[0]
    groups = _ranges(path, "seller_id")
    assert len(groups) >= 20 and sum(low <= wanted <= high for low, high in groups) <= 2
    holding = sum(low <= "SP" <= high for low, high in _ranges(tmp_path / "states", "state"))
    assert 8 <= holding <= 14


def _ranges(path, column):
    """The least and greatest value of a column in every row group, from the footers."""
    found = []
    for file in path.glob("*.parquet"):
        footer = pq.ParquetFile(file)
        place = footer.schema_arrow.get_field_index(column)
        for k in range(footer.metadata.num_row_groups):
            statistics = footer.metadata.row_group(k).column(place).statistics
            found.append((statistics.min, statistics.max))
    return found


def test_payments_of_other_orders_are_left_out_before_grouping(spark, tmp_path):
    from marketplace import payments

    warehouse, seen = Warehouse(str(tmp_path)), []
    write_months(with_month(orders(spark), "orders"), warehouse.raw("orders"), PARTITION_MONTH)
    raw = read_declared(spark, warehouse.raw("orders"), raw_schema("orders"))

    def watched(df, *args, **kwargs):
        seen.append(plan(df))
        overwrite_months(df, *args, **kwargs)

    jobs.update_fct_orders(spark, warehouse, raw, payments(spark), [])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jobs, "overwrite_months", watched)
        jobs.update_fct_orders(spark, warehouse, raw, payments(spark), ["2017-01"])
    lines = seen[0].splitlines()
    grouping = max(i for i, x in enumerate(lines) if "Aggregate" in x and "partial" in x)
    assert any("LeftSemi" in x for x in lines[grouping:])


def test_months_come_from_the_listing_without_a_job(spark, tmp_path):
    path = str(tmp_path / "orders")
    write_months(with_month(orders(spark), "orders"), path, PARTITION_MONTH)
    (tmp_path / "orders" / f"{PARTITION_MONTH}=2016-01").mkdir()
    spark.sparkContext.setJobGroup("listing", "")
    try:
        assert stored_months(spark, path, PARTITION_MONTH) == ["2017-01", "2017-02"]
        assert stored_months(spark, path, PARTITION_MONTH, ["2017-02"]) == ["2017-02"]
        assert stored_months(spark, str(tmp_path / "none"), PARTITION_MONTH) == []
        assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("listing"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_unique_check_of_a_month_groups_its_ids_alone(spark, tmp_path):
    """Ids of other months pass a semi-join before anything is grouped or shuffled."""
    warehouse = Warehouse(str(tmp_path))
    write_months(with_month(orders(spark), "orders"), warehouse.raw("orders"), PARTITION_MONTH)
    unique = tuple(c for c in CHECKS if c.kind == UNIQUE)
    lines = plan(jobs.check_months(spark, warehouse, ["2017-01"], unique)).splitlines()
    others = next(i for i, x in enumerate(lines) if "FileScan" in x and "NOT coalesce" in x)
    assert "ReadSchema: struct<order_id:string>" in lines[others]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, at = [], depth(lines[others])
    for line in reversed(lines[:others]):
        if depth(line) < at:
            at = depth(line)
            above.append(line)
    first = next(i for i, x in enumerate(above) if "LeftSemi" in x)
    assert not any("Aggregate" in x or "Exchange" in x for x in above[:first])


@pytest.mark.parametrize("mart", ["fct_delivery_by_state", "fct_seller_revenue"])
def test_a_clustered_mart_reads_its_inputs_once(spark, hot, tmp_path, mart):
    """Sampling the bounds of the ranges does not join again, and leaves nothing behind."""
    read = spark.sparkContext.accumulator(0)

    def count(value):
        read.add(1)
        return value

    # Else it would be run again for the filter that Spark derives from the join.
    watched = F.udf(count, "string").asNondeterministic()
    rows = hot.select(watched("order_id").alias("order_id"), *[c for c in hot.columns if c != "order_id"])
    with small_partitions(spark), settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        if mart == "fct_delivery_by_state":
            customers = hot.select("customer_id").distinct().withColumn("state", F.lit("SP"))
            df = marts.fct_delivery_by_state(marts.int_orders_enriched(rows, customers), spread=True)
        else:
            items = rows.withColumns({"item_price": F.col("amount"), "order_item_id": F.lit(1)})
            df = marts.fct_seller_revenue(items, hot.dropDuplicates(["order_id"]), spread=True)
        write_clustered(df, str(tmp_path / mart), df.columns[0], spread=marts.SPREAD)
    assert read.value == hot.count()
    assert [p.name for p in tmp_path.iterdir()] == [mart]
    stored = spark.read.parquet(str(tmp_path / mart))
    assert stored.count() == hot.count() and marts.SPREAD not in stored.columns
    if mart == "fct_delivery_by_state":
        assert stored.select(F.input_file_name()).distinct().count() > 1
