"""Tables replaced as a whole: a job that fails or is killed leaves the old rows."""

import pytest
from marketplace import customers, items, orders, payments
from pyspark.sql import functions as F

from tradewind.operators import writes
from tradewind.operators.months import with_month
from tradewind.plans import jobs
from tradewind.schemas import PARTITION_MONTH, mart_schema, raw_schema
from tradewind.sources import warehouse as stored
from tradewind.sources.warehouse import Warehouse, read_declared, read_mart, read_raw


@pytest.fixture
def warehouse(tmp_path):
    return Warehouse(str(tmp_path))


def failing(df, column):
    """The same rows, of which the last read fails the job, when others have been written."""
    bad = F.when(F.col(column).isNotNull(), F.raise_error(F.lit("broken row")).cast(df.schema[column].dataType))
    return df.unionAll(df.limit(1).withColumn(column, bad).select(df.columns))


def rows(df):
    return sorted(map(str, df.collect()))


def left_beside(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("_"))


WRITES = {
    "write_table": writes.write_table,
    "write_clustered": lambda df, path: writes.write_clustered(df, path, "customer_id"),
    "write_months": lambda df, path: writes.write_months(df, path, "customer_state"),
}


@pytest.mark.parametrize("write", WRITES.values(), ids=WRITES)
def test_failed_write_leaves_the_old_rows(spark, tmp_path, write):
    path, df = str(tmp_path / "table"), customers(spark)
    write(df, path)
    before = rows(spark.read.parquet(path))
    with pytest.raises(Exception, match="broken row"):
        write(failing(df, "customer_city"), path)
    assert rows(spark.read.parquet(path)) == before
    assert left_beside(tmp_path) == []
    write(df.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    assert left_beside(tmp_path) == []


@pytest.mark.parametrize("write", WRITES.values(), ids=WRITES)
def test_first_write_that_fails_leaves_nothing(spark, tmp_path, write):
    with pytest.raises(Exception, match="broken row"):
        write(failing(customers(spark), "customer_city"), str(tmp_path / "table"))
    assert list(tmp_path.iterdir()) == []


def test_a_table_can_be_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    writes.write_table(customers(spark), path)
    writes.write_table(spark.read.parquet(path).where("customer_id = 'c1'"), path)
    assert spark.read.parquet(path).count() == 1


def test_failed_rename_puts_the_old_rows_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    writes.write_table(customers(spark), path)
    rename = stored._rename

    def refuse(system, source, target):
        if "_next-" in source.toString():
            raise OSError("storage is away")
        rename(system, source, target)

    monkeypatch.setattr(stored, "_rename", refuse)
    with pytest.raises(OSError, match="away"):
        writes.write_table(customers(spark).limit(1), path)
    assert spark.read.parquet(path).count() == 2
    assert left_beside(tmp_path) == []


def test_killed_between_the_renames(spark, warehouse, tmp_path):
    """As the folders lie then: the old table is moved aside, the new one not yet in its place."""
    table = tmp_path / "raw" / "customers"
    writes.write_table(customers(spark), str(table))
    writes.write_table(customers(spark).limit(1), str(table.parent / "_next-customers"))
    table.rename(table.parent / "_last-customers")
    assert read_raw(spark, warehouse, "customers").count() == 2
    table.rename(table.parent / "_last-customers")
    writes.write_table(customers(spark).limit(1), str(table))
    assert read_raw(spark, warehouse, "customers").count() == 1
    assert left_beside(table.parent) == []


def test_killed_before_and_after_the_renames(spark, tmp_path):
    path = tmp_path / "table"
    for left in ("_next-table", "_last-table"):
        writes.write_table(customers(spark).limit(1), str(path))
        writes.write_table(customers(spark), str(tmp_path / left))
        assert spark.read.parquet(str(path)).count() == 1
        writes.write_table(customers(spark), str(path))
        assert spark.read.parquet(str(path)).count() == 2
        assert left_beside(tmp_path) == []


def test_nothing_there_is_no_table(spark, warehouse):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_declared(spark, warehouse.raw("customers"), raw_schema("customers"))


def loaded(spark, warehouse):
    for table, df in (("order_items", items), ("order_payments", payments), ("customers", customers)):
        writes.write_table(df(spark), warehouse.landing(table))
    jobs.load_static(spark, warehouse, ("order_items", "order_payments", "customers"))
    writes.write_months(with_month(orders(spark), "orders"), warehouse.raw("orders"), PARTITION_MONTH)
    jobs.build_marts(spark, warehouse, [])


def test_static_load_that_fails_midway(spark, warehouse, monkeypatch):
    """The table at which the load fails keeps its rows, and so do those after it."""
    loaded(spark, warehouse)
    for table, df in (("order_items", items), ("order_payments", payments), ("customers", customers)):
        writes.write_table(df(spark).limit(1), warehouse.landing(table))
    read = jobs.read_declared

    def broken(spark, path, schema):
        df = read(spark, path, schema)
        return failing(df, "payment_type") if path.endswith("landing/order_payments") else df

    monkeypatch.setattr(jobs, "read_declared", broken)
    with pytest.raises(Exception, match="broken row"):
        jobs.load_static(spark, warehouse, ("order_items", "order_payments", "customers"))
    counts = [read_raw(spark, warehouse, t).count() for t in ("order_items", "order_payments", "customers")]
    assert counts == [1, 7, 2]


@pytest.mark.parametrize("mart, model, column", [
    ("fct_delivery_by_state", "int_orders_enriched", "state"),
    ("fct_seller_revenue", "fct_seller_revenue", "seller_id"),
])
def test_mart_build_that_fails_midway(spark, warehouse, monkeypatch, mart, model, column):
    loaded(spark, warehouse)
    before = {m: rows(read_mart(spark, warehouse, m)) for m in ("fct_delivery_by_state", "fct_seller_revenue")}
    good = getattr(jobs, model)
    monkeypatch.setattr(jobs, model, lambda *args, **kwargs: failing(good(*args, **kwargs), column))
    with pytest.raises(Exception, match="broken row"):
        jobs.build_marts(spark, warehouse, [])
    assert {m: rows(read_mart(spark, warehouse, m)) for m in before} == before
    assert read_mart(spark, warehouse, mart).schema == mart_schema(mart)


def test_full_refresh_of_the_order_mart_that_fails(spark, warehouse):
    loaded(spark, warehouse)
    before = rows(read_mart(spark, warehouse, "fct_orders"))
    raw = read_raw(spark, warehouse, "orders")
    bad = failing(read_raw(spark, warehouse, "order_payments"), "order_id")
    with pytest.raises(Exception, match="broken row"):
        jobs.update_fct_orders(spark, warehouse, raw, bad, [], full_refresh=True)
    assert rows(read_mart(spark, warehouse, "fct_orders")) == before
