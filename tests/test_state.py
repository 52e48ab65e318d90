"""Stored tables over several runs: repeated, out of order, emptied, split deliveries."""

import pytest
from marketplace import customers, items, orders, payments, reviews

from tradewind.operators.months import (
    delete_month,
    high_water_mark,
    reload_months,
    stored_high_water_mark,
    with_month,
    without_month,
)
from tradewind.operators.quality import CheckFailed
from tradewind.operators.writes import append_table, write_months, write_table
from tradewind.plans import jobs
from tradewind.schemas import MONTH_KEY, PARTITION_MONTH, RAW_COLUMNS, mart_schema, struct
from tradewind.sources.warehouse import (
    Warehouse,
    landed_months,
    read_existing,
    read_mart,
    read_raw,
)

JAN, FEB = "2017-01", "2017-02"


@pytest.fixture
def warehouse(tmp_path):
    return Warehouse(str(tmp_path))


def land(warehouse, table, df):
    write_months(with_month(df, table), warehouse.landing(table), PARTITION_MONTH)


def load_statics(spark, warehouse):
    frames = {"order_payments": payments, "order_items": items, "customers": customers}
    for table, frame in frames.items():
        write_table(frame(spark), warehouse.landing(table))
    jobs.load_static(spark, warehouse, tuple(frames))


def ids(df, column="order_id"):
    return sorted(row[0] for row in df.select(column).collect())


def mart_ids(spark, warehouse):
    return ids(read_mart(spark, warehouse, "fct_orders"))


def deliver(spark, warehouse, months, mode, *order_ids):
    """Raw orders become exactly the given ones, then the mart is updated."""
    raw = with_month(orders(spark, *order_ids), "orders")
    write_months(raw, warehouse.raw("orders"), PARTITION_MONTH)
    update_mart(spark, warehouse, months, mode)
    return mart_ids(spark, warehouse)


def update_mart(spark, warehouse, months, mode=jobs.MONTHS, full_refresh=False):
    raw = [read_raw(spark, warehouse, table) for table in ("orders", "order_payments")]
    jobs.update_fct_orders(spark, warehouse, *raw, months, mode, full_refresh)


def test_reload_is_idempotent_and_leaves_other_months_alone(spark, warehouse):
    raw = with_month(orders(spark, "o1", "o3", "o7"), "orders")
    append_table(raw, warehouse.raw("orders"), PARTITION_MONTH)
    land(warehouse, "orders", orders(spark, "o1", "o2"))
    for _ in range(2):
        reload_months(spark, warehouse, "orders", [JAN])
        assert ids(read_raw(spark, warehouse, "orders")) == ["o1", "o2", "o3", "o7"]


def test_month_that_did_not_land_ends_up_empty(spark, warehouse):
    raw = with_month(orders(spark, "o1", "o3", "o7"), "orders")
    append_table(raw, warehouse.raw("orders"), PARTITION_MONTH)
    land(warehouse, "orders", orders(spark, "o1"))
    reload_months(spark, warehouse, "orders", [FEB])
    assert ids(read_raw(spark, warehouse, "orders")) == ["o1", "o7"]


def test_first_load_of_a_month_needs_no_table(spark, warehouse):
    delete_month(spark, warehouse, "orders", JAN)
    land(warehouse, "orders", orders(spark, "o1", "o3"))
    reload_months(spark, warehouse, "orders", [JAN, "2016-12"])
    assert ids(read_raw(spark, warehouse, "orders")) == ["o1"]


def test_delete_month_keeps_undated_rows(spark, warehouse):
    raw = with_month(orders(spark, "o1", "o3", "o7"), "orders")
    append_table(raw, warehouse.raw("orders"), PARTITION_MONTH)
    delete_month(spark, warehouse, "orders", JAN)
    assert ids(read_raw(spark, warehouse, "orders")) == ["o3", "o7"]
    assert ids(without_month(raw, MONTH_KEY["orders"], JAN)) == ["o3", "o7"]


def test_december_ends_with_the_year(spark):
    df = reviews(spark, ("r1", "2016-12-31 23:59:59"), ("r2", "2017-01-01 00:00:00"))
    assert ids(without_month(df, "review_creation_date", "2016-12"), "review_id") == ["r2"]


def test_undated_rows_land_but_belong_to_no_month(spark, warehouse):
    land(warehouse, "orders", orders(spark, "o1", "o7"))
    assert landed_months(spark, warehouse, "orders") == [JAN]
    assert jobs.undated_rows(spark, warehouse, "orders") == 1


def test_split_month_in_both_modes(spark, tmp_path):
    kept = {}
    for mode in (jobs.MONTHS, jobs.HIGH_WATER_MARK):
        warehouse = Warehouse(str(tmp_path / mode))
        load_statics(spark, warehouse)
        deliver(spark, warehouse, [JAN], mode, "o1", "o2")
        deliver(spark, warehouse, [FEB], mode, "o1", "o2", "o4")
        kept[mode] = deliver(spark, warehouse, [FEB], mode, "o1", "o2", "o4", "o5", "o6")
    assert kept[jobs.MONTHS] == ["o1", "o2", "o4", "o5", "o6"]
    assert kept[jobs.HIGH_WATER_MARK] == ["o1", "o2", "o5", "o6"]


@pytest.mark.parametrize("mode", [jobs.MONTHS, jobs.HIGH_WATER_MARK])
def test_same_run_again_changes_nothing(spark, warehouse, mode):
    load_statics(spark, warehouse)
    first = deliver(spark, warehouse, [JAN, FEB], mode, "o1", "o2", "o4")
    assert deliver(spark, warehouse, [JAN, FEB], mode, "o1", "o2", "o4") == first


def test_months_out_of_order(spark, tmp_path):
    kept = {}
    for mode in (jobs.MONTHS, jobs.HIGH_WATER_MARK):
        warehouse = Warehouse(str(tmp_path / mode))
        load_statics(spark, warehouse)
        deliver(spark, warehouse, [FEB], mode, "o4")
        kept[mode] = deliver(spark, warehouse, [JAN], mode, "o1", "o4")
    assert kept[jobs.MONTHS] == ["o1", "o4"]
    assert kept[jobs.HIGH_WATER_MARK] == ["o4"]


def test_removed_orders_leave_the_mart(spark, warehouse):
    load_statics(spark, warehouse)
    deliver(spark, warehouse, [JAN, FEB], jobs.MONTHS, "o1", "o2", "o4")
    assert deliver(spark, warehouse, [JAN, FEB], jobs.MONTHS, "o4") == ["o4"]


def test_first_run_keeps_undated_orders_and_full_refresh_rebuilds(spark, warehouse):
    load_statics(spark, warehouse)
    assert deliver(spark, warehouse, [JAN], jobs.MONTHS, "o1", "o7") == ["o1", "o7"]
    assert deliver(spark, warehouse, [JAN], jobs.MONTHS, "o1") == ["o1", "o7"]
    update_mart(spark, warehouse, [], full_refresh=True)
    assert mart_ids(spark, warehouse) == ["o1"]


def test_high_water_mark_of_nothing(spark, warehouse):
    schema = mart_schema("fct_orders")
    assert read_existing(spark, warehouse.mart("fct_orders"), schema) is None
    empty = spark.createDataFrame([], schema)
    assert high_water_mark(empty, "purchased_at").first()[0].year == 1900
    assert stored_high_water_mark(empty, "purchased_at", "purchase_month").year == 1900


def test_jobs_end_to_end(spark, warehouse):
    load_statics(spark, warehouse)
    land(warehouse, "orders", orders(spark))
    land(warehouse, "order_reviews", reviews(spark, ("r1", "2017-01-09 00:00")))
    jobs.backfill(spark, warehouse, [JAN])
    assert mart_ids(spark, warehouse) == ["o1", "o2"]
    for _ in range(2):
        jobs.run_month(spark, warehouse, FEB)
        assert mart_ids(spark, warehouse) == ["o1", "o2", "o4", "o5", "o6"]
    assert ids(read_mart(spark, warehouse, "fct_seller_revenue"), "seller_id") == [
        "s1", "s1", "s2", "s3",
    ]
    assert read_mart(spark, warehouse, "fct_delivery_by_state").count() == 5
    views = jobs.register_views(spark, warehouse)
    assert {"stg_orders", "int_orders_enriched", "fct_orders"} <= set(views)
    assert spark.sql("SELECT sum(total_order_revenue) FROM fct_orders").first()[0] == 42.55


def test_month_before_anything_landed(spark, warehouse):
    load_statics(spark, warehouse)
    jobs.run_month(spark, warehouse, "2016-12")
    assert mart_ids(spark, warehouse) == []
    land(warehouse, "orders", orders(spark, "o1"))
    jobs.run_month(spark, warehouse, JAN)
    assert mart_ids(spark, warehouse) == ["o1"]


def test_failed_check_keeps_the_marts_unwritten(spark, warehouse):
    load_statics(spark, warehouse)
    twice = orders(spark, "o1").unionAll(orders(spark, "o1"))
    land(warehouse, "orders", twice)
    with pytest.raises(CheckFailed, match="stg_orders.order_id unique: 1"):
        jobs.run_month(spark, warehouse, JAN)
    schema = mart_schema("fct_orders")
    assert read_existing(spark, warehouse.mart("fct_orders"), schema) is None


def test_static_checks_run_on_loaded_tables(spark, warehouse):
    load_statics(spark, warehouse)
    for table in ("products", "sellers"):
        write_table(spark.createDataFrame([], struct(RAW_COLUMNS[table])), warehouse.raw(table))
    report = jobs.check_static(spark, warehouse)
    assert report.count() == 23
    failures = {(r.model, r.column): r.failing for r in report.where("failing > 0").collect()}
    assert failures == {("stg_order_payments", "payment_value"): 1}


def loaded(spark, warehouse, *order_ids):
    load_statics(spark, warehouse)
    land(warehouse, "orders", orders(spark, *order_ids))


def test_repeat_across_months_is_found(spark, warehouse):
    """The month at hand has the id once, and so has one that was checked before."""
    loaded(spark, warehouse, "o1", "o2")
    jobs.run_month(spark, warehouse, JAN)
    again = orders(spark, "o4", "o5").replace("o5", "o1", subset="order_id")
    land(warehouse, "orders", orders(spark, "o1", "o2").unionAll(again))
    with pytest.raises(CheckFailed, match="stg_orders.order_id unique: 1$"):
        jobs.run_month(spark, warehouse, FEB)
    assert mart_ids(spark, warehouse) == ["o1", "o2"]


def test_repeat_among_undated_orders_is_found(spark, warehouse):
    loaded(spark, warehouse, "o1")
    undated = with_month(orders(spark, "o7").replace("o7", "o1", subset="order_id"), "orders")
    append_table(undated, warehouse.raw("orders"), PARTITION_MONTH)
    with pytest.raises(CheckFailed, match="stg_orders.order_id unique: 1$"):
        jobs.run_month(spark, warehouse, JAN)


def built(monkeypatch):
    """The months of each build from now on."""
    seen, build = [], jobs.build_marts
    monkeypatch.setattr(
        jobs, "build_marts", lambda s, w, months, *args, **kw: seen.append(months) or build(s, w, months, *args, **kw)
    )
    return seen


def test_month_behind_is_built_with_the_next_and_no_other(spark, warehouse, monkeypatch):
    loaded(spark, warehouse, "o1", "o4")
    seen = built(monkeypatch)
    jobs.backfill(spark, warehouse, [JAN, FEB])
    # January comes again with a fault; its raw month is replaced before the check stops the run.
    land(warehouse, "orders", orders(spark, "o1", "o2").unionAll(orders(spark, "o2", "o4")))
    with pytest.raises(CheckFailed):
        jobs.run_month(spark, warehouse, JAN)
    assert jobs.months_behind(spark, warehouse) == [JAN]
    # The fault stops the run of another month as well.
    with pytest.raises(CheckFailed):
        jobs.run_month(spark, warehouse, "2017-03")
    assert mart_ids(spark, warehouse) == ["o1", "o4"]
    # Mended in the raw table by hand, it is built with the next month, and February is not.
    land(warehouse, "orders", orders(spark, "o1", "o2", "o4"))
    reload_months(spark, warehouse, "orders", [JAN])
    jobs.run_month(spark, warehouse, "2017-03")
    assert seen == [[JAN, FEB], [JAN, "2017-03"]]
    assert mart_ids(spark, warehouse) == ["o1", "o2", "o4"]
    assert jobs.months_behind(spark, warehouse) == []


def test_build_that_fails_is_made_up_for(spark, warehouse, monkeypatch):
    loaded(spark, warehouse, "o1", "o4")
    jobs.run_month(spark, warehouse, JAN)
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "update_fct_orders", lambda *args, **kw: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.run_month(spark, warehouse, FEB)
    assert jobs.months_behind(spark, warehouse) == [FEB]
    seen = built(monkeypatch)
    jobs.run_month(spark, warehouse, "2017-03")
    assert seen == [["2017-02", "2017-03"]]
    assert mart_ids(spark, warehouse) == ["o1", "o4"]


def test_month_gone_from_the_raw_table_is_behind(spark, warehouse):
    loaded(spark, warehouse, "o1", "o4")
    jobs.backfill(spark, warehouse, [JAN, FEB])
    delete_month(spark, warehouse, "orders", FEB)
    assert jobs.months_behind(spark, warehouse) == [FEB]
    jobs.run_month(spark, warehouse, JAN)
    assert mart_ids(spark, warehouse) == ["o1"]
    assert jobs.months_behind(spark, warehouse) == []
