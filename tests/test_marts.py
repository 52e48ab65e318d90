"""Marts, KPIs and checks on a hand-worked fixture with nulls, repeats and odd spans."""

import pytest
from marketplace import customers, items, orders, payments

from tradewind.functions.money import money_sum
from tradewind.operators.quality import (
    CHECKS,
    NOT_NULL,
    Check,
    CheckFailed,
    check_report,
    enforce,
)
from tradewind.plans import kpi, marts
from tradewind.plans.staging import STAGING, rename, stage


@pytest.fixture(scope="module")
def staged(spark):
    raw = {
        "stg_orders": orders(spark),
        "stg_order_payments": payments(spark),
        "stg_order_items": items(spark),
        "stg_customers": customers(spark),
    }
    return {model: stage(model, df) for model, df in raw.items()}


def enriched(staged, whole_days=False):
    return marts.int_orders_enriched(
        staged["stg_orders"], staged["stg_customers"], whole_days=whole_days
    )


@pytest.mark.parametrize("unique", [False, True])
def test_fct_orders(staged, unique):
    mart = marts.fct_orders(
        staged["stg_orders"], staged["stg_order_payments"], orders_unique=unique
    )
    assert {r.order_id: r.total_order_revenue for r in mart.collect()} == {
        "o1": 30.30, "o2": 5.0, "o4": 0.0, "o5": 0.0, "o6": 7.25, "o7": 1.0,
    }


@pytest.mark.parametrize(
    ("whole_days", "days"),
    [
        (False, {"o1": 5, "o2": 1, "o4": 10, "o5": None, "o6": -1, "o7": None}),
        (True, {"o1": 4, "o2": 0, "o4": 10, "o5": None, "o6": -1, "o7": None}),
    ],
)
def test_days_to_delivery(staged, whole_days, days):
    rows = enriched(staged, whole_days).collect()
    assert {r.order_id: r.days_to_delivery for r in rows} == days


def test_kpi_monthly(staged):
    mart = marts.fct_orders(staged["stg_orders"], staged["stg_order_payments"])
    assert [tuple(r) for r in kpi.kpi_monthly(mart).collect()] == [
        (None, 1, 1.0), ("2017-01", 2, 35.3), ("2017-02", 3, 7.25),
    ]


@pytest.mark.parametrize(
    ("whole_days", "expected"),
    [
        (False, [(None, 10.0), ("SP", 5.0), ("RJ", 1.0)]),
        (True, [(None, 10.0), ("SP", 4.0), ("RJ", 0.0)]),
    ],
)
def test_kpi_delivery_by_state(staged, whole_days, expected):
    delivery = marts.fct_delivery_by_state(enriched(staged, whole_days))
    assert [tuple(r) for r in kpi.kpi_delivery_by_state(delivery).collect()] == expected


def test_kpi_top_sellers(staged):
    mart = marts.fct_seller_revenue(staged["stg_order_items"], staged["stg_orders"])
    top = [("s1", 15.5), ("s2", 15.0), ("s3", 15.0)]
    assert [tuple(r) for r in kpi.kpi_top_sellers(mart).collect()] == top
    assert [tuple(r) for r in kpi.kpi_top_sellers_ascending(mart).collect()] == top[::-1]


@pytest.mark.parametrize(("whole_days", "mean"), [(False, 5.3), (True, 4.7)])
def test_kpi_summary(staged, whole_days, mean):
    mart = marts.fct_orders(staged["stg_orders"], staged["stg_order_payments"])
    delivery = marts.fct_delivery_by_state(enriched(staged, whole_days))
    assert [tuple(r) for r in kpi.kpi_summary(mart, delivery).collect()] == [(6, 0.0, mean)]


def test_repeated_order_counts_once_per_copy(spark, staged):
    twice = staged["stg_orders"].unionAll(staged["stg_orders"])
    mart = marts.fct_seller_revenue(staged["stg_order_items"], twice)
    assert mart.count() == 8
    assert marts.fct_orders(twice, staged["stg_order_payments"]).count() == 12


def test_products_without_category_are_unknown(spark):
    raw = spark.createDataFrame(
        [("p1", None, 3), (None, "toys", 4)],
        "product_id string, product_category_name string, product_name_lenght bigint",
    )
    for source in STAGING["stg_products"].columns.values():
        if source not in raw.columns:
            raw = raw.selectExpr("*", f"CAST(NULL AS double) AS {source}")
    rows = stage("stg_products", raw).collect()
    assert [(r.product_id, r.category_name, r.product_name_length) for r in rows] == [
        ("p1", "unknown", 3)
    ]


def test_check_list_has_all_28():
    assert len(CHECKS) == 28
    assert sum(c.kind == NOT_NULL for c in CHECKS) == 22


def failing(report):
    return {(r.column, r.check): r.failing for r in report.collect()}


def test_checks_on_raw_and_staged_orders(spark, staged):
    checks = tuple(c for c in CHECKS if c.model == "stg_orders")
    raw = failing(check_report({"stg_orders": rename("stg_orders", orders(spark))}, checks))
    assert raw["order_id", "not_null"] == 1
    assert raw["purchased_at", "not_null"] == 1
    kept = failing(check_report({"stg_orders": staged["stg_orders"]}, checks))
    assert kept["order_id", "not_null"] == 0
    assert kept["purchased_at", "not_null"] == 1
    assert kept["order_id", "unique"] == 0


def test_checks_count_values_not_rows(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("a", "y"), ("b", "ok"), (None, None), (None, "x"), ("c", "z")],
        "k string, v string",
    )
    checks = (Check("m", "k", "unique"), Check("m", "v", "accepted_values", ("ok",)))
    assert failing(check_report({"m": df}, checks)) == {
        ("k", "unique"): 1, ("v", "accepted_values"): 3,
    }


def test_gate_names_what_failed(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    good = check_report({"m": df}, (Check("m", "k", "unique"),))
    enforce(good)
    with pytest.raises(CheckFailed, match="m.k not_null: 1"):
        enforce(check_report({"m": df}, (Check("m", "k", "not_null"),)))


@pytest.mark.parametrize(
    ("amounts", "total"),
    [
        ([10.1, 20.2], 30.3),
        ([0.1] * 10, 1.0),
        ([-0.5, 0.25], -0.25),
        ([1e15, 0.25, 0.25], 1000000000000000.5),
        ([None, 2.5], 2.5),
        ([None], None),
        ([9e18, 9e18, -0.5], 1.8e19),
    ],
)
def test_money_sum(spark, amounts, total):
    df = spark.createDataFrame([(a,) for a in amounts], "v double")
    assert df.agg(money_sum("v")).first()[0] == total
