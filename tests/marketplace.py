"""A small marketplace: every edge the marts have to get right, once."""

from datetime import datetime

from tradewind.schemas import RAW_COLUMNS, struct


def _frame(spark, table, rows):
    return spark.createDataFrame(rows, struct(RAW_COLUMNS[table]))


def ts(text):
    return datetime.fromisoformat(text) if text else None


ORDERS = [
    ("o1", "c1", "delivered", "2017-01-05 10:00", "2017-01-10 09:00"),
    ("o2", "c2", "delivered", "2017-01-31 23:00", "2017-02-01 01:00"),
    ("o3", "c1", "shipped", "2017-02-03 08:00", None),
    ("o4", "c9", "delivered", "2017-02-10 12:00", "2017-02-20 12:00"),
    ("o5", "c2", "delivered", "2017-02-11 00:00", None),
    ("o6", "c1", "delivered", "2017-02-12 12:00", "2017-02-11 12:00"),
    (None, "c1", "delivered", "2017-02-13 00:00", "2017-02-14 00:00"),
    ("o7", "c1", "delivered", None, "2017-03-01 00:00"),
]


def orders(spark, *ids):
    """All orders, or those of the given ids."""
    rows = [
        (o, c, status, ts(bought), None, None, ts(arrived), None)
        for o, c, status, bought, arrived in ORDERS
        if not ids or o in ids
    ]
    return _frame(spark, "orders", rows)


def payments(spark):
    amounts = [
        ("o1", 10.1), ("o1", 20.2), ("o2", 5.0), ("o3", 99.0), ("o4", None), ("o6", 7.25),
        ("o7", 1.0),
    ]
    return _frame(
        spark, "order_payments", [(o, i, "voucher", 1, v) for i, (o, v) in enumerate(amounts)]
    )


def items(spark):
    sold = [
        ("o1", "s1", 10.0), ("o1", "s2", 15.0), ("o2", "s1", 5.5), ("o3", "s1", 99.0),
        ("o4", "s3", 15.0), (None, "s1", 1.0),
    ]
    rows = [(o, i, "p1", s, None, price, 0.0) for i, (o, s, price) in enumerate(sold)]
    return _frame(spark, "order_items", rows)


def customers(spark):
    rows = [("c1", "u1", "01037", "a", "SP"), ("c2", "u2", "20000", "b", "RJ")]
    return _frame(spark, "customers", rows)


def reviews(spark, *rows):
    """(review id, day) pairs."""
    return _frame(
        spark, "order_reviews", [(r, "o1", 5, None, None, ts(day), None) for r, day in rows]
    )
