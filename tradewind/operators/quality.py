"""Declarative data-quality checks: a list of checks, a report, a gate."""

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_NULL, UNIQUE, ACCEPTED = "not_null", "unique", "accepted_values"


@dataclass(frozen=True)
class Check:
    model: str
    column: str
    kind: str
    values: tuple[str, ...] = ()


# The 28 checks on the staging models.
ORDER_STATUSES = (
    "delivered", "shipped", "canceled", "invoiced", "processing", "approved", "unavailable",
    "created",
)
PAYMENT_TYPES = ("credit_card", "boleto", "voucher", "debit_card", "not_defined")
REQUIRED = {
    "stg_orders": ("order_id", "customer_id", "purchased_at"),
    "stg_order_items": (
        "order_id", "order_item_id", "product_id", "seller_id", "item_price", "freight_value",
    ),
    "stg_order_payments": (
        "order_id", "payment_sequential", "payment_type", "payment_installments",
        "payment_value",
    ),
    "stg_products": ("product_id", "category_name"),
    "stg_sellers": ("seller_id", "zip_code_prefix", "city"),
    "stg_customers": ("customer_id", "customer_unique_id", "zip_code_prefix"),
}
KEYS = {
    "stg_orders": "order_id",
    "stg_products": "product_id",
    "stg_sellers": "seller_id",
    "stg_customers": "customer_id",
}
CHECKS = (
    *(Check(model, c, NOT_NULL) for model, columns in REQUIRED.items() for c in columns),
    *(Check(model, key, UNIQUE) for model, key in KEYS.items()),
    Check("stg_orders", "order_status", ACCEPTED, ORDER_STATUSES),
    Check("stg_order_payments", "payment_type", ACCEPTED, PAYMENT_TYPES),
)


class CheckFailed(Exception):
    """Carries the failed rows of a report."""

    def __init__(self, failures):
        self.failures = failures
        lines = (f"{f.model}.{f.column} {f.check}: {f.failing}" for f in failures)
        super().__init__("; ".join(lines))


def accepting(checks: tuple[Check, ...], column: str, values: tuple[str, ...]):
    """The same checks with another list of accepted values for ``column``."""
    return tuple(
        replace(c, values=values) if c.kind == ACCEPTED and c.column == column else c
        for c in checks
    )


def check_report(models: dict[str, DataFrame], checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """(model, column, check, failing) for every check on the given models.

    All null and value checks of a model share one pass; each unique check is a grouping of
    its own column alone, combined before the shuffle.
    """
    parts = []
    for model, df in models.items():
        own = [c for c in checks if c.model == model]
        one_pass = [c for c in own if c.kind != UNIQUE]
        if one_pass:
            parts.append(_one_pass(df, one_pass))
        parts.extend(_repeated(df, c) for c in own if c.kind == UNIQUE)
    return reduce(DataFrame.unionByName, parts)


def check_part(
    model: str, part: DataFrame, others: DataFrame, checks: tuple[Check, ...] = CHECKS
) -> DataFrame:
    """The report for the rows of a model that are new, ``others`` being its checked rows.

    Null and value checks read the new rows alone. Of the others a unique check reads its column,
    and keeps only values that the new rows have too, so values of all time are never grouped. It
    counts the new rows' values that occur again among them or among the others.
    """
    own = tuple(c for c in checks if c.model == model)
    one_pass = tuple(c for c in own if c.kind != UNIQUE)
    parts = [check_report({model: part}, one_pass)] if one_pass else []
    parts.extend(_repeated_in_part(part, others, c) for c in own if c.kind == UNIQUE)
    return reduce(DataFrame.unionByName, parts)


def enforce(report: DataFrame) -> None:
    """Raise when any check failed. The report has one row per check."""
    failures = report.where("failing > 0").orderBy("model", "column", "check").collect()
    if failures:
        raise CheckFailed(failures)


def _one_pass(df: DataFrame, checks: list[Check]) -> DataFrame:
    counts = df.agg(*[_failing(c).alias(f"n{i}") for i, c in enumerate(checks)])
    rows = [_row(c, F.col(f"n{i}")) for i, c in enumerate(checks)]
    return counts.select(F.inline(F.array(*rows)))


def _failing(check: Check) -> Column:
    c = F.col(check.column)
    if check.kind == NOT_NULL:
        return F.count_if(c.isNull())
    # Counts the values outside the list, not the rows; null is never outside.
    return F.count_distinct(F.when(~c.isin(*check.values), c))


def _repeated(df: DataFrame, check: Check) -> DataFrame:
    c = F.col(check.column)
    per_value = df.where(c.isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    failing = per_value.agg(F.count_if(F.col("n") > 1).alias("failing"))
    return failing.select(F.inline(F.array(_row(check, F.col("failing")))))


def _repeated_in_part(part: DataFrame, others: DataFrame, check: Check) -> DataFrame:
    c = F.col(check.column)
    per_value = part.where(c.isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    again = others.select(c).join(per_value, check.column, "left_semi")
    repeated = per_value.where("n > 1").select(c).unionAll(again)
    failing = repeated.agg(F.count_distinct(c).alias("failing"))
    return failing.select(F.inline(F.array(_row(check, F.col("failing")))))


def _row(check: Check, failing: Column) -> Column:
    return F.struct(
        F.lit(check.model).alias("model"),
        F.lit(check.column).alias("column"),
        F.lit(check.kind).alias("check"),
        failing.cast("bigint").alias("failing"),
    )
