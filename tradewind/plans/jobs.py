"""The jobs: ingest CSV files, load raw tables, run or backfill months, build marts."""

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.casts import cast_columns
from tradewind.functions.dates import month_label, month_start
from tradewind.operators.months import reload_months, stored_high_water_mark, with_month
from tradewind.operators.quality import CHECKS, Check, check_part, check_report, enforce
from tradewind.operators.writes import (
    overwrite_months,
    write_clustered,
    write_months,
    write_table,
)
from tradewind.plans.marts import (
    SPREAD,
    fct_delivery_by_state,
    fct_orders,
    fct_seller_revenue,
    int_orders_enriched,
)
from tradewind.plans.staging import STAGING, stage
from tradewind.schemas import (
    BUILT_FROM,
    DELIVERED,
    MART_COLUMNS,
    MONTH_KEY,
    MULTILINE_TABLES,
    PARTITION_MONTH,
    PURCHASE_MONTH,
    RAW_COLUMNS,
    STATIC_TABLES,
    mart_schema,
    raw_schema,
    struct,
)
from tradewind.session import configure
from tradewind.sources.csv import read_table_csv
from tradewind.sources.warehouse import (
    Warehouse,
    drop_months,
    month_files,
    read_declared,
    read_existing,
    read_mart,
    read_raw,
)

# Ways of keeping fct_orders up to date.
MONTHS = "months"
HIGH_WATER_MARK = "high_water_mark"

# The checked model the marts of a monthly run depend on, and those checked after a static load.
MONTHLY_CHECKED = "stg_orders"
STATIC_CHECKED = (
    "stg_order_items",
    "stg_order_payments",
    "stg_products",
    "stg_sellers",
    "stg_customers",
)


def ingest(
    spark: SparkSession,
    csv_paths: dict[str, str],
    warehouse: Warehouse,
    multiline_tables: tuple[str, ...] = MULTILINE_TABLES,
) -> None:
    """CSV files to typed landing files, orders and reviews split by month.

    ``csv_paths`` gives a file, folder or pattern per table, ``multiline_tables`` the tables
    whose texts may hold line breaks. A row that does not fit its header fails the job.
    """
    configure(spark)
    for table, path in csv_paths.items():
        typed = cast_columns(read_table_csv(spark, path, table, multiline_tables), table)
        if table in MONTH_KEY:
            write_months(with_month(typed, table), warehouse.landing(table), PARTITION_MONTH)
        else:
            write_table(typed, warehouse.landing(table))


def undated_rows(spark: SparkSession, warehouse: Warehouse, table: str) -> int:
    """Landed rows without a time. They belong to no month, so no monthly load takes them."""
    landed = read_declared(spark, warehouse.landing(table), raw_schema(table))
    return landed.where(F.col(PARTITION_MONTH).isNull()).count()


def load_static(
    spark: SparkSession, warehouse: Warehouse, tables: tuple[str, ...] = STATIC_TABLES
) -> None:
    """Replace static raw tables by what has landed; safe to repeat."""
    for table in tables:
        landed = read_declared(spark, warehouse.landing(table), raw_schema(table))
        write_table(landed, warehouse.raw(table))


def check_static(
    spark: SparkSession, warehouse: Warehouse, checks: tuple[Check, ...] = CHECKS
) -> DataFrame:
    """Report of the checks on the static staging models."""
    return check_report(staged(spark, warehouse, STATIC_CHECKED), checks)


def run_month(
    spark: SparkSession,
    warehouse: Warehouse,
    month: str,
    mode: str = MONTHS,
    checks: tuple[Check, ...] = CHECKS,
    delivered: str = DELIVERED,
) -> None:
    """Reload one month of orders and reviews, check the orders, bring the marts up to date."""
    backfill(spark, warehouse, [month], mode, checks, delivered)


def backfill(
    spark: SparkSession,
    warehouse: Warehouse,
    months: list[str],
    mode: str = MONTHS,
    checks: tuple[Check, ...] = CHECKS,
    delivered: str = DELIVERED,
) -> None:
    """``run_month`` for many months at once: one load per table, one build per mart.

    Months whose raw files are not those the order mart was built from are checked and built as
    well: those of an earlier run that a check has stopped, or that failed. Others are not read
    but for the order ids that the unique check looks for.
    """
    configure(spark)
    for table in MONTH_KEY:
        reload_months(spark, warehouse, table, months)
    due = sorted({*months, *months_behind(spark, warehouse)})
    enforce(check_months(spark, warehouse, due, checks))
    files = _raw_files(spark, warehouse)
    build_marts(spark, warehouse, due, mode, delivered, orders_unique=_unique(checks))
    rows = spark.createDataFrame(sorted(files.items()), struct(BUILT_FROM))
    write_table(rows.coalesce(1), warehouse.built_from("fct_orders"))


def check_months(
    spark: SparkSession, warehouse: Warehouse, months: list[str], checks: tuple[Check, ...] = CHECKS
) -> DataFrame:
    """Report of the checks on the orders of some months, the others having passed them before."""
    raw = read_raw(spark, warehouse, "orders")
    own = F.coalesce(F.col(PARTITION_MONTH).isin(*months), F.lit(False))
    part, others = (stage(MONTHLY_CHECKED, df) for df in (raw.where(own), raw.where(~own)))
    if others.isEmpty():
        # As in a whole backfill: there is nothing to join, so ids are shuffled once.
        return check_report({MONTHLY_CHECKED: part}, tuple(c for c in checks if c.model == MONTHLY_CHECKED))
    return check_part(MONTHLY_CHECKED, part, others, checks)


def months_behind(spark: SparkSession, warehouse: Warehouse) -> list[str]:
    """Months whose stored raw orders are others than those the order mart was built from."""
    built = read_existing(spark, warehouse.built_from("fct_orders"), struct(BUILT_FROM))
    before = {} if built is None else {row["month"]: row["files"] for row in built.collect()}
    now = _raw_files(spark, warehouse)
    return sorted(m for m in before.keys() | now.keys() if before.get(m) != now.get(m))


def _raw_files(spark: SparkSession, warehouse: Warehouse) -> dict[str, str]:
    """A digest of the names of the raw order files by month. Names are new in every write."""
    files = month_files(spark, warehouse.raw("orders"), PARTITION_MONTH)
    return {m: md5("/".join(sorted(names)).encode()).hexdigest() for m, names in files.items()}


def build_marts(
    spark: SparkSession,
    warehouse: Warehouse,
    months: list[str],
    mode: str = MONTHS,
    delivered: str = DELIVERED,
    orders_unique: bool = False,
) -> None:
    """The three marts: orders by month, the other two whole and clustered."""
    update_fct_orders(
        spark,
        warehouse,
        read_raw(spark, warehouse, "orders"),
        read_raw(spark, warehouse, "order_payments"),
        months,
        mode,
        delivered=delivered,
        orders_unique=orders_unique,
    )
    models = staged(spark, warehouse, ("stg_orders", "stg_order_items", "stg_customers"))
    orders = models["stg_orders"]
    enriched = int_orders_enriched(orders, models["stg_customers"], delivered)
    write_clustered(
        fct_delivery_by_state(enriched, spread=True),
        warehouse.mart("fct_delivery_by_state"),
        "state",
        spread=SPREAD,
    )
    write_clustered(
        fct_seller_revenue(models["stg_order_items"], orders, delivered, spread=True),
        warehouse.mart("fct_seller_revenue"),
        "seller_id",
        spread=SPREAD,
    )


def update_fct_orders(
    spark: SparkSession,
    warehouse: Warehouse,
    raw_orders: DataFrame,
    raw_payments: DataFrame,
    months: list[str],
    mode: str = MONTHS,
    full_refresh: bool = False,
    delivered: str = DELIVERED,
    orders_unique: bool = False,
) -> None:
    """Bring the stored order mart up to date; build it whole where none is stored.

    ``raw_orders`` has its partition month, so that only the directories needed are read.
    ``months`` mode computes every given month anew and replaces it, so late, corrected and
    removed orders come out right. ``high_water_mark`` mode takes only orders later than the
    stored maximum and then replaces the months those fall in: it loses the earlier rows of a
    month that arrives in two parts.
    """
    if mode not in (MONTHS, HIGH_WATER_MARK):
        raise ValueError(f"unknown mode {mode!r}")
    path, schema = warehouse.mart("fct_orders"), mart_schema("fct_orders")
    payments = stage("stg_order_payments", raw_payments)

    def totals(raw: DataFrame, some: bool = True) -> DataFrame:
        orders = stage("stg_orders", raw)
        wanted = orders.where(F.col("order_status") == delivered).select("order_id")
        # Of all payments ever made, only those of the orders at hand are grouped.
        own = payments.join(wanted, "order_id", "left_semi") if some else payments
        mart = fct_orders(orders, own, delivered, orders_unique)
        return mart.withColumn(PURCHASE_MONTH, month_label(month_start(F.col("purchased_at"))))

    stored = None if full_refresh else read_existing(spark, path, schema)
    if stored is None:
        write_months(totals(raw_orders, some=False), path, PURCHASE_MONTH)
    elif mode == HIGH_WATER_MARK:
        # Read before the write, as one value: the plan must not scan what it replaces.
        mark = stored_high_water_mark(stored, "purchased_at", PURCHASE_MONTH)
        # As text: a datetime literal would pass through the session time zone.
        latest = F.lit(str(mark)).cast("timestamp_ntz")
        later = raw_orders.where(F.col(PARTITION_MONTH) >= f"{mark:%Y-%m}").where(
            F.col(MONTH_KEY["orders"]) > latest
        )
        overwrite_months(totals(later), path, PURCHASE_MONTH)
    else:
        touched = raw_orders.where(F.col(PARTITION_MONTH).isin(*months))
        before = month_files(spark, path, PURCHASE_MONTH)
        overwrite_months(totals(touched), path, PURCHASE_MONTH, spread=len(set(months)) > 1)
        # A dynamic overwrite leaves a month alone for which there is no row any more. File
        # names are new in every write, so such a month still has its old ones.
        after = month_files(spark, path, PURCHASE_MONTH)
        gone = {m for m in months if m in after and after[m] == before.get(m)}
        drop_months(spark, path, PURCHASE_MONTH, gone)


def staged(
    spark: SparkSession, warehouse: Warehouse, models: tuple[str, ...] = tuple(STAGING)
) -> dict[str, DataFrame]:
    """Staging models over the stored raw tables."""
    return {m: stage(m, read_raw(spark, warehouse, STAGING[m].table)) for m in models}


def register_views(spark: SparkSession, warehouse: Warehouse) -> list[str]:
    """Temp views of every stored raw table's models and of the marts, for SQL users."""
    stored = [
        t for t in RAW_COLUMNS if read_existing(spark, warehouse.raw(t), raw_schema(t)) is not None
    ]
    views = staged(spark, warehouse, tuple(m for m in STAGING if STAGING[m].table in stored))
    if {"stg_orders", "stg_customers"} <= views.keys():
        views["int_orders_enriched"] = int_orders_enriched(
            views["stg_orders"], views["stg_customers"]
        )
    for mart in MART_COLUMNS:
        if read_existing(spark, warehouse.mart(mart), mart_schema(mart)) is not None:
            views[mart] = read_mart(spark, warehouse, mart)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)


def _unique(checks: tuple[Check, ...]) -> bool:
    """Whether the list has the check that proves order ids unique."""
    return any(
        (c.model, c.column, c.kind) == ("stg_orders", "order_id", "unique") for c in checks
    )
