"""Every operator as a query over the driver's tables. Each reads its tables whole.

Queries about storing write to a fresh folder, then return what is read back from it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.casts import cast_columns
from tradewind.functions.dates import in_month, month_label, month_of, month_start, not_in_month
from tradewind.operators.months import (
    delete_month,
    high_water_mark,
    later_than_stored,
    reload_months,
    with_month,
    without_month,
)
from tradewind.operators.quality import (
    ACCEPTED,
    CHECKS,
    NOT_NULL,
    UNIQUE,
    Check,
    check_part,
    check_report,
    enforce,
)
from tradewind.operators.writes import (
    append_table,
    write_clustered,
    write_months,
    write_table,
)
from tradewind.plans import jobs, kpi, marts
from tradewind.plans.staging import STAGING, stage
from tradewind.schemas import (
    MONTH_KEY,
    MULTILINE_TABLES,
    PARTITION_MONTH,
    PURCHASE_MONTH,
    RAW_COLUMNS,
    STATIC_TABLES,
    mart_schema,
    raw_schema,
)
from tradewind.session import configure, scratch_dir
from tradewind.sources.csv import read_table_csv
from tradewind.sources.warehouse import (
    Warehouse,
    landed_months,
    read_declared,
    read_mart,
    read_months,
    read_raw,
)
from tradewind.standins import CHECKS_STANDIN, DELIVERED_STANDIN, raw_table

# The month the single-month queries work on, and the times that part the data into an
# earlier and a later delivery, one at a month's start and one inside a month.
MONTH = "1998-07"
LATER_FROM = "1999-01-01"
MID_MONTH = "1998-01-15"

# Rows of a compressed CSV file, about 20 MB of order items.
GZIP_ROWS = 1_000_000

_Query = Callable[[SparkSession, str], DataFrame]


def _staged(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    return stage(model, raw_table(spark, sf_dir, STAGING[model].table))


def _staging_query(model: str) -> _Query:
    return lambda spark, sf_dir: _staged(spark, sf_dir, model)


def _enriched(spark, sf_dir):
    orders, customers = (_staged(spark, sf_dir, m) for m in ("stg_orders", "stg_customers"))
    return marts.int_orders_enriched(orders, customers, DELIVERED_STANDIN)


def _delivery(spark, sf_dir):
    return marts.fct_delivery_by_state(_enriched(spark, sf_dir))


def _seller_revenue(spark, sf_dir):
    items, orders = (_staged(spark, sf_dir, m) for m in ("stg_order_items", "stg_orders"))
    return marts.fct_seller_revenue(items, orders, DELIVERED_STANDIN)


def _payment_sums(spark, sf_dir):
    return marts.order_payments_sum(_staged(spark, sf_dir, "stg_order_payments"))


def _orders_mart(spark, sf_dir):
    orders, payments = (_staged(spark, sf_dir, m) for m in ("stg_orders", "stg_order_payments"))
    return marts.fct_orders(orders, payments, DELIVERED_STANDIN)


def _monthly(spark, sf_dir):
    return kpi.kpi_monthly(_orders_mart(spark, sf_dir))


def _by_state(spark, sf_dir):
    return kpi.kpi_delivery_by_state(_delivery(spark, sf_dir))


def _top_sellers(spark, sf_dir):
    return kpi.kpi_top_sellers(_seller_revenue(spark, sf_dir))


def _top_sellers_ascending(spark, sf_dir):
    return kpi.kpi_top_sellers_ascending(_seller_revenue(spark, sf_dir))


def _summary(spark, sf_dir):
    return kpi.kpi_summary(_orders_mart(spark, sf_dir), _delivery(spark, sf_dir))


def _mark(spark, sf_dir):
    return high_water_mark(_orders_mart(spark, sf_dir), "purchased_at")


def _mark_filter(spark, sf_dir):
    """Delivered orders past the latest purchase of an earlier build of the mart."""
    mart = _orders_mart(spark, sf_dir)
    stored = mart.where(F.col("purchased_at") < F.lit(LATER_FROM).cast("timestamp_ntz"))
    return later_than_stored(mart, stored, "purchased_at")


def _checks(*kinds: str) -> _Query:
    checks = tuple(c for c in CHECKS if c.kind in kinds)

    def query(spark, sf_dir):
        models = dict.fromkeys(c.model for c in checks)
        return check_report({m: _staged(spark, sf_dir, m) for m in models}, checks)

    return query


# Besides the checks of the orders, one that fails: customers order again in other months.
MONTH_CHECKS = (*CHECKS, Check("stg_orders", "customer_id", UNIQUE))


def _checks_of_a_month(spark, sf_dir):
    """The orders of one month, their ids sought among those of all others."""
    orders = _staged(spark, sf_dir, "stg_orders")
    own = in_month(F.col("purchased_at"), MONTH)
    others = orders.where(not_in_month(F.col("purchased_at"), MONTH))
    return check_part("stg_orders", orders.where(own), others, MONTH_CHECKS)


def _compared(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """By table: the rows that are there, and how many are too many or missing, duplicates
    counted. Every column of every row is compared."""
    report = None
    for name, wanted in expected.items():
        found = actual[name].select(wanted.columns)
        sides = wanted.withColumn("_side", F.lit(1)).unionAll(found.withColumn("_side", F.lit(-1)))
        rows = sides.select(*_packed(sides, wanted.columns), "_side").groupBy("_plain", "_texts").agg(
            F.count_if(F.col("_side") < 0).alias("found"), F.abs(F.sum("_side")).alias("off")
        )
        line = rows.agg(
            F.coalesce(F.sum("found"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum("off"), F.lit(0)).alias("n_different"),
        ).select(F.lit(name).alias("table_name"), "n_rows", "n_different")
        report = line if report is None else report.unionAll(line)
    return report


def _packed(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two columns that are equal just where all of ``columns`` are, shorter in a shuffle.

    Digits, points, signs and exponents are half a byte each, as are the column ends and the marks
    for null and for any other text. Such texts follow in the second column with their lengths.
    """
    plain, texts, kinds = [], [], dict(df.dtypes)
    for name in columns:
        # Zeros of both signs are equal. Midnights go by the number of the day.
        c = F.col(name) + F.lit(0.0) if kinds[name] == "double" else F.col(name)
        text = c.cast("string")
        if kinds[name] == "timestamp_ntz":
            day = c.cast("date")
            midnight = c == day.cast("timestamp_ntz")
            text = F.when(midnight, F.unix_date(day).cast("string")).otherwise(F.translate(text, " :", ".."))
        short = text.rlike(r"^[0-9.E-]+\z")
        plain.append(F.when(short, text).when(text.isNull(), "N").otherwise("T"))
        texts.append(F.when(~short, F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    digits = F.translate(F.concat_ws("|", *plain), ".-E|NT", "ABCDEF")
    even = F.rpad(digits, F.length(digits) + F.length(digits) % 2, "D")
    return [F.unhex(even).alias("_plain"), F.concat_ws(",", *texts).alias("_texts")]


def _cast_order_items(spark, sf_dir):
    return cast_columns(_as_text(raw_table(spark, sf_dir, "order_items")), "order_items")


def _cast_columns(spark, sf_dir):
    """All nine tables to text and back."""
    raw = {table: raw_table(spark, sf_dir, table) for table in RAW_COLUMNS}
    return _compared(raw, {t: cast_columns(_as_text(df), t) for t, df in raw.items()})


def _cast_missing_columns(spark, sf_dir):
    """Declared columns that are not there are left out, columns not declared stay as they are."""
    texts = _as_text(raw_table(spark, sf_dir, "order_items"))
    more = texts.drop("price", "shipping_limit_date").withColumn("note", F.col("order_item_id"))
    return cast_columns(more, "order_items")


def _month_prefix(spark, sf_dir):
    """Orders of the month that a date within it names."""
    orders = _dated(spark, sf_dir, "orders")
    return orders.where(F.col(PARTITION_MONTH) == month_of(f"{MONTH}-15"))


def _csv_roundtrip_items(spark, sf_dir):
    path = scratch_dir(spark)
    _write_csv(_as_text(raw_table(spark, sf_dir, "order_items")), path)
    return cast_columns(read_table_csv(spark, path, "order_items"), "order_items")


def _csv_roundtrip(spark, sf_dir):
    """Reviews whose messages hold commas, quotes and line breaks."""
    path = scratch_dir(spark)
    message = F.concat("review_comment_message", F.lit(', "'), "review_comment_title", F.lit('"\n,end'))
    texts = _as_text(raw_table(spark, sf_dir, "order_reviews"))
    _write_csv(texts.withColumn("review_comment_message", message), path)
    return cast_columns(read_table_csv(spark, path, "order_reviews"), "order_reviews")


def _ingested(spark, sf_dir) -> Warehouse:
    """A warehouse where all nine tables have landed from CSV."""
    warehouse, paths = Warehouse(scratch_dir(spark)), {}
    for table in RAW_COLUMNS:
        paths[table] = f"{warehouse.root}/csv/{table}"
        # Files whose records may go on over lines are read in ranges, so these stay as they are.
        # A compressed file is read by one task, so it has a bounded number of rows.
        codec, rows = ("none", 0) if table in MULTILINE_TABLES else ("gzip", GZIP_ROWS)
        _write_csv(_as_text(raw_table(spark, sf_dir, table)), paths[table], codec, rows)
    jobs.ingest(spark, paths, warehouse)
    return warehouse


def _ingest(spark, sf_dir):
    warehouse = _ingested(spark, sf_dir)
    landed = {t: read_declared(spark, warehouse.landing(t), raw_schema(t)) for t in RAW_COLUMNS}
    return _compared({t: _dated(spark, sf_dir, t) for t in RAW_COLUMNS}, landed)


def _ingest_reviews(spark, sf_dir):
    """The reviews, the ones with free text, as they have landed."""
    warehouse = _ingested(spark, sf_dir)
    return read_declared(spark, warehouse.landing("order_reviews"), raw_schema("order_reviews"))


def _dated(spark, sf_dir, table):
    df = raw_table(spark, sf_dir, table)
    return with_month(df, table) if table in MONTH_KEY else df


def _load_with_schema(spark, sf_dir):
    warehouse = _landed(spark, sf_dir, "order_payments")
    return read_declared(
        spark, warehouse.landing("order_payments"), raw_schema("order_payments")
    )


def _load_static(spark, sf_dir):
    """All static tables, loaded twice."""
    warehouse = _landed(spark, sf_dir, *STATIC_TABLES)
    for _ in range(2):
        jobs.load_static(spark, warehouse)
    expected = {t: raw_table(spark, sf_dir, t) for t in STATIC_TABLES}
    return _compared(expected, {t: read_raw(spark, warehouse, t) for t in STATIC_TABLES})


def _load_static_customers(spark, sf_dir):
    warehouse = _landed(spark, sf_dir, "customers")
    for _ in range(2):
        jobs.load_static(spark, warehouse, ("customers",))
    return read_raw(spark, warehouse, "customers")


def _load_month(spark, sf_dir):
    warehouse = _landed(spark, sf_dir, "orders")
    return read_months(spark, warehouse.landing("orders"), "orders", [MONTH])


def _partition_by_month(spark, sf_dir):
    warehouse = _landed(spark, sf_dir, "orders")
    return read_declared(spark, warehouse.landing("orders"), raw_schema("orders"))


def _append_load(spark, sf_dir):
    """Two appends that make up the table, the first to a table not there yet."""
    warehouse = Warehouse(scratch_dir(spark))
    orders = _dated_orders(spark, sf_dir)
    done = F.col("order_status") == DELIVERED_STANDIN
    for part in (orders.where(done), orders.where(~done)):
        append_table(part, warehouse.raw("orders"), PARTITION_MONTH)
    return read_raw(spark, warehouse, "orders")


def _delete_month(spark, sf_dir):
    return without_month(raw_table(spark, sf_dir, "orders"), MONTH_KEY["orders"], MONTH)


def _delete_month_stored(spark, sf_dir):
    warehouse = _loaded(spark, sf_dir, "orders")
    delete_month(spark, warehouse, "orders", MONTH)
    return read_raw(spark, warehouse, "orders")


def _reload_month(spark, sf_dir):
    """Loading a month that is there already leaves the table as it was."""
    warehouse = _landed(spark, sf_dir, "orders")
    months = landed_months(spark, warehouse, "orders")
    reload_months(spark, warehouse, "orders", months)
    reload_months(spark, warehouse, "orders", [MONTH])
    return read_raw(spark, warehouse, "orders")


def _orders_mart_stored(spark, sf_dir):
    """First run: the mart is written whole, by month."""
    warehouse = Warehouse(scratch_dir(spark))
    _update_mart(spark, warehouse, _dated_orders(spark, sf_dir), sf_dir, [])
    return read_mart(spark, warehouse, "fct_orders")


def _orders_mart_incremental(spark, sf_dir):
    """Earlier months first, then the later ones as a second run."""
    warehouse, orders = Warehouse(scratch_dir(spark)), _dated_orders(spark, sf_dir)
    later = F.col(PARTITION_MONTH) >= LATER_FROM[:7]
    months = [row[0] for row in orders.where(later).select(PARTITION_MONTH).distinct().collect()]
    _update_mart(spark, warehouse, orders.where(~later), sf_dir, [])
    _update_mart(spark, warehouse, orders, sf_dir, months)
    return read_mart(spark, warehouse, "fct_orders")


def _orders_mart_high_water_mark(spark, sf_dir):
    """A month delivered in two parts keeps only its second part in this mode."""
    warehouse, orders = Warehouse(scratch_dir(spark)), _dated_orders(spark, sf_dir)
    early = F.col(MONTH_KEY["orders"]) < F.lit(MID_MONTH).cast("timestamp_ntz")
    for delivery in (orders.where(early), orders):
        _update_mart(spark, warehouse, delivery, sf_dir, [], jobs.HIGH_WATER_MARK)
    return read_mart(spark, warehouse, "fct_orders")


def _dated_orders(spark, sf_dir):
    return _dated(spark, sf_dir, "orders")


def _update_mart(spark, warehouse, orders, sf_dir, months, mode=jobs.MONTHS):
    payments = raw_table(spark, sf_dir, "order_payments")
    jobs.update_fct_orders(
        spark, warehouse, orders, payments, months, mode, delivered=DELIVERED_STANDIN
    )


def _clustered_write(spark, sf_dir):
    warehouse = Warehouse(scratch_dir(spark))
    path = warehouse.mart("fct_seller_revenue")
    write_clustered(_spread_revenue(spark, sf_dir), path, "seller_id", spread=marts.SPREAD)
    return read_mart(spark, warehouse, "fct_seller_revenue")


def _spread_revenue(spark, sf_dir):
    items, orders = (_staged(spark, sf_dir, m) for m in ("stg_order_items", "stg_orders"))
    return marts.fct_seller_revenue(items, orders, DELIVERED_STANDIN, spread=True)


def _gated_build(spark, sf_dir):
    """The mart is written only when the checks on what it depends on have passed."""
    warehouse = Warehouse(scratch_dir(spark))
    models = ("stg_orders", "stg_order_items")
    enforce(check_report({m: _staged(spark, sf_dir, m) for m in models}, CHECKS_STANDIN))
    path = warehouse.mart("fct_seller_revenue")
    write_clustered(_spread_revenue(spark, sf_dir), path, "seller_id", spread=marts.SPREAD)
    return read_declared(spark, path, mart_schema("fct_seller_revenue"))


def _after_monthly_run(spark, sf_dir) -> Warehouse:
    """All months but the last that has orders in one backfill, then that one by itself."""
    warehouse, months = _ready_for_months(spark, sf_dir)
    last = landed_months(spark, warehouse, "orders")[-1]
    jobs.backfill(spark, warehouse, [m for m in months if m != last], **_STANDIN)
    jobs.run_month(spark, warehouse, last, **_STANDIN)
    return warehouse


def _after_backfill(spark, sf_dir) -> Warehouse:
    warehouse, months = _ready_for_months(spark, sf_dir)
    jobs.backfill(spark, warehouse, months, **_STANDIN)
    return warehouse


def _compared_marts(spark, sf_dir, warehouse: Warehouse) -> DataFrame:
    """The stored marts against the same marts computed in one go."""
    month = month_label(month_start(F.col("purchased_at")))
    expected = {
        "fct_orders": _orders_mart(spark, sf_dir).withColumn(PURCHASE_MONTH, month),
        "fct_delivery_by_state": _delivery(spark, sf_dir),
        "fct_seller_revenue": _seller_revenue(spark, sf_dir),
    }
    return _compared(expected, {m: read_mart(spark, warehouse, m) for m in expected})


def _monthly_job(spark, sf_dir):
    return _compared_marts(spark, sf_dir, _after_monthly_run(spark, sf_dir))


def _monthly_job_orders(spark, sf_dir):
    return read_mart(spark, _after_monthly_run(spark, sf_dir), "fct_orders")


def _backfill(spark, sf_dir):
    return _compared_marts(spark, sf_dir, _after_backfill(spark, sf_dir))


def _backfill_delivery(spark, sf_dir):
    return read_mart(spark, _after_backfill(spark, sf_dir), "fct_delivery_by_state")


_STANDIN = {"checks": CHECKS_STANDIN, "delivered": DELIVERED_STANDIN}


def _ready_for_months(spark, sf_dir) -> tuple[Warehouse, list[str]]:
    static = ("order_items", "order_payments", "customers")
    warehouse = _landed(spark, sf_dir, *MONTH_KEY, *static)
    jobs.load_static(spark, warehouse, static)
    months = {m for table in MONTH_KEY for m in landed_months(spark, warehouse, table)}
    return warehouse, sorted(months)


def _landed(spark, sf_dir, *tables: str) -> Warehouse:
    """A fresh warehouse whose landing area has the tables."""
    warehouse = Warehouse(scratch_dir(spark))
    for table in tables:
        _store(spark, sf_dir, table, warehouse.landing(table))
    return warehouse


def _loaded(spark, sf_dir, *tables: str) -> Warehouse:
    """A fresh warehouse whose raw tables are there."""
    warehouse = Warehouse(scratch_dir(spark))
    for table in tables:
        _store(spark, sf_dir, table, warehouse.raw(table))
    return warehouse


def _store(spark, sf_dir, table: str, path: str) -> None:
    df = raw_table(spark, sf_dir, table)
    if table in MONTH_KEY:
        write_months(with_month(df, table), path, PARTITION_MONTH)
    else:
        write_table(df, path)



def _as_text(df: DataFrame) -> DataFrame:
    """Every column as a CSV file has it, times in full."""
    return df.select(*[F.col(c).cast("string") for c in df.columns])


def _write_csv(df: DataFrame, path: str, codec: str = "none", file_rows: int = 0) -> None:
    """``file_rows`` bounds the rows of a file; 0 stands for no bound."""
    writer = df.write.option("header", True).option("escape", '"')
    writer.option("maxRecordsPerFile", file_rows).csv(path, compression=codec)


def _configured(query: _Query) -> _Query:
    return lambda spark, sf_dir: query(configure(spark), sf_dir)


QUERIES: dict[str, _Query] = {
    name: _configured(query)
    for name, query in {
        **{model: _staging_query(model) for model in STAGING},
        "int_orders_enriched": _enriched,
        "fct_delivery_by_state": _delivery,
        "fct_seller_revenue": _seller_revenue,
        "order_payments_sum": _payment_sums,
        "fct_orders_full": _orders_mart_stored,
        "fct_orders_incremental": _orders_mart_incremental,
        "fct_orders_high_water_mark": _orders_mart_high_water_mark,
        "kpi_monthly": _monthly,
        "kpi_delivery_by_state": _by_state,
        "kpi_top_sellers": _top_sellers,
        "kpi_top_sellers_ascending": _top_sellers_ascending,
        "kpi_summary": _summary,
        "high_water_mark": _mark,
        "high_water_mark_filter": _mark_filter,
        "dq_not_null": _checks(NOT_NULL),
        "dq_unique": _checks(UNIQUE),
        "dq_accepted_values": _checks(ACCEPTED),
        "dq_report": _checks(NOT_NULL, UNIQUE, ACCEPTED),
        "dq_month": _checks_of_a_month,
        "gated_build": _gated_build,
        "cast_columns": _cast_columns,
        "cast_order_items": _cast_order_items,
        "cast_missing_columns": _cast_missing_columns,
        "month_prefix": _month_prefix,
        "csv_roundtrip": _csv_roundtrip,
        "csv_roundtrip_items": _csv_roundtrip_items,
        "ingest": _ingest,
        "ingest_reviews": _ingest_reviews,
        "partition_by_month": _partition_by_month,
        "load_with_schema": _load_with_schema,
        "load_month": _load_month,
        "load_static": _load_static,
        "load_static_customers": _load_static_customers,
        "append_load": _append_load,
        "delete_month": _delete_month,
        "delete_month_stored": _delete_month_stored,
        "reload_month": _reload_month,
        "clustered_write": _clustered_write,
        "monthly_job": _monthly_job,
        "monthly_job_orders": _monthly_job_orders,
        "backfill": _backfill,
        "backfill_delivery": _backfill_delivery,
    }.items()
}
