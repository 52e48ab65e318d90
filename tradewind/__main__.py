"""Command line: ``spark-submit``-able entry to the jobs and the KPI queries."""

import argparse

from pyspark.sql import SparkSession

from tradewind.functions.dates import month_of
from tradewind.operators.quality import enforce
from tradewind.plans import jobs, kpi
from tradewind.schemas import MONTH_KEY, RAW_COLUMNS
from tradewind.session import configure
from tradewind.sources.warehouse import Warehouse, landed_months, read_mart


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tradewind")
    parser.add_argument("--root", required=True, help="warehouse folder on shared storage")
    commands = parser.add_subparsers(dest="command", required=True)
    command = commands.add_parser("ingest", help="CSV files to typed landing files")
    command.add_argument("csv_folder", help="folder with <table>.csv files or folders")
    commands.add_parser("load-static", help="replace the static raw tables and check them")
    command = commands.add_parser("run-month", help="reload one month and update the marts")
    command.add_argument("date", help="YYYY-MM or YYYY-MM-DD")
    command.add_argument("--mode", choices=(jobs.MONTHS, jobs.HIGH_WATER_MARK), default=jobs.MONTHS)
    commands.add_parser("backfill", help="run every month that has landed")
    commands.add_parser("kpi", help="print the KPI tables")
    args = parser.parse_args(argv)

    spark = configure(SparkSession.builder.appName(f"tradewind-{args.command}").getOrCreate())
    warehouse = Warehouse(args.root)
    if args.command == "ingest":
        jobs.ingest(spark, {t: f"{args.csv_folder}/{t}.csv" for t in RAW_COLUMNS}, warehouse)
        for table in MONTH_KEY:
            print(f"{table}: {jobs.undated_rows(spark, warehouse, table)} rows without a month")
    elif args.command == "load-static":
        jobs.load_static(spark, warehouse)
        enforce(jobs.check_static(spark, warehouse))
    elif args.command == "run-month":
        jobs.run_month(spark, warehouse, month_of(args.date), args.mode)
    elif args.command == "backfill":
        months = {m for t in MONTH_KEY for m in landed_months(spark, warehouse, t)}
        jobs.backfill(spark, warehouse, sorted(months))
    else:
        orders = read_mart(spark, warehouse, "fct_orders")
        delivery = read_mart(spark, warehouse, "fct_delivery_by_state")
        sellers = read_mart(spark, warehouse, "fct_seller_revenue")
        for table in (
            kpi.kpi_summary(orders, delivery),
            kpi.kpi_monthly(orders),
            kpi.kpi_delivery_by_state(delivery),
            kpi.kpi_top_sellers(sellers),
        ):
            print(table.toPandas().to_string(index=False), end="\n\n")


if __name__ == "__main__":
    main()
