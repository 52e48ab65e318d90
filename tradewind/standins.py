"""The driver's star-schema tables in the shapes of the nine raw tables.

An order counts as delivered with status ``F``; its delivery is its last ship date.
"""

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.quality import CHECKS, accepting
from tradewind.schemas import RAW_COLUMNS

DELIVERED_STANDIN = "F"
STATUSES_STANDIN = ("F", "O", "P")

# The 28 checks, with the stand-in statuses accepted so that the gate can pass.
CHECKS_STANDIN = accepting(CHECKS, "order_status", STATUSES_STANDIN)


def raw_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One raw table, columns and types as declared."""

    def read(name: str) -> DataFrame:
        path = f"{sf_dir}/{name}.parquet"
        return spark.read.schema(_file_schema(spark, path)).parquet(path)

    declared = RAW_COLUMNS[table].items()
    mapped = zip(declared, _COLUMNS[table], strict=True)
    return _SOURCES[table](read).selectExpr(
        *[f"CAST({value} AS {kind}) AS {name}" for (name, kind), value in mapped]
    )


@lru_cache
def _file_schema(spark: SparkSession, path: str):
    """Inferred once per file: the inference is a Spark job of its own."""
    return spark.read.parquet(path).schema


def _orders(read):
    last_shipped = (
        read("lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_shipdate").alias("last_shipped"))
    )
    # The key of the table: no order is hot, so the grouped side keeps its partitioning.
    return read("orders").join(last_shipped, "o_orderkey", "left")


_SOURCES = {
    "orders": _orders,
    "order_reviews": lambda read: read("events"),
    "order_items": lambda read: read("lineitem"),
    "order_payments": lambda read: read("lineitem"),
    "customers": lambda read: read("customer").join(
        read("nation"), F.expr("c_nationkey = n_nationkey"), "left"
    ),
    "sellers": lambda read: read("supplier").join(
        read("nation"), F.expr("s_nationkey = n_nationkey"), "left"
    ),
    "products": lambda read: read("part"),
    "geolocation": lambda read: read("nation").join(
        read("region"), F.expr("n_regionkey = r_regionkey"), "left"
    ),
    "category_translation": lambda read: read("part").select("p_type").distinct(),
}

# What fills the columns of each raw table, in their declared order.
_COLUMNS = {
    "orders": (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "NULL", "NULL",
        "last_shipped", "NULL",
    ),
    "order_reviews": ("event_id", "user_id", "value", "event_type", "props", "ts", "ts"),
    "order_items": (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_extendedprice", "l_tax",
    ),
    "order_payments": (
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice",
    ),
    "customers": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "n_name"),
    "sellers": ("s_suppkey", "s_nationkey", "s_name", "n_name"),
    "products": (
        "p_partkey", "p_type", "length(p_name)", "NULL", "p_size", "p_retailprice", "NULL",
        "NULL", "NULL",
    ),
    "geolocation": ("n_nationkey", "NULL", "NULL", "n_name", "r_name"),
    "category_translation": ("p_type", "upper(p_type)"),
}
