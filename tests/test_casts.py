"""CSV reading and casting of text."""

import math
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradewind.functions.casts import NULL_TOKENS, cast_columns, cast_text
from tradewind.plans import jobs
from tradewind.sources.csv import read_table_csv
from tradewind.sources.warehouse import Warehouse, landed_months, read_declared
from tradewind.schemas import raw_schema


def read(spark, values, kind):
    """What the texts become as a column of the given type."""
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [row[0] for row in cast_text(df, {"v": kind}).collect()]


def test_text_to_numbers(spark):
    expected = {
        "3": (3, 3.0, "3"),
        "4.0": (4, 4.0, "4.0"),
        "bad": (None, None, "bad"),
        "nan": (None, None, None),
        "NA": (None, None, None),
        "": (None, None, None),
        None: (None, None, None),
        "3d": (None, None, "3d"),
        " 7 ": (7, 7.0, " 7 "),
        "+5": (5, 5.0, "+5"),
        "-2": (-2, -2.0, "-2"),
        "1e3": (1000, 1000.0, "1e3"),
        ".5e1": (5, 5.0, ".5e1"),
        "9007199254740993": (9007199254740993, 9007199254740992.0, "9007199254740993"),
        "01037": (1037, 1037.0, "01037"),
        "0x10": (None, None, "0x10"),
    }
    columns = [read(spark, expected, kind) for kind in ("bigint", "double", "string")]
    assert list(zip(*columns, strict=True)) == list(expected.values())


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "timestamp_ntz"])
def test_null_tokens_are_null_in_every_type(spark, kind):
    assert read(spark, NULL_TOKENS, kind) == [None] * len(NULL_TOKENS)


@pytest.mark.parametrize("value", ["5.5", "inf", "-Infinity", "1e30", "9" * 20])
def test_fraction_or_infinity_is_no_whole_number(spark, value):
    with pytest.raises(Exception, match="not a whole number"):
        read(spark, [value], "bigint")


def test_number_beyond_the_double_range_is_unreadable(spark):
    assert read(spark, ["1e400", "-1e400"], "bigint") == [None, None]


def test_infinity_is_a_real_number(spark):
    assert read(spark, ["inf", "-Infinity"], "double") == [float("inf"), float("-inf")]


@pytest.mark.parametrize("value", [
    "2017-01-01 10:00:0Z", "2017-01-01 10:00:0z", "-2017-1-01 10:00:00", "+2017-1-01 10:00:00",
    "2017-01-01 10:00+01", "2017-01-01 10:00UTC", "2017-01-01T10:00:0Z",
])
def test_nineteen_letters_of_another_form_are_no_time(spark, value):
    assert len(value) == 19
    assert read(spark, [value], "timestamp_ntz") == [None]


def test_text_to_timestamp(spark):
    expected = {
        "2017-01-02 03:04:05": datetime(2017, 1, 2, 3, 4, 5),
        # Half past midnight did not exist that day in the session's zone.
        "2017-10-15 00:30:00": datetime(2017, 10, 15, 0, 30),
        "2017-02-30 00:00:00": None,
        "2017-01-02": datetime(2017, 1, 2),
        "2017-01-02T03:04:05": datetime(2017, 1, 2, 3, 4, 5),
        "2017-01-02 03:04:05.5": datetime(2017, 1, 2, 3, 4, 5, 500000),
        "2017-01-02 03:04:05.250001": datetime(2017, 1, 2, 3, 4, 5, 250001),
        "2017-01-02T03:04:05.25": datetime(2017, 1, 2, 3, 4, 5, 250000),
        # The type holds microseconds.
        "2017-01-02 03:04:05.123456789": datetime(2017, 1, 2, 3, 4, 5, 123456),
        # Beyond the years that nanoseconds could count.
        "2262-04-11 23:47:17": datetime(2262, 4, 11, 23, 47, 17),
        "9999-12-31 00:00:00": datetime(9999, 12, 31),
        "0001-01-01 00:00:00": datetime(1, 1, 1),
        "2017": None,
        "2017-01": None,
        "2017-01-02 03:04:05.": None,
        "2017-01-02 03:04:05+01:00": None,
        "2017-01-02 03:04:05 UTC": None,
        "2017-01-02 3:04 UTC": None,
        "2017-01-02T": None,
        "3": None,
        "bad": None,
    }
    assert read(spark, expected, "timestamp_ntz") == list(expected.values())


NUMBERS = [
    "1", "1.", "1.0", ".5", "-.5", "+.5", "1e5", "1E5", "1e+5", "1e-5", "e5", "1e", "--1", "1 ",
    "\t1", "1\n", "1,000", "1_000", "0x1F", "1f", "1d", "1L", "NAN", "Nan", "Inf", "INF", "+inf",
    "-Infinity", " inf ", "1e400", "-1e400", "1e-400", "1e99", "1e100", "true", "1.2.3", "..",
    "  ", "-", "1 2", "00012", "9" * 25, "9" * 250, "9" * 400, "12abc", "5%", "na", "NONE",
]


def test_numbers_read_as_pandas_reads_them(spark):
    actual = read(spark, NUMBERS, "double")
    # One value at a time, beside a text, as in a column that is not numeric throughout.
    pairs = [pd.Series(["text", v], dtype=object) for v in NUMBERS]
    expected = [pd.to_numeric(pair, errors="coerce")[1] for pair in pairs]
    for value, ours, theirs in zip(NUMBERS, actual, expected, strict=True):
        # pandas is off by a last digit on very long numbers.
        same = ours is None if math.isnan(theirs) else math.isclose(ours, theirs, rel_tol=1e-15)
        assert same, (value, ours, theirs)


TIMES = [
    "2017-01-02 3:04:05", "2017-1-2 03:04:05", "2017-01-02 24:00:00", "2017-01-02  03:04:05",
    "2017-01-02\t03:04:05", "2017-01-02 03:04:05\n", " 2017-01-02 03:04:05", "2017-13-01 00:00:00",
    "2017-01-02 03:04", "2017/01/02 03:04:05", "2017-01-02 03:04:05Z", "17-01-02 03:04:05",
    "2016-02-29 00:00:00", "2017-02-29 00:00:00", "2262-04-11 23:47:16",
    "1677-09-21 00:12:44",
]


def test_times_read_as_pandas_reads_them(spark):
    actual = read(spark, TIMES, "timestamp_ntz")
    column = pd.Series(["2017-01-01 00:00:00", *TIMES], dtype=object)
    expected = pd.to_datetime(column, errors="coerce")[1:]
    assert actual == [None if pd.isna(e) else e.to_pydatetime() for e in expected]


def test_cast_columns_skips_what_is_missing_and_keeps_what_is_extra(spark):
    df = spark.createDataFrame([("12.5", "x", "o1")], "price string, extra string, order_id string")
    typed = cast_columns(df, "order_items")
    assert typed.dtypes == [("price", "double"), ("extra", "string"), ("order_id", "string")]
    assert cast_columns(df, "no_such_table") is df


def test_cast_columns_leaves_typed_columns(spark):
    df = spark.range(1).select(
        F.lit(2.0).alias("order_item_id"), F.lit(7).alias("order_id"), F.lit(1.5).alias("price")
    )
    assert tuple(cast_columns(df, "order_items").first()) == (2, "7", 1.5)


REVIEWS = (
    "﻿review_id,order_id,review_score,review_comment_title,review_comment_message,"
    "review_creation_date,review_answer_timestamp\n"
    'r1,o1,5,,"two\nlines, ""quoted""",2017-01-31 23:59:59,2017-02-01 00:00:00\n'
    "r2,o2,4.0,nan,plain,2017-02-01 00:00:00,\n"
    "r3,o3,bad,title,,not a time,2017-02-01 00:00:00\n"
)


def test_ingest_reviews_with_line_breaks(spark, tmp_path):
    (tmp_path / "reviews.csv").write_text(REVIEWS, encoding="utf-8")
    warehouse = Warehouse(str(tmp_path / "wh"))
    jobs.ingest(spark, {"order_reviews": str(tmp_path / "reviews.csv")}, warehouse)
    landed = read_declared(
        spark, warehouse.landing("order_reviews"), raw_schema("order_reviews")
    )
    rows = {r.review_id: r for r in landed.collect()}
    assert rows["r1"].review_comment_message == 'two\nlines, "quoted"'
    assert rows["r1"].partition_month == "2017-01"
    assert rows["r1"].review_comment_title is None
    assert (rows["r2"].review_score, rows["r2"].review_comment_title) == (4, None)
    assert rows["r2"].partition_month == "2017-02"
    assert (rows["r3"].review_score, rows["r3"].partition_month) == (None, None)
    assert landed_months(spark, warehouse, "order_reviews") == ["2017-01", "2017-02"]
    assert jobs.undated_rows(spark, warehouse, "order_reviews") == 1


CUSTOMERS = "customer_id,customer_city,customer_state\n"


@pytest.mark.parametrize(
    "row", ["c1,a,SP,RJ\n", "c1,a\n", 'c1,"two\nlines",SP\n'], ids=["long", "short", "broken"]
)
@pytest.mark.parametrize("columns", [["customer_id"], ["customer_id", "customer_city", "customer_state"]])
def test_a_row_of_the_wrong_width_fails(spark, tmp_path, row, columns):
    (tmp_path / "customers.csv").write_text(CUSTOMERS + "c0,b,SP\n" + row)
    df = read_table_csv(spark, str(tmp_path / "customers.csv"), "customers").select(columns)
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST"):
        df.collect()


def test_line_breaks_are_read_where_a_table_is_named(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(CUSTOMERS + 'c1,"two\nlines, ""x""",SP\n')
    df = read_table_csv(spark, str(tmp_path / "customers.csv"), "customers", ("customers",))
    assert [tuple(r) for r in df.collect()] == [("c1", 'two\nlines, "x"', "SP")]


def test_csv_columns_go_by_header_not_position(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text("customer_state,customer_zip_code_prefix,customer_id\nSP,01037,c1\n")
    typed = cast_columns(read_table_csv(spark, str(path), "customers"), "customers")
    assert typed.first().asDict() == {
        "customer_state": "SP", "customer_zip_code_prefix": "01037", "customer_id": "c1",
    }
