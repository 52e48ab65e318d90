"""CSV files with a header line, every column as text."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.schemas import MULTILINE_TABLES

# How the files are quoted.
_FORMAT = {"quote": '"', "escape": '"', "mode": "FAILFAST", "columnPruning": "false"}


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Columns are named by the header, so a missing or moved column is noticed.

    A row of more or fewer fields than the header fails the job, also when a query needs only
    some of the columns: in a file that is split among tasks a short row cannot be told from a
    line break inside quotes. With ``multiline`` such breaks are read as text.
    """
    if multiline:
        return _read_multiline(spark, path)
    return _reader(spark).csv(path)


def _reader(spark: SparkSession):
    options = {**_FORMAT, "header": "true", "inferSchema": "false", "enforceSchema": "false"}
    return spark.read.options(**options)


def _read_multiline(spark: SparkSession, path: str) -> DataFrame:
    """Records that may hold line breaks inside quotes, from byte ranges read by many tasks.

    A line goes on in the next one if the quotes up to its end are odd in number. Each range counts
    its quotes, sums over the ranges before it say whether it begins inside quotes and with which
    record, and lines of one record are joined wherever they lie. Lines end at a line feed; a
    carriage return before it belongs to the end, but for breaks inside quotes, which stay as they
    are. Quotes are only allowed around whole fields. Empty lines between records are left out, but
    a file has to begin with its header.
    """
    columns = _reader(spark).option("multiLine", True).csv(path).columns
    lines = _placed(_lines(spark, path))
    starts, even = F.col("starts") == 1, F.col("quotes") % 2 == 0
    whole = lines.where(starts & even).select("file", "record", F.col("value").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("range", "line", "value")))
    broken = lines.where(~(starts & even)).groupBy("file", "record")
    text = F.array_join(F.transform(ordered, lambda x: x["value"]), "\n")
    records = whole.unionByName(broken.agg(text.alias("text")))
    return _fields(records, columns)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line, where its range begins in which file, its order there, and its quotes."""
    size = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"')))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("line"),
        size.alias("quotes"),
        "value",
    )


def _walked(lines: DataFrame) -> DataFrame:
    """Whether the quotes before a line in its range are odd, and how many lines up to it have
    them even."""
    own = Window.partitionBy("file", "range").orderBy("line")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    to_here = own.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    return (
        lines.withColumn("inside", inside)
        .withColumn("number", F.row_number().over(own))
        .withColumn("even", F.sum(1 - F.col("inside")).over(to_here))
    )


def _placed(lines: DataFrame) -> DataFrame:
    """Each line with the number of its record in the file, and whether the record starts there."""
    # The sums need no texts, so these are not shuffled for them.
    sums = _walked(lines.drop("value")).groupBy("file", "range").agg(
        (F.sum("quotes") % 2).alias("odd"), F.max("even").alias("evens"), F.count("*").alias("n")
    )
    ranges = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(value: str):
        return F.coalesce(F.sum(value).over(ranges), F.lit(0))

    opened = sums.withColumn("opened", so_far("odd") % 2)
    begun = opened.withColumn("begun", F.when(F.col("opened") == 0, F.col("evens")).otherwise(F.col("n") - F.col("evens")))
    first = begun.withColumn("first", so_far("begun")).select("file", "range", "opened", "first")
    placed = _walked(lines).join(first, ["file", "range"])
    up_to = F.when(F.col("opened") == 0, F.col("even")).otherwise(F.col("number") - F.col("even"))
    return placed.select(
        "file", "range", "line", "value", "quotes",
        (F.col("first") + up_to).alias("record"),
        F.when(F.col("inside") == F.col("opened"), 1).otherwise(0).alias("starts"),
    )


def _fields(records: DataFrame, columns: list[str]) -> DataFrame:
    """The fields of each record by the names of the header, which every file has to begin with."""
    text = F.when(F.col("text").endswith("\r"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    full = records.withColumn("text", text).where("text <> '' OR record = 1")
    names = [f"f{i}" for i in range(len(columns))]
    schema = ", ".join(f"{name} STRING" for name in names)
    row = F.from_csv("text", schema, {**_FORMAT, "multiLine": "true"})
    parsed = full.select("file", "record", row.alias("row"))
    same = [F.col(f"row.{name}").eqNullSafe(F.lit(column)) for name, column in zip(names, columns, strict=True)]
    message = F.concat(F.lit("another header than that of the first file: "), F.col("file"))
    header = F.when(F.forall(F.array(*same), lambda x: x), F.lit(False)).otherwise(F.raise_error(message).cast("boolean"))
    data = parsed.where(F.when(F.col("record") == 1, header).otherwise(F.lit(True)))
    return data.select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, columns, strict=True)])


def read_table_csv(
    spark: SparkSession, path: str, table: str, multiline_tables: tuple[str, ...] = MULTILINE_TABLES
) -> DataFrame:
    """A raw table's file. ``multiline_tables`` names those whose texts may hold line breaks."""
    return read_csv(spark, path, multiline=table in multiline_tables)
