"""Where tables lie, and reading them with their declared schema."""

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.schemas import MONTH_KEY, PARTITION_MONTH, mart_schema, raw_schema


# Fixed value: the directory of rows without a month.
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Warehouse:
    """Path layout below one root on storage that all executors share."""

    root: str

    def landing(self, table: str) -> str:
        """Typed files as ingested, not yet loaded."""
        return f"{self.root}/landing/{table}"

    def raw(self, table: str) -> str:
        return f"{self.root}/raw/{table}"

    def mart(self, name: str) -> str:
        return f"{self.root}/marts/{name}"

    def built_from(self, name: str) -> str:
        """What each month of a mart was built from."""
        return f"{self.root}/state/{name}"


def read_declared(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet with a declared schema: no inference pass, and a wrong file type is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND" and restore(spark, path):
            return spark.read.schema(schema).parquet(path)
        raise


def read_existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Like ``read_declared``, but None where nothing was stored yet."""
    try:
        return read_declared(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_raw(spark: SparkSession, warehouse: Warehouse, table: str) -> DataFrame:
    """A raw table. Before its first month has landed, a monthly table is empty."""
    path, schema = warehouse.raw(table), raw_schema(table)
    if table not in MONTH_KEY:
        return read_declared(spark, path, schema)
    stored = read_existing(spark, path, schema)
    return spark.createDataFrame([], schema) if stored is None else stored


def read_mart(spark: SparkSession, warehouse: Warehouse, name: str) -> DataFrame:
    return read_declared(spark, warehouse.mart(name), mart_schema(name))


def read_months(spark: SparkSession, path: str, table: str, months: list[str]) -> DataFrame:
    """Rows of some months; the other month directories are never opened."""
    df = read_declared(spark, path, raw_schema(table))
    return df.where(F.col(PARTITION_MONTH).isin(*months))


def month_files(spark: SparkSession, path: str, month_column: str) -> dict[str, frozenset[str]]:
    """Names of the data files by month, oldest month first, from the directory listing.

    Starts no Spark job and opens no file. A month without a data file is not there, nor is
    anything where nothing is stored; rows without a month are left out.
    """
    folder, files = _hadoop_path(spark, path), {}
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return {}
    for status in system.listStatus(folder):
        column, _, month = status.getPath().getName().partition("=")
        if status.isDirectory() and column == month_column and month != _NO_MONTH:
            names = [f.getPath().getName() for f in system.listStatus(status.getPath())]
            data = frozenset(n for n in names if not n.startswith(("_", ".")))
            if data:
                files[month] = data
    return dict(sorted(files.items()))


def drop_months(spark: SparkSession, path: str, month_column: str, months: Iterable[str]) -> None:
    """Remove month directories; those not stored are no matter."""
    for month in months:
        folder = _hadoop_path(spark, f"{path}/{month_column}={month}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored_months(
    spark: SparkSession, path: str, month_column: str, among: Iterable[str] | None = None
) -> list[str]:
    """Months that are stored, oldest first; none where nothing is stored."""
    found = month_files(spark, path, month_column)
    return [m for m in found if among is None or m in set(among)]


def landed_months(
    spark: SparkSession, warehouse: Warehouse, table: str, among: Iterable[str] | None = None
) -> list[str]:
    """Months waiting in the landing area."""
    return stored_months(spark, warehouse.landing(table), PARTITION_MONTH, among)


def replace_table(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace a table by what ``write`` stores at the path it is given, or leave it as it is.

    The new table is written beside the old one, which is in place until the new one is whole.
    The switch is two renames. A job that fails before it leaves the old table, one that is killed
    between the two leaves it under another name, from where the next read or write puts it back.
    One job at a time may replace a table.
    """
    restore(spark, path)
    table, new, old = (_hadoop_path(spark, p) for p in (path, _beside(path, "next"), _beside(path, "last")))
    system = table.getFileSystem(spark._jsc.hadoopConfiguration())
    # What a killed job has left, half a table or one replaced since.
    for left in (new, old):
        system.delete(left, True)
    try:
        write(new.toString())
        if system.exists(table):
            _rename(system, table, old)
        _rename(system, new, table)
    except BaseException:
        system.delete(new, True)
        restore(spark, path)
        raise
    system.delete(old, True)
    spark.catalog.refreshByPath(path)


@contextmanager
def stored_once(df: DataFrame, path: str) -> Iterator[DataFrame]:
    """``df`` as a table beside ``path``, to be read more than once; it is gone in the end."""
    spark, beside = df.sparkSession, _beside(path, "rows")
    folder = _hadoop_path(spark, beside)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(folder, True)
    try:
        df.write.parquet(beside)
        yield spark.read.schema(df.schema).parquet(beside)
    finally:
        system.delete(folder, True)


def restore(spark: SparkSession, path: str) -> bool:
    """Put a table back that a killed job has moved aside; whether there was one."""
    table, old = (_hadoop_path(spark, p) for p in (path, _beside(path, "last")))
    system = table.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(table) or not system.exists(old):
        return False
    _rename(system, old, table)
    return True


def _beside(path: str, kind: str) -> str:
    """A sibling that Spark takes for no data."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{kind}-{name}"


def _rename(system, source, target) -> None:
    if not system.rename(source, target):
        raise OSError(f"cannot rename {source.toString()} to {target.toString()}")


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)
