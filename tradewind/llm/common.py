"""What several operators share: stored intermediate tables and walking over Arrow batches."""

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind import session
from tradewind.session import scratch_dir

# The ASCII white space that separates words, [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"


# Rows of an Arrow batch. Whole texts are in them, and a batch is held several times over, by
# the executor and by the Python worker; results do not depend on it.
BATCH_ROWS = 2000


def configure(spark: SparkSession) -> SparkSession:
    """The settings of the library, and batches that suit texts.

    Runtime filters stay off. They are sized for joins to some of the orders; here they drop
    nothing, and a join by several columns would have one of 8 MB for each of them, which every
    task that computes one holds, and the driver sends with every task that uses them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    session.configure(spark)
    session.use_filters(spark, False)
    return spark


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage on storage that outlives executors, and gives Spark the true size, so
    that it broadcasts the table in a join only below its own threshold.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_pieces(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``most_bytes`` of text, one row at least."""
    offsets = _ends(batch.column(column))
    start = 0
    while start < batch.num_rows:
        base, end = (offsets[start - 1] if start else 0), start + 1
        while end < batch.num_rows and offsets[end] - base <= most_bytes:
            end += 1
        yield batch.slice(start, end - start)
        start = end


def _ends(texts: pa.Array) -> list[int]:
    ends, total = [], 0
    for size in pc.binary_length(texts.cast(pa.large_binary())).to_pylist():
        total += size or 0
        ends.append(total)
    return ends


def column_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver knows, as a local relation: reading them starts no task."""
    names = [field.split()[0] for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    table = pa.table(
        {
            name: pa.array(column, kinds[field.split()[1]])
            for name, column, field in zip(names, columns, schema.split(", "), strict=True)
        }
    )
    return spark.createDataFrame(table)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def join_grouped(left: DataFrame, grouped: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join to a table that was grouped by ``key``, which may be hot in ``left``.

    Joining on a hash of the key as well gives the grouped side a shuffle of its own. Without
    it Spark joins where the groups were made, and adaptive execution cannot cut a hot key.
    """
    hashed = F.xxhash64(*key).alias("_key_hash")
    joined = left.select("*", hashed).join(grouped.select("*", hashed), [*key, "_key_hash"], how)
    return joined.drop("_key_hash")


def text_hash(text: bytes) -> int:
    """32 bits that tell texts of the same id apart."""
    return xxhash.xxh32_intdigest(text) - (1 << 31)


def with_text_hash(docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` and ``body``, the hash of the text."""
    schema = T.StructType([*docs.schema, T.StructField("body", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array(map(text_hash, column_bytes(batch, text)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], [*batch.schema.names, "body"])

    return docs.mapInArrow(run, schema)


def row_key(doc_id: str) -> list[Column]:
    """An id as two columns without nulls, to join and group by."""
    kind = F.col(doc_id).cast("string")
    return [F.col(doc_id).isNotNull().alias("id_known"), F.coalesce(kind, F.lit("")).alias("id_value")]
