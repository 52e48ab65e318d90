"""Join forms the plans share."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_totals(left: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Left join to a table grouped by ``key``, safe where one key fills much of ``left``.

    The grouped side is already partitioned by ``key``, and Spark would join on that as it
    is; adaptive execution then cannot cut a hot partition of ``left``, as it only cuts
    partitions that come straight from a shuffle. Joining on one bit of the key's hash as well
    gives both sides a shuffle of their own, of hardly more bytes. It is one more shuffle of
    (key, total) pairs, so skip it by a plain join where ``key`` is known to be unique in ``left``.
    """
    bit, of_key = "_key_bit", F.xxhash64(key).bitwiseAND(1)
    return (
        left.withColumn(bit, of_key)
        .join(totals.withColumn(bit, of_key), [key, bit], "left")
        .drop(bit)
    )
