"""Words of UTF-8 bytes by tables of bytes, and item texts in sets of bounded size."""

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tradewind.llm.common import store

#: Bytes of a text that are cut into words at a time.
RUN_BYTES = 1 << 20


def byte_table(is_word: Callable[[int], bool]) -> bytes:
    """A table for ``bytes.translate``: A-Z lower-cased, bytes outside of words made a space."""
    lowered = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if is_word(b) else 32 for b in lowered)


def word_runs(text: bytes, table: bytes, most: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of those of about ``most`` bytes, never cut."""
    data = text.translate(table)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + most)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def bounded_sets(
    items: DataFrame, item_id: str, text: str, most_bytes: int
) -> Iterator[tuple[list[Row], bool]]:
    """Rows (item_id, text) in lists of about ``most_bytes`` of text, and whether one is the last.

    Null texts and repeated rows are left out, and rows of one id are in one list. Sizes are summed
    before anything is fetched; a list is larger only where the rows of one id are.
    """
    own = items.select(items[item_id].alias("item_id"), items[text].cast("string").alias("text"))
    own = own.where("text IS NOT NULL").distinct()
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")
    total = own.agg(size).first()["size"]
    if total <= most_bytes:
        yield own.collect(), True
        return
    own, count = store(own, "items"), math.ceil(2 * total / most_bytes)
    dealt = own.withColumn("part", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(count)))
    for part in range(count):
        yield dealt.where(F.col("part") == part).select("item_id", "text").collect(), part == count - 1
