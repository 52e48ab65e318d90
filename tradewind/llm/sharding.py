"""Shards of near equal bytes from a k-d tree over document metadata.

A node that stands for several shards is split along its widest dimension, measured against the
whole table's width, at the weighted quantile that leaves each side its shards' part of the
bytes. The quantile of every node of a level is found at once: a histogram between bounds, then
finer ones within the bin that holds the quantile. Ties go by a hash, so a dimension on which
all documents agree can still be cut.

The law is ``bytes``. Equal texts form one unit at one place and stay together, unless they
outweigh a quarter of a shard; then they are dealt out as smaller units, repeated rows as well.
Languages and sources enter by the rank of the whole name among all that occur.

Defined cases: a null text has size 16 and the checksum of no bytes. Null languages, sources and
ids come before all others. Repeated rows are rows of their own, at the same place. An empty
table has no shards. The driver holds a few numbers per shard.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import small_table, store

ROW_BYTES = 16
TOGETHER_SHARE = 0.25  # of a shard's bytes: equal texts up to this stay together
PIECE_SHARE = 0.02  # heavier groups are dealt out as units of about this
EXACT_SHARE = 0.001  # of a shard's bytes: how near the quantile is sought
BINS = 1024
SLOT_ROWS = 50_000  # rows that one task numbers
DIMENSIONS = ("by_id", "by_size", "by_lang", "by_source")
_TIE = len(DIMENSIONS)


@dataclass
class _Node:
    shards: int
    first: int  # its first shard
    # The search: bounds of the value in which the cut lies, what lies below, its total.
    dim: int = 0
    low: int = 0
    high: int = 0
    below: int = 0
    total: int = 0
    value: int | None = None  # set once the cut is sought among the ties of one value
    # The cut: (value, tie) and above go right.
    cut: tuple[int, int] | None = None
    left: "_Node | None" = None
    right: "_Node | None" = None

    @property
    def goal(self) -> float:
        return self.total * (self.shards // 2) / self.shards

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)


def shard(
    docs: DataFrame,
    n_shards: int,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = store(
        docs.select(
            docs[doc_id].alias("doc_id"),
            (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("body"),
            F.coalesce(docs[doc_id].cast("bigint"), F.lit(-1)).alias("by_id"),
            docs[lang].cast("string").alias("lang"),
            docs[source].cast("string").alias("source"),
        ),
        "documents",
    )
    rows = store(_ranked(_ranked(rows, "lang"), "source"), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    rows, units = _units(rows, max(1, total // n_shards))
    tree = _grow(units, n_shards, total)
    key = ["text_crc32", "body", "size", "piece"]
    placed = rows.join(units.select(*key, _shard_of(tree).alias("shard")), key)
    return _number(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """The rows with a name's rank among the distinct ones for the name; null is -1.

    Ranges of names are numbered apart and start where the one before has ended, so no task
    holds all names, and a rank does not depend on the ranges.
    """
    names = rows.select(column).where(F.col(column).isNotNull()).distinct()
    ordered = names.repartitionByRange(column).sortWithinPartitions(column)
    numbered = store(ordered.withColumn("at", F.monotonically_increasing_id()), column)
    ranges = numbered.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    starts = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranks = numbered.withColumn("range", F.shiftright("at", 33)).join(starts, "range").select(
        column, (F.col("start") + F.expr(f"at & {(1 << 33) - 1}L")).alias("rank")
    )
    by = F.coalesce("rank", F.lit(-1)).alias(f"by_{column}")
    joined = rows.join(ranks, column, "left")
    return joined.select(*[c for c in rows.columns if c != column], by)


def _units(rows: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the piece of their group, and the units: a group of equal texts, or a piece."""
    key = ["text_crc32", "body", "size"]
    heavy = (
        rows.groupBy(*key).agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") > TOGETHER_SHARE * share)
        .select(*key, F.ceil(F.col("bytes") / max(1.0, PIECE_SHARE * share)).alias("pieces"))
    )
    heavy = store(heavy, "heavy")  # a few groups a shard at most
    names = rows.columns
    light = rows.join(heavy, key, "left_anti").withColumn("piece", F.lit(0).cast("bigint"))
    # Equal rows are counted, and their copies go to one piece after the other.
    counted = rows.join(heavy, key).groupBy(*names, "pieces").agg(F.count("*").alias("n"))
    dealt = counted.withColumn("j", F.explode(F.expr("sequence(0, least(n, pieces) - 1)")))
    piece = F.pmod(F.xxhash64("doc_id", F.lit("piece")) % F.col("pieces") + F.col("j"), F.col("pieces"))
    copies = F.expr("n div pieces + if(j < n % pieces, 1, 0)")
    dealt = dealt.select(*names, piece.alias("piece"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    rows = light.unionByName(dealt.drop("copy"))
    least = [F.min(c).alias(c) for c in ("by_id", "by_lang", "by_source")]
    units = rows.groupBy(*key, "piece").agg(F.sum("size").alias("weight"), *least)
    units = units.withColumn("by_size", F.col("size")).withColumn(
        "tie", F.shiftrightunsigned(F.xxhash64(*key, "piece"), 2)
    )
    return rows, store(units, "units")


def _grow(units: DataFrame, n_shards: int, total: int) -> _Node:
    root = _Node(n_shards, 0)
    widest = None
    level = [root] if total else []
    while level := [n for n in level if n.shards > 1]:
        node_of = _leaf_of(root, level).alias("node")
        cells = units.select(node_of, "weight", "tie", *DIMENSIONS).where("node IS NOT NULL")
        ends = [f(d) for d in DIMENSIONS for f in (F.min, F.max)]
        for k, weight, *bounds in cells.groupBy("node").agg(F.sum("weight"), *ends).collect():
            spans = [(bounds[2 * d], bounds[2 * d + 1]) for d in range(len(DIMENSIONS))]
            widest = widest or [max(1, high - low) for low, high in spans]
            node = level[k]
            node.total = weight
            node.dim = max(range(len(spans)), key=lambda d: ((spans[d][1] - spans[d][0]) / widest[d], -d))
            node.low, node.high = spans[node.dim]
        _find_cuts(units, root, level, EXACT_SHARE * total / n_shards)
        for node in level:
            node.left = _Node(node.shards // 2, node.first)
            node.right = _Node(node.shards - node.shards // 2, node.first + node.shards // 2)
        level = [child for node in level for child in (node.left, node.right)]
    return root


def _find_cuts(units: DataFrame, root: _Node, level: list[_Node], exact: float) -> None:
    """Narrow the bounds of all nodes of a level until each cut is known."""
    spark = units.sparkSession
    while searching := [n for n in level if n.cut is None and n.total]:
        bounds = [
            (k, _TIE if n.value is not None else n.dim, n.dim, n.value, n.low, n.high, n.width, n.goal - n.below)
            for k, n in enumerate(level)
            if n in searching
        ]
        search = small_table(
            spark, bounds, "node int, by int, dim int, same bigint, low bigint, high bigint, width bigint, goal double"
        )
        values = F.array(*DIMENSIONS, "tie")
        cells = (
            units.select(_leaf_of(root, level).alias("node"), "weight", values.alias("v"))
            .join(F.broadcast(search), "node")  # a row per node, fewer than shards
            .withColumn("at", F.col("v")[F.col("by")])
            .where("at BETWEEN low AND high AND (same IS NULL OR v[dim] = same)")
        )
        bins = cells.groupBy("node", "goal", F.expr("(at - low) DIV width").alias("bin")).agg(
            F.sum("weight").alias("weight"), F.min("at").alias("low"), F.max("at").alias("high")
        )
        upto = Window.partitionBy("node").orderBy("bin")  # BINS rows at most
        found = bins.withColumn("upto", F.sum("weight").over(upto)).where("upto >= goal")
        found = found.groupBy("node").agg(F.min(F.struct("bin", "upto", "weight", "low", "high")).alias("b"))
        for k, (_, upto_, weight, low, high) in found.select("node", "b").collect():
            node = level[k]
            before = upto_ - weight
            near_low = node.goal - node.below - before <= weight / 2
            if weight <= exact or (low == high and node.value is not None):
                at = low if near_low else high + 1
                node.cut = (node.value, at) if node.value is not None else (at, 0)
            elif low == high:
                node.below += before
                node.value, node.low, node.high = low, 0, 2**62 - 1
            else:
                node.low, node.high, node.below = low, high, node.below + before
        for node in searching:
            if node.cut is None and node.low > node.high:
                node.cut = (node.high, 0)


def _goes_right(node: _Node) -> Column:
    value, tie = node.cut
    at = F.col(DIMENSIONS[node.dim])
    return (at > value) | ((at == value) & (F.col("tie") >= tie))


def _leaf_of(node: _Node, level: list[_Node]) -> Column:
    """The number in ``level`` of the node a unit has reached; null if it is in none."""
    if node.left is not None:
        right, left = _leaf_of(node.right, level), _leaf_of(node.left, level)
        return F.when(_goes_right(node), right).otherwise(left) if node.cut else left
    return F.lit(next((k for k, n in enumerate(level) if n is node), None)).cast("int")


def _shard_of(node: _Node) -> Column:
    if node.left is not None and node.cut:
        return F.when(_goes_right(node), _shard_of(node.right)).otherwise(_shard_of(node.left))
    return F.lit(node.first)


def _number(placed: DataFrame) -> DataFrame:
    """Slots without gaps: rows are numbered in buckets, which start where the last one ended."""
    placed = store(placed, "placed")
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "piece"), F.lit(-(-most // SLOT_ROWS) or 1)).cast("int")
    placed = placed.withColumn("bucket", bucket)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").count()
    starts = starts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "body", "piece")
    numbered = placed.withColumn("n", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("n") - 1)
