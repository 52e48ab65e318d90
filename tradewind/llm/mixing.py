"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes each document floor(r) times for sure and once
more with a chance of what remains. The flight phase moves the chances of three documents at a
time along the null space of two constraints, words and documents, so that both totals stay
exactly as expected until a chance is 0 or 1. It runs in blocks of documents; what a block
leaves open, two documents at most, flies on in fewer, joint blocks. The landing decides the
last two of a source by the outcome nearest to the two totals, and mends what a long document
still misses by changing one or two of a few settled documents that the blocks lend.

Chances and random numbers come from ids and texts, so reruns and retried tasks agree.

Defined cases: null and empty texts have no words and are not taken. A null source is a source,
ordered last. Repeated rows are documents of their own. The driver holds one row per source.
"""

import itertools
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import row_key, small_table, store, word_count

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
BLOCK_ROWS = 20_000
_NEARLY = 1e-9
SPARES = 64  # at most: settled documents that a block lends to the landing, which may change them
_ROW = "doc_id {id}, salt bigint, source int, size bigint, chance double, spare boolean"
_COLUMNS = ["doc_id", "salt", "source", "size", "chance", "spare"]


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of all sizes by weight; what a target has above its most is shared out again."""
    most = [MOST_COPIES * s for s in sizes]
    fixed: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = sum(sizes) - sum(most[i] for i in fixed)
        total = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / total for i in free}
        above = [i for i in free if share[i] > most[i]]
        if not above:
            return [float(most[i]) if i in fixed else share[i] for i in range(len(sizes))]
        fixed.update(above)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per row: doc_id, salt (a hash of the text), size, source_size, target, copies, taken."""
    rows = store(
        docs.select(
            docs[doc_id].alias("doc_id"),
            F.xxhash64(docs[text]).alias("salt"),
            docs[source].cast("string").alias("name"),
            word_count(docs[text]).alias("size"),
        ),
        "sizes",
    )
    totals = rows.groupBy("name").agg(
        F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n")
    )
    # Names in order of code points, which is the order of their UTF-8 bytes, null last.
    found = sorted(totals.collect(), key=lambda r: (r.name is None, (r.name or "").encode()))
    aims = targets([r.size for r in found], [weights[i % len(weights)] for i in range(len(found))])
    plan = [
        (i, r.name, r.size, aim, *_whole_and_chance(aim, r.size))
        for i, (r, aim) in enumerate(zip(found, aims, strict=True))
    ]
    sources = small_table(
        docs.sparkSession,
        plan,
        "source int, of string, source_size bigint, target double, whole bigint, chance double",
    )
    known = rows.join(sources, F.col("name").eqNullSafe(F.col("of"))).drop("name", "of")
    open_rows = {r[0]: found[r[0]].n for r in plan if r[5] > 0}
    drawn = known.where("chance > 0 AND size > 0")
    settled = known.where("NOT (chance > 0 AND size > 0)").select(
        "doc_id", "salt", "source", "size", F.lit(0).cast("bigint").alias("more")
    )
    decided = _draw(drawn, open_rows, block_rows)
    return (
        settled.unionByName(decided)
        .join(F.broadcast(sources.drop("chance", "of")), "source")  # a row per source
        .withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0))
        .select(
            "doc_id", "salt", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def _whole_and_chance(aim: float, size: int) -> tuple[int, float]:
    ratio = aim / size if size else 0.0
    whole = int(ratio + _NEARLY)
    chance = ratio - whole
    return whole, chance if _NEARLY < chance < 1 - _NEARLY else 0.0


def _draw(drawn: DataFrame, open_rows: dict[int, int], block_rows: int) -> DataFrame:
    """Every row with ``more``, 0 or 1: rounds of flight in blocks, the last one lands."""
    id_kind = drawn.schema["doc_id"].dataType.simpleString()
    schema = _ROW.format(id=id_kind)
    left = drawn.withColumn("spare", F.lit(False)).select(_COLUMNS)
    parts, turn = [], 0
    while open_rows:
        blocks = {s: -(-n // block_rows) for s, n in open_rows.items()}
        numbers = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
        block = F.pmod(F.xxhash64("doc_id", "salt", F.lit(turn)), numbers[F.col("source")])
        lands = F.lit(all(b <= 1 for b in blocks.values()))
        flown = store(
            left.withColumn("block", block.cast("int")).withColumn("lands", lands)
            .groupBy("source", "block").applyInPandas(_fly_block, schema),
            f"round{turn}",
        )
        is_open = F.col("spare") | (F.col("chance") > 0) & (F.col("chance") < 1)
        parts.append(flown.where(~is_open))
        left = flown.where(is_open)
        open_rows = {r[0]: r[1] for r in left.groupBy("source").count().collect()}
        turn += 1
    settled = drawn.where("false").withColumn("spare", F.lit(False)).select(_COLUMNS)
    for part in parts:
        settled = settled.unionByName(part)
    return settled.select(
        "doc_id", "salt", "source", "size", F.col("chance").cast("bigint").alias("more")
    )


def _fly_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["salt", "doc_id"], kind="stable", ignore_index=True)
    source, block, lands = (rows[c].iloc[0] for c in ("source", "block", "lands"))
    draw = random.Random(f"{source} {block} {len(rows)} {rows['salt'].iloc[0]}")
    sizes, chances = rows["size"].tolist(), rows["chance"].tolist()
    left = fly(sizes, chances, draw)
    # A quarter at most, so that every round has fewer rows than the one before.
    lent = [i for i in range(len(sizes)) if i not in left][: min(SPARES, len(sizes) // 4)]
    if lands:
        land(sizes, chances, left, lent, draw)
    rows["chance"] = chances
    rows["spare"] = False
    if not lands:
        rows.loc[lent, "spare"] = True
    return rows[_COLUMNS]


def fly(sizes: list[int], chances: list[float], draw: random.Random) -> list[int]:
    """Change ``chances`` until two at most are neither 0 nor 1; these are returned."""
    held: list[int] = []
    for i in range(len(sizes)):
        if not 0 < chances[i] < 1:
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # Orthogonal to the sizes and to ones: neither total changes.
        move = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(move):
            move = (1, -1, 0)
        up = min(_room(chances[i], m) for i, m in zip(held, move, strict=True) if m)
        down = min(_room(chances[i], -m) for i, m in zip(held, move, strict=True) if m)
        step = up if draw.random() * (up + down) < down else -down
        for i, m in zip(held, move, strict=True):
            chances[i] = _settled(chances[i] + step * m)
        held = [i for i in held if 0 < chances[i] < 1]
    return held


def _room(chance: float, move: int) -> float:
    return ((1 - chance) if move > 0 else -chance) / move


def _settled(chance: float) -> float:
    return 0.0 if chance < _NEARLY else 1.0 if chance > 1 - _NEARLY else chance


def land(
    sizes: list[int], chances: list[float], left: list[int], lent: list[int], draw: random.Random
) -> None:
    """Decide what the flight left: the outcome nearest to the words, then to the documents.

    A long document can miss by many words; then one or two lent documents change sides.
    """
    outcomes = []
    for bits in range(1 << len(left)):
        taken = [bits >> k & 1 for k in range(len(left))]
        words = sum(sizes[i] * (t - chances[i]) for i, t in zip(left, taken, strict=True))
        number = sum(t - chances[i] for i, t in zip(left, taken, strict=True))
        outcomes.append((abs(words), abs(number), draw.random(), taken, words))
    _, _, _, taken, words = min(outcomes)
    for i, t in zip(left, taken, strict=True):
        chances[i] = float(t)
    gain = {i: sizes[i] if chances[i] == 0 else -sizes[i] for i in lent}
    changes = [(), *((i,) for i in lent), *itertools.combinations(lent, 2)]
    for i in min(changes, key=lambda c: (abs(words + sum(gain[i] for i in c)), len(c))):
        chances[i] = 1 - chances[i]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and others), each as often as it is taken.

    Repeated rows share the decisions on their id and text out among them. They are counted,
    rows and decisions alike, and only the counts are compared.
    """
    names = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    id_, text = names["doc_id"], names["text"]
    others = [k for k in names.values() if k != text]
    # As JSON, which tells which column is null.
    row = F.xxhash64(F.to_json(F.struct(*others))).alias("row")
    own = docs.toDF(*names.values()).select("*", *row_key(id_), F.xxhash64(text).alias("salt"), row)
    key = ["id_known", "id_value", "salt"]

    decisions = mix(docs).groupBy(*row_key("doc_id"), "salt", "copies").agg(F.count("*").alias("m"))
    decided = F.sort_array(F.collect_list(F.struct("copies", "m"))).alias("decided")  # four at most
    decided = decisions.groupBy(*key).agg(decided, F.max("copies").alias("most")).where("most > 0")
    counted = own.groupBy(*key, "row").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    # Equal rows stand one after the other, and so do equal decisions: how many of them meet.
    times = F.expr(
        "aggregate(decided, struct(0L AS at, 0L AS times), (s, d) -> struct(s.at + d.m AS at, s.times + d.copies"
        " * greatest(0L, least(first + n, s.at + d.m) - greatest(first, s.at)) AS times), s -> s.times)"
    )
    taken = counted.withColumn("first", first).join(decided, key).select(*key, "row", times.alias("times"))
    rows = own.groupBy(*key, "row").agg(*[F.first(k).alias(k) for k in names.values()])
    again = F.explode(F.expr("sequence(1L, times)"))
    chosen = rows.join(taken.where("times > 0"), [*key, "row"]).select(*names.values(), again.alias("again"))
    return chosen.select([F.col(k).alias(c) for c, k in names.items()])
