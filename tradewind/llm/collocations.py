"""Collocations of two to four words by language, mined shard by shard and counted exactly.

Texts are read once and kept as word numbers, in blocks of one language, each of which belongs to
one of ``SHARDS`` shards. A phrase that occurs ``support`` times among the n words of its language
occurs ``support * n_s / n`` times or more in at least one shard of n_s words, so every shard is
mined at this lowered support and the phrases frequent in some shard hold all those sought. A
shard is not the work of one task: tasks count what their blocks add to it, and Spark adds these
up by phrase, so shards stay few, and their supports high, however large the input is.

Shards are mined a length at a time, over 96-bit hashes of phrases. A phrase is only counted if both
its parts of one word less are candidates. Tasks know these from a filter of ``2 ** BITS`` bits,
whatever their number: chance hits are counted in vain, none is missed. The counts of a candidate
in all shards, whether frequent there or not, add up to its exact count, and those below the
support go. Last, one block that holds a phrase gives its text, again known from a filter.

Defined cases: null texts have no words, a null language is ``und``. Repeated rows count each.
Case of A-Z alone is folded. A document's word numbers are held together, its words are not.
"""

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm.common import column_bytes, store, text_pieces

SUPPORT = 30
MOST_WORDS = 4
SHARDS = 4
BEST = 2000
COVERED = 80  # per cent of a phrase's occurrences that lie in one longer phrase
SCALE = 2_000_000
BITS = 26
NO_LANGUAGE = "und"
RUN_WORDS = 6 << 20  # words that a task holds at a time, but for longer texts
_RUN_BYTES = 1 << 20
_PIECE_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

# Pieces end at [.,;:!?\x0A-\x0D], words are [^\x20\x09]+. No text has the byte 255.
_END = b"\xff"
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(
    255 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


class _Numbers(dict):
    """Numbers of words in the order they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(text: bytes, numbers: _Numbers) -> np.ndarray:
    """The words of a text by number, with a 0 after each piece."""
    data = text.translate(_TABLE).replace(_END, b" \xff ") + b" \xff"
    parts, start = [], 0
    while start < len(data):
        end = data.find(b" ", start + _RUN_BYTES)
        end = len(data) if end < 0 else end
        words = data[start:end].split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        start = end
    return np.concatenate(parts)


_BLOCKS = "lang string, part int, block bigint, n bigint, words binary, texts binary"


def _blocks(shards: int, run_words: int):
    """Blocks of the texts of one language, of some ``run_words`` words for all together. Their
    shard goes by the task, whose number is ``block``; ``part`` is one of language and shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: dict[str, tuple[_Numbers, list]] = {}
        size = 0
        for batch in batches:
            for part in text_pieces(batch, "text", _PIECE_BYTES):
                texts = column_bytes(part, "text")
                for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                    numbers, arrays = held.setdefault(lang, (_Numbers(), []))
                    arrays.append(numbered(text, numbers))
                    size += len(arrays[-1])
                if size >= run_words:
                    yield from _held(held, task, task % shards)
                    held, size = {}, 0
        yield from _held(held, task, task % shards)

    return run


def _held(held: dict, task: int, shard: int) -> Iterator[pa.RecordBatch]:
    for lang, (numbers, arrays) in held.items():
        texts = np.concatenate(arrays)
        part = xxhash.xxh32_intdigest(f"{shard} {lang}") - (1 << 31)
        row = [
            (lang, pa.string()), (part, pa.int32()), (task, pa.int64()), (np.count_nonzero(texts), pa.int64()),
            (_END.join(list(numbers)[1:]), pa.binary()), (texts.tobytes(), pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in row], _names(_BLOCKS))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class _Block(NamedTuple):
    lang: str
    part: int
    block: int
    words: list[bytes]
    texts: np.ndarray


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            *values, words, texts = (batch.column(c)[row].as_py() for c in _Block._fields)
            yield _Block(*values, [_END, *words.split(_END)], np.frombuffer(texts, np.int32))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _phrases(lang: str, words: list[bytes], texts: np.ndarray, filters: list[np.ndarray]):
    """(length, starts, hashes, signs) of the phrases whose parts pass the filters, by length."""
    named = lang.encode() + _END
    digests = b"".join(xxhash.xxh3_128_digest(named + w) for w in words)
    own, other = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T.copy()
    hashes, signs, starts = own[texts], other[texts], np.flatnonzero(texts)
    yield 1, starts, hashes[starts], signs[starts]
    for length, bits in enumerate(filters, 2):
        passed = np.zeros(len(texts) + 1, bool)
        passed[starts] = _holds(bits, hashes[starts])
        starts = starts[passed[starts] & passed[starts + 1]]
        last = texts[starts + length - 1]
        hashes[starts] = _mix(hashes[starts] * _BASE + own[last])
        signs[starts] = _mix(signs[starts] * _BASE + other[last])
        yield length, starts, hashes[starts], signs[starts]


def _distinct(length: int, starts: np.ndarray, texts: np.ndarray, words: int):
    """Which of the phrases are the first of their kind in the block, and how many there are."""
    texts = texts.astype(np.int64)
    if length == 1:
        key = texts[starts]
    else:
        # Pairs of words by number: one more word or one more pair still fits 64 bits.
        pairs = np.zeros(len(texts), np.int64)
        at = np.unique(np.concatenate([starts, starts + length - 2]))
        pairs[at] = np.unique(texts[at] * words + texts[at + 1], return_inverse=True)[1]
        more = 0 if length == 2 else texts[starts + 2] if length == 3 else pairs[starts + 2]
        key = pairs[starts] * max(words, len(at)) + more
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return first, counts


_MINED = "phrase bigint, sign int, part int, block bigint, n bigint"


def _sign(signs: np.ndarray) -> np.ndarray:
    return (signs >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _mine(filters: list[np.ndarray]):
    """Counts of the phrases of one word more than the filters have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            *_, (length, starts, hashes, signs) = _phrases(row.lang, row.words, row.texts, filters)
            first, counts = _distinct(length, starts, row.texts, len(row.words))
            columns = [
                hashes[first].view(np.int64), _sign(signs[first]), np.full(len(first), row.part, np.int32),
                np.full(len(first), row.block), counts.astype(np.int64),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _names(_MINED))

    return run


_NAMED = "lang string, text string, phrase bigint, sign int"


def _name(filters: list[np.ndarray], named: np.ndarray):
    """The text of the phrases that a block is to name, by the filter of pairs of the two."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for length, starts, hashes, signs in _phrases(row.lang, row.words, row.texts, filters[:-1]):
                some = _holds(filters[length - 1], hashes) & _holds(named, hashes ^ np.uint64(_pair(row.block)))
                starts, hashes, signs = starts[some], hashes[some], signs[some]
                first, _ = _distinct(length, starts, row.texts, len(row.words))
                texts = [
                    b" ".join([row.words[w] for w in row.texts[at : at + length].tolist()])
                    for at in starts[first].tolist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row.lang] * len(first), pa.string()), pa.array(texts, pa.binary()).cast(pa.string()),
                        pa.array(hashes[first].view(np.int64)), pa.array(_sign(signs[first])),
                    ],
                    _names(_NAMED),
                )

    return run


def _pair(block: int) -> int:
    """What a phrase's hash is combined with to stand for the phrase and a block."""
    return (block << (64 - BITS)) & ((1 << 64) - 1)


def _filter(frequent: DataFrame) -> np.ndarray:
    """The filter over the hashes in ``phrase``: 2 ** BITS bits, made where the hashes are."""
    place = F.shiftrightunsigned("phrase", 64 - BITS)
    words = frequent.select(
        F.shiftrightunsigned(place, 6).cast("int").alias("place"),
        F.expr(f"shiftleft(1L, int(shiftrightunsigned(phrase, {64 - BITS}) & 63))").alias("bit"),
    ).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that made them: each length has one as large as any."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def frequent_phrases(
    docs: DataFrame,
    support: int = SUPPORT,
    most_words: int = MOST_WORDS,
    shards: int = SHARDS,
    run_words: int = RUN_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of at least ``support`` occurrences, and (lang, n),
    the number of all words. ``docs`` has text and lang."""
    blocks = store(docs.mapInArrow(_blocks(shards, run_words), _BLOCKS), "blocks")
    words = blocks.groupBy("lang", "part").agg(F.sum("n").alias("of_shard")).where("of_shard > 0")
    words = store(words, "totals")
    local = _local(words, support)
    filters: list[np.ndarray] = []
    found = None
    # A block is chosen for each phrase by the phrase, so that no block names the most.
    chosen = F.min(F.expr("block ^ (phrase & 16777215)")).alias("chosen")
    for length in range(1, most_words + 1):
        # Already added up by block, so they are not combined before the shuffle.
        mined = blocks.mapInArrow(_mine(filters), _MINED).repartition("phrase")
        counts = mined.groupBy("phrase", "sign", "part").agg(F.sum("n").alias("n"), chosen)
        everywhere = counts.join(local, "part").groupBy("phrase", "sign").agg(
            F.sum("n").alias("n"), F.min("chosen").alias("chosen"), F.bool_or(F.expr("n >= least")).alias("frequent")
        )
        kept = everywhere.where(F.col("frequent") & (F.col("n") >= support)).select(
            "phrase", "sign", F.lit(length).alias("words"), "n", F.expr("chosen ^ (phrase & 16777215)").alias("block")
        )
        kept = store(kept, f"phrases{length}")
        filters.append(_filter(kept.select("phrase")))
        found = kept if found is None else found.unionByName(kept)
    pairs = found.select(F.expr(f"phrase ^ shiftleft(block, {64 - BITS})").alias("phrase"))
    names = blocks.mapInArrow(_name(filters, _filter(pairs)), _NAMED).dropDuplicates(["phrase", "sign"])
    frequent = names.join(found, ["phrase", "sign"]).select("lang", F.col("text").alias("phrase"), "words", "n")
    return store(frequent, "phrases"), words.groupBy("lang").agg(F.sum("of_shard").alias("n"))


def _local(words: DataFrame, support: int) -> DataFrame:
    """The support ``least`` of each part, in proportion to its words, rounded up."""
    whole = words.withColumn("n", F.sum("of_shard").over(Window.partitionBy("lang")))
    least = f"CAST((CAST(of_shard AS DECIMAL(20,0)) * {support} + n - 1) div n AS BIGINT)"
    # Should two parts have one number, the lower support misses nothing of either.
    return store(whole.groupBy("part").agg(F.expr(f"min({least})").alias("least")), "supports")


def mine(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    support: int = SUPPORT,
    most_words: int = MOST_WORDS,
    shards: int = SHARDS,
    best: int = BEST,
    run_words: int = RUN_WORDS,
) -> DataFrame:
    """The ``best`` collocations of each language: lang, rank, phrase, a (occurrences), l and r
    (those of the two parts of its lowest-scoring cut), n (words of the language), score."""
    language = F.coalesce(docs[lang].cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    own = docs.select(docs[text].cast("string").alias("text"), language)
    with _freed_shuffles(docs.sparkSession):
        frequent, totals = frequent_phrases(own, support, most_words, shards, run_words)
    longest = frequent.where("words > 1").withColumn("parts", F.split("phrase", " "))
    scored = _scored(longest, frequent)

    # What lies in a longer phrase nearly as often is not reported.
    inner = longest.select(
        "lang", "n", F.explode(F.flatten(F.expr(
            "transform(sequence(1, words), i -> transform(sequence(1, words), size -> "
            "if(size > 1 AND size < words AND i + size - 1 <= words, array_join(slice(parts, i, size), ' '), null)))"
        ))).alias("phrase"),
    )
    longer = inner.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    wide = "decimal(20,0)"
    covered = F.col("most").cast(wide) * 100 >= F.col("a").cast(wide) * COVERED
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def _scored(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """Each candidate with the occurrences of the parts and the score of its lowest cut."""
    cuts = candidates.select(
        "lang", "phrase", F.col("n").alias("a"), "parts", F.explode(F.expr("sequence(1, words - 1)")).alias("k")
    ).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(parts, 1, k), ' ')").alias("head"),
        F.expr("array_join(slice(parts, k + 1, size(parts)), ' ')").alias("rest"),
    )
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = frequent.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr(
        f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + r)"
    )
    cut = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    lowest = cut.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
