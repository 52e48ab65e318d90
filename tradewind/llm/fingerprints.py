"""Quartile bucket digests of documents, and how alike two digests are.

A text's byte triplets, neighbours and two skipping patterns within four bytes, are hashed into
128 buckets. The digest is a length code and, for each bucket, the quartile of its count. Two
digests differ by a bounded score: the steps between quartiles, the widest counting double, and
the steps between length codes.

Each document is also compared with the next one in ascending order of id. Documents are dealt
into ranges of ids and text hashes, whose first keys occur, and the first document of a range is
also sent to the end of the range before, so no task sees more than its ranges and no order is
made globally. Rows of one id are cut by their hashes. Repeated rows, each the next of the one
before, travel as one row of a batch with their number.

Defined cases: null text counts as empty. Texts of less than three bytes have no triplet, all
buckets in the lowest quartile. Null ids come first. Ids that are no whole numbers are ordered as
text, by code points. Rows of the same id follow each other in order of a hash of their text, then
of the text. A single document is its own next.
"""

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import column_bytes, shuffle_partitions, store, text_pieces

BUCKETS = 128
MOST_DIFFERENT = 256  # the bound of the score
_LENGTH_STEP = 1.1  # a length code stands for lengths within ten per cent
_LENGTH_WEIGHT = 1
_WIDE_STEP = 6  # counts for a difference of three quartiles
_PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_OUT_BYTES = 4 << 20
_ROW_BYTES = 400  # about what a row of the result takes
KEYS_A_RANGE = 16  # drawn to bound the ranges, on average


def _table(name: str) -> np.ndarray:
    """256 bytes that depend on the name alone."""
    rows = (hashlib.sha256(f"{name} {i}".encode()).digest() for i in range(8))
    return np.frombuffer(b"".join(rows), np.uint8)


_TABLES = [[_table(f"pattern {p} place {k}") for k in range(3)] for p in range(len(_PATTERNS))]


def bucket_counts(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for places, tables in zip(_PATTERNS, _TABLES, strict=True):
        n = len(data) - places[-1]
        if n > 0:
            hashed = tables[0][data[:n]]
            for place, table in zip(places[1:], tables[1:], strict=True):
                hashed = hashed ^ table[data[place : place + n]]
            counts += np.bincount(hashed >> 1, minlength=BUCKETS)
    return counts


def fingerprint(text: bytes) -> str:
    """Two hex digits of length code, then 64 of quartiles, two bits a bucket."""
    counts = bucket_counts(text)
    ordered = np.sort(counts)
    marks = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    codes = (counts[:, None] > marks).sum(axis=1).reshape(-1, 4)
    packed = (codes << np.array([6, 4, 2, 0])).sum(axis=1).astype(np.uint8)
    return f"{_length_code(len(text)):02x}{packed.tobytes().hex()}"


def _length_code(size: int) -> int:
    return min(255, round(np.log1p(size) / np.log(_LENGTH_STEP)))


def difference(a: str, b: str) -> int:
    """0 for equal digests, ``MOST_DIFFERENT`` at most."""
    x, y = (
        (np.frombuffer(bytes.fromhex(d[2:]), np.uint8)[:, None] >> np.array([6, 4, 2, 0])) & 3
        for d in (a, b)
    )
    steps = np.abs(x - y)
    score = int(np.where(steps == 3, _WIDE_STEP, steps).sum())
    score += _LENGTH_WEIGHT * abs(int(a[:2], 16) - int(b[:2], 16))
    return min(score, MOST_DIFFERENT)


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / MOST_DIFFERENT


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the digest, that of the text with its last quarter taken from the next
    document, and the likeness of the first to the second and to the next document's."""
    whole = isinstance(docs.schema[doc_id].dataType, T.IntegralType)
    id_kind = T.LongType() if whole else T.StringType()
    own = docs.select(
        docs[doc_id].cast(id_kind).alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")
    ).select("doc_id", F.xxhash64("text").alias("body"), "text")
    ranges = 4 * shuffle_partitions(docs)
    keys = store(own.select("doc_id", "body", F.xxhash64("doc_id", "body").alias("draw")), "keys")
    known = F.col("doc_id").isNotNull()
    found = keys.select(
        F.min(F.struct(known.alias("known"), "doc_id", "body")).alias("least"),
        F.approx_count_distinct("draw").alias("n"),
    ).first()
    # Ranges are bounded by some of the keys that occur, drawn by hash: about KEYS_A_RANGE for each.
    every = max(1, found.n // (KEYS_A_RANGE * ranges))
    drawn = keys.where(F.pmod("draw", F.lit(every)) == 0).select("doc_id", "body").distinct().collect()
    drawn = sorted(_key(*r) for r in drawn)
    step = max(1, len(drawn) // ranges)
    first = _key(*found.least[1:]) if found.least else None
    kind = id_kind.simpleString()
    dealt = own.mapInArrow(
        _deal(drawn[step::step], first),
        f"range int, ahead boolean, doc_id {kind}, body bigint, n int, text string",
    )
    ordered = dealt.repartition(shuffle_partitions(docs), "range").sortWithinPartitions(
        "range", "ahead", F.asc_nulls_first("doc_id"), "body", "text"
    )
    schema = T.StructType([T.StructField("doc_id", id_kind), *_RESULT])
    return ordered.mapInArrow(_compare, schema)


_RESULT = (
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
)


def _key(doc_id: int | str | None, body: int) -> tuple:
    """Keys in the order of rows: null ids first, then ids, then hashes."""
    return (False, 0, body) if doc_id is None else (True, doc_id, body)


def _deal(cuts: list[tuple], first: tuple | None):
    """Put rows into ranges of keys; the first key of each also goes ahead to the one before,
    and the first of all to the end of the last. Equal rows of a batch become one."""
    names = ["range", "ahead", "doc_id", "body", "n", "text"]
    kinds = [pa.int32(), pa.bool_(), None, pa.int64(), pa.int32()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: dict[tuple, int] = {}
            places: dict[tuple, int] = {}
            rows = zip(
                batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(),
                column_bytes(batch, "text"), strict=True,
            )
            for i, row in enumerate(rows):
                places.setdefault(row, i)
                numbers[row] = numbers.get(row, 0) + 1
            out = []
            for (doc_id, body, _), i in places.items():
                key = _key(doc_id, body)
                place = bisect_right(cuts, key)
                out.append((place, False, doc_id, body, i))
                if place and cuts[place - 1] == key:
                    out.append((place - 1, True, doc_id, body, i))
                if key == first:
                    out.append((len(cuts), True, doc_id, body, i))
            count = dict(zip(places.values(), numbers.values(), strict=True))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            taken = columns.pop()
            columns.append([count[i] for i in taken])
            kinds[2] = batch.schema.field("doc_id").type
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            text = batch.column("text").take(pa.array(taken, pa.int32()))
            yield pa.RecordBatch.from_arrays([*arrays, text], names)

    return run


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in order; each is given out once the one after it is known."""
    out: list[tuple] = []
    size = 0
    held = None  # range, id, text, digest, or None after a row that only went ahead
    alone = None  # the result of the held row before a row like it, once it was needed
    for batch in batches:
        kinds = [batch.schema.field("doc_id").type, *_KINDS]
        for part in text_pieces(batch, "text", _OUT_BYTES):
            texts = [t.decode() for t in column_bytes(part, "text")]
            rows = zip(*(part.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "n")), texts, strict=True)
            for place, ahead, doc_id, n, text in rows:
                if ahead and held is None:
                    continue
                again = held is not None and held[1:3] == (doc_id, text)
                digest = held[3] if again else fingerprint(text.encode())
                if not again:
                    alone = None
                if held is not None and held[0] == place:
                    if again:
                        alone = alone or _result(held, text, digest)
                    out.append(alone or _result(held, text, digest))
                    size += _ROW_BYTES
                held = None if ahead else (place, doc_id, text, digest)
                if held and n > 1:
                    alone = alone or _result(held, text, digest)
                    out += [alone] * (n - 1)
                    size += _ROW_BYTES * (n - 1)
            if size > _OUT_BYTES:
                yield _batch(out, kinds)
                out, size = [], 0
    if out:
        yield _batch(out, kinds)


def _result(held: tuple, next_text: str, next_digest: str) -> tuple:
    _, doc_id, text, digest = held
    cut = len(text) // 4
    edited = (text[: len(text) - cut] + next_text[:cut]).encode()
    edited_digest = fingerprint(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited).hexdigest(), digest, edited_digest,
        likeness(digest, edited_digest), likeness(digest, next_digest),
    )


_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", *(f.name for f in _RESULT)])
