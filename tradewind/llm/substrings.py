"""Removal of byte strings that occur more than once, by prefix-free parsing.

A rolling hash triggers phrases: every string of ``LENGTH`` bytes belongs to the trigger where
the hash is least among the first ``REACH`` places of the string, so equal strings meet at equal
triggers wherever they stand. The strings of one trigger start side by side and form a phrase
with the text after it; all of them hold the ``CORE`` bytes from the trigger on.

The parse is a table of phrases, one for about ``REACH / 2`` bytes. A phrase whose core occurs
once cannot hold a repeated string and is dropped. The dictionary is the distinct phrases of the
others. All strings of a phrase that occurs twice are repeated. What is left is the ends of
repeated passages: different phrases of one core. Their suffixes are sorted, cut at ``LENGTH``
bytes, and a string that equals a neighbour in this order is repeated. The corpus order itself
is never built whole, since only neighbours with ``LENGTH`` common bytes count and these have a
core in common. Cores with very many different phrases are first taken apart by longer common
parts, so that no task sorts more than ``MOST_SORTED`` phrases at a time.

Defined cases: null text counts as empty; texts shorter than ``LENGTH`` keep all bytes. Rows are
judged by their bytes, so a repeated row loses all its strings, like any copy. Removal may cut
a character; the remaining bytes are exact, and ``kept_text`` leaves out what is no UTF-8.
"""

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import column_bytes, join_grouped, store, text_hash, text_pieces

LENGTH = 200  # bytes of a string that counts
REACH = 160  # places among which a string seeks its trigger
CORE = LENGTH - REACH + 1
GRAM = 16  # bytes under the rolling hash; REACH + GRAM - 1 <= LENGTH
MOST_SORTED = 30_000  # different phrases that one task sorts together, some 30 MB
_CHUNK = 1 << 19  # bytes parsed at a time
_PIECE_BYTES = 8 << 20
_PLACE_BITS = 20

# What becomes of a phrase: all its strings are repeated, it is to be compared, or both.
_FULL, _OPEN, _BOTH = 0, 1, 2

_PHRASES = "doc_id {id}, body int, start int, places int, trigger int, core bigint, phrase bigint"


class _RollingHash:
    """Hashes of all substrings from prefix sums, modulo 2 ** 64."""

    def __init__(self, seed: int):
        random = np.random.RandomState(seed)
        self._letters = random.randint(0, 2**63, 256, np.int64).astype(np.uint64) * 2 + 1
        base = int(random.randint(2**40, 2**62)) | 5
        with np.errstate(over="ignore"):
            steps = np.full(_CHUNK + 2 * LENGTH, base, np.uint64)
            steps[0] = 1
            self._powers = np.multiply.accumulate(steps)
            steps[1:] = pow(base, -1, 1 << 64)
            self._inverse = np.multiply.accumulate(steps)

    def sums(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._letters[data] * self._powers[: len(data)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start, end) -> np.ndarray:
        """``start`` and ``end`` are slices of equal length, or arrays of places."""
        return (sums[end] - sums[start]) * self._inverse[: len(sums)][start]


@cache
def _hashes() -> tuple[_RollingHash, _RollingHash]:
    return _RollingHash(1), _RollingHash(2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _least(keys: np.ndarray, reach: int) -> np.ndarray:
    """The least of each ``reach`` neighbours, from the running least of blocks, both ways."""
    n = len(keys)
    padded = np.full(-(-n // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - reach + 1], ahead[reach - 1 : n])


def parse(text: bytes) -> tuple[np.ndarray, ...]:
    """Phrases of a text: start, number of strings, trigger, hash of core, hash of phrase."""
    found = []
    whole = np.frombuffer(text, np.uint8)
    for offset in range(0, max(0, len(whole) - LENGTH + 1), _CHUNK):
        data = whole[offset : offset + _CHUNK + LENGTH - 1]
        first, second = _hashes()
        sums, other = first.sums(data), second.sums(data)
        strings = len(data) - LENGTH + 1
        places = strings + REACH - 1
        grams = first.of(sums, slice(0, places), slice(GRAM, GRAM + places))
        # The leftmost of equal hashes: the place is part of the key.
        keep = np.uint64(~((1 << _PLACE_BITS) - 1) & (1 << 64) - 1)
        keys = (_mixed(grams) & keep) | np.arange(places, dtype=np.uint64)
        least = _least(keys, REACH) & ~keep
        starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        counts = np.diff(np.r_[starts, strings])
        triggers = least[starts].astype(np.int64)
        core = first.of(sums, triggers, triggers + CORE)
        phrase = second.of(other, starts, starts + counts + LENGTH - 1)
        # Phrases of equal bytes but other places of the trigger are told apart.
        phrase = _mixed(phrase + (triggers - starts).astype(np.uint64))
        found.append((starts + offset, counts, triggers + offset, _mixed(core), phrase))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    joined = [np.concatenate(x) for x in zip(*found, strict=True)]
    return *joined[:3], joined[3].view(np.int64), joined[4].view(np.int64)


def _parse_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_pieces(batch, "text", _PIECE_BYTES):
            texts = column_bytes(part, "text")
            parsed = [parse(t) for t in texts]
            counts = np.array([len(p[0]) for p in parsed])
            rows = np.repeat(np.arange(len(texts)), counts)
            start, places, trigger, core, phrase = (
                np.concatenate(x) for x in zip(*parsed, strict=True)
            )
            bodies = np.array([text_hash(t) for t in texts], np.int64)[rows]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(rows)),
                    *(pa.array(x, pa.int32()) for x in (bodies, start, places, trigger)),
                    pa.array(core),
                    pa.array(phrase),
                ],
                ["doc_id", "body", "start", "places", "trigger", "core", "phrase"],
            )


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of ``docs``: doc_id, text as packed bytes, the spans (start, end) that repeated
    strings cover, in any order and overlapping, and the columns of ``keep`` in ``others``."""
    others = F.struct(F.lit(0).alias("none"), *[docs[c].alias(f"k{i}") for i, c in enumerate(keep)])
    rows = docs.select(
        docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), others.alias("others")
    )
    own = rows.select("doc_id", "text")
    id_kind = own.schema["doc_id"].dataType.simpleString()
    parsed = store(own.mapInArrow(_parse_batches, _PHRASES.format(id=id_kind)), "parse")
    # Pre-aggregated before the shuffle, so a core that every document holds is no hot spot.
    again = parsed.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    live = store(join_grouped(parsed, again, ["core"], "left_semi"), "live")
    dictionary = live.groupBy("core", "phrase").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "body", "start")).alias("first")
    )
    dictionary = store(dictionary, "dictionary")
    variants = dictionary.groupBy("core").agg(F.count("*").alias("variants"))
    several = join_grouped(dictionary, variants.where("variants > 1"), ["core"], "left")
    sorted_out = several.select(
        "core", "phrase", "first", "variants",
        F.when(F.col("n") == 1, _OPEN).when(F.col("variants").isNull(), _FULL).otherwise(_BOTH).alias("kind"),
    )
    is_first = F.col("first").eqNullSafe(F.struct("doc_id", "body", "start"))
    mark = F.struct(
        "start", "places", "trigger", "core", "variants",
        F.when((F.col("kind") == _BOTH) & ~is_first, _FULL).otherwise(F.col("kind")).alias("kind"),
    )
    marks = (
        live.join(sorted_out, ["core", "phrase"])
        .groupBy(F.col("doc_id").alias("of"), F.col("body").alias("of_body"))
        .agg(F.collect_set(mark).alias("marks"))
    )
    other_kind = rows.schema["others"].dataType.simpleString()
    packed = rows.mapInArrow(
        _pack, f"doc_id {id_kind}, others {other_kind}, body int, packed binary"
    )
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("body") == F.col("of_body"))
    marked = packed.join(marks, same, "left").select(
        "doc_id", "others", "body", "packed",
        F.expr(f"transform(filter(marks, m -> m.kind != {_OPEN}), "
               f"m -> struct(m.start AS start, m.start + m.places + {LENGTH - 1} AS end))").alias("spans"),
        F.expr(f"filter(marks, m -> m.kind != {_FULL})").alias("open"),
    )
    marked = store(marked, "marked")
    waiting = F.exists("open", lambda m: m.kind == _OPEN)
    compared = _compare(marked, id_kind).groupBy(
        F.col("doc_id").alias("of"), F.col("body").alias("of_body")
    ).agg(F.collect_set(F.struct("start", "end")).alias("more"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    done = marked.where(~F.coalesce(waiting, F.lit(False))).select(
        "doc_id", "others", "packed", F.coalesce("spans", empty).alias("spans")
    )
    late = marked.where(waiting).join(compared, same, "left").select(
        "doc_id", "others", "packed",
        F.concat(F.coalesce("spans", empty), F.coalesce("more", empty)).alias("spans"),
    )
    return done.unionByName(late)


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffles and the stored table; null stays null."""
    for batch in batches:
        for part in text_pieces(batch, "text", _PIECE_BYTES):
            texts = column_bytes(part, "text")
            null = part.column("text").is_null().to_pylist()
            packed = [None if x else pack(t) for t, x in zip(texts, null, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("others"),
                    pa.array([text_hash(t) for t in texts], pa.int32()),
                    pa.array(packed, pa.binary()),
                ],
                ["doc_id", "others", "body", "packed"],
            )


def pack(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def unpack(packed: bytes | None) -> bytes:
    if packed is None:
        return b""
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, "zstd", asbytes=True) if size else b""


def _compare(marked: DataFrame, id_kind: str) -> DataFrame:
    """Spans of the repeated strings of open phrases: doc_id, body, start, end.

    Phrases of a key are sorted together where there are few enough. Where there are more, the
    strings of each are parted by how far before the trigger they start, and the bytes that all
    strings of a part have become the key: what is not repeated leaves, and the rest meets in
    smaller groups, until a part is a single string and its key says all.
    """
    row = f"doc_id {id_kind}, body int, start int, kind int, before int, bytes binary"
    schema = f"high bigint, low bigint, least int, most int, {row}"
    phrases = marked.where(F.size("open") > 0).drop("others", "spans").mapInArrow(
        _cut_phrases, f"variants bigint, {schema}"
    )
    groups = store(phrases, "phrases").withColumnRenamed("variants", "n")
    key, span = ["high", "low"], f"doc_id {id_kind}, body int, start int, end int"
    found, level = None, 0
    while True:
        few = groups.where((F.col("n") <= MOST_SORTED) & (F.col("least") < F.col("most")))
        ready = few.repartition(*key).sortWithinPartitions(*key).mapInArrow(_sort_groups, span)
        single = groups.where((F.col("least") == F.col("most")) & (F.col("kind") == _OPEN))
        first = (F.col("start") + F.col("before") - F.col("least")).alias("start")
        ready = ready.unionByName(
            single.select("doc_id", "body", first, (first + LENGTH).alias("end"))
        )
        found = ready if found is None else found.unionByName(ready)
        large = groups.where((F.col("n") > MOST_SORTED) & (F.col("least") < F.col("most")))
        if large.limit(1).count() == 0:
            return found
        level += 1
        parts = store(large.drop("n").mapInArrow(_part, schema), f"parts{level}")
        again = parts.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        groups = store(join_grouped(parts, again, key), f"groups{level}")


_PART_NAMES = ["high", "low", "least", "most", "doc_id", "body", "start", "kind", "before", "bytes"]


def _part_kinds(like: pa.RecordBatch) -> list:
    own = like.schema.field("doc_id").type
    key = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return [*key, own, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _cut_phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open phrases with their core as key; their strings start up to REACH - 1 bytes before
    the trigger, which is ``before`` bytes behind the phrase's start."""
    for batch in batches:
        kinds = [pa.int64(), *_part_kinds(batch)]
        for at in range(0, batch.num_rows, 256):
            rows = []
            for row in batch.slice(at, 256).to_pylist():
                text = unpack(row["packed"])
                for m in row["open"]:
                    cut = text[m["start"] : m["start"] + m["places"] + LENGTH - 1]
                    rows.append(
                        (
                            m["variants"], m["core"], 0, 0, REACH - 1, row["doc_id"], row["body"],
                            m["start"], m["kind"], m["trigger"] - m["start"], cut,
                        )
                    )
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["variants", *_PART_NAMES])


def _part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each phrase twice, for the strings that start farther before the trigger and nearer."""
    for batch in batches:
        kinds = _part_kinds(batch)
        for at in range(0, batch.num_rows, 1000):
            rows = []
            for row in batch.slice(at, 1000).to_pylist():
                middle = (row["least"] + row["most"]) // 2
                before, cut = row["before"], row["bytes"]
                for least, most in ((row["least"], middle), (middle + 1, row["most"])):
                    # The strings of the phrase start ``nearest`` to ``before`` ahead.
                    nearest = before - (len(cut) - LENGTH)
                    if max(least, nearest) > min(most, before):
                        continue
                    # What all strings that start least to most bytes ahead have in common.
                    common = cut[before - least : before - most + LENGTH]
                    digest = xxhash.xxh3_128_intdigest(common + bytes([least]))
                    high, low = (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)
                    rows.append(
                        (
                            high, low, least, most, row["doc_id"], row["body"], row["start"],
                            row["kind"], before, cut,
                        )
                    )
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _PART_NAMES
            )


def _sort_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, at most ``MOST_SORTED`` of each."""
    held: list[dict] = []
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if held and any(held[0][c] != row[c] for c in ("high", "low")):
                out += _repeated_in(held)
                held = []
            held.append(row)
        yield _span_batch(out, batch)
    if held:
        yield _span_batch(_repeated_in(held), batch)


def _span_batch(spans: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    kinds = [like.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int32()]
    columns = list(zip(*spans, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        ["doc_id", "body", "start", "end"],
    )


def _repeated_in(phrases: list[dict]) -> list[tuple]:
    """Strings that start equally far ahead of the trigger, in order: equal neighbours are
    repeated. One distance at a time, so the phrases themselves are all that is held."""
    nearest = [p["before"] - (len(p["bytes"]) - LENGTH) for p in phrases]
    least = max(phrases[0]["least"], min(nearest))
    most = min(phrases[0]["most"], max(p["before"] for p in phrases))
    again: list[list[int]] = [[] for _ in phrases]
    for ahead in range(most, least - 1, -1):
        suffixes = sorted(
            (p["bytes"][p["before"] - ahead : p["before"] - ahead + LENGTH], k)
            for k, p in enumerate(phrases)
            if nearest[k] <= ahead <= p["before"]
        )
        last, marked = (b"", -1), False
        for suffix in suffixes:
            if suffix[0] == last[0]:
                if not marked:
                    again[last[1]].append(phrases[last[1]]["before"] - ahead)
                again[suffix[1]].append(phrases[suffix[1]]["before"] - ahead)
                marked = True
            else:
                marked = False
            last = suffix
    return [
        (p["doc_id"], p["body"], p["start"] + i, p["start"] + j + LENGTH)
        for p, places in zip(phrases, again, strict=True)
        if p["kind"] == _OPEN
        for i, j in _runs(places)
    ]


def _runs(places: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each run of places without a gap."""
    start = None
    for k, place in enumerate(places):
        if start is None:
            start = place
        if k + 1 == len(places) or places[k + 1] != place + 1:
            yield start, place
            start = None


def _kept(packed: bytes | None, spans: list[dict]) -> tuple[bytes, bytes, int]:
    """The text, what remains of it, and the number of removed runs."""
    text = unpack(packed)
    parts, reached, runs = [], 0, 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if not runs or start > reached:
            parts.append(text[reached:start])
            runs += 1
        reached = max(reached, end)
    parts.append(text[reached:])
    return text, b"".join(parts), runs


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes."""
    spans = repeated_spans(docs, doc_id, text)
    id_kind = spans.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(c) for c in ("doc_id", "packed", "spans"))
            for values in zip(*columns, strict=True):
                own, packed, spans = (v.as_py() for v in values)
                whole, kept, runs = _kept(packed, spans)
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((own, len(whole), len(whole) - len(kept), runs, digest))
            kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)],
                names,
            )

    return spans.drop("others").mapInArrow(
        run, f"doc_id {id_kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with what remains of each text and its length in n_chars.

    A null text stays null. Bytes of a character that was cut are left out.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    spans = repeated_spans(docs, keep=keep)
    id_kind, other_kind = (spans.schema[c].dataType.simpleString() for c in ("doc_id", "others"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for packed, found in zip(batch.column("packed"), batch.column("spans"), strict=True):
                if packed.is_valid:
                    texts.append(_kept(packed.as_py(), found.as_py())[1].decode(errors="ignore"))
                else:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("others"), pa.array(texts, pa.string())],
                ["doc_id", "others", "text"],
            )

    removed = spans.mapInArrow(run, f"doc_id {id_kind}, others {other_kind}, text string")
    columns = {c: F.col(f"others.k{i}") for i, c in enumerate(keep)}
    columns |= {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return removed.select([columns[c].alias(c) for c in docs.columns])
