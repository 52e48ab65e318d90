"""Jaccard self-join of word shingles by chosen paths.

Documents of the same shingles form a class, handled once. A class's set is embedded by
``PLACES`` minhash values. Each run starts with all classes in one node. A node draws one or two
places, 1 / threshold on average, and a class goes on to the child of its value at each drawn
place. Similar sets keep an even expectation to share a child, others part. After ``DEPTH``
levels nodes of one class are dropped and the rest, of any size, is compared all against all.
Runs are repeated until a pair at the threshold is met with the target recall; all runs share
one embedding, so this is the mean over the number of places at which the pair is equal.

A pair met in several nodes counts in the least of them only, which both sides know from their
own lists. A node's pairs are never written: a task gives each class's number of links and one
edge of a spanning forest. Candidates are first sifted by their minhash values; the sets of what
remains are fetched once per node and compared exactly. A larger node than ``MOST_AT_ONCE`` is
compared block against block, so that no task holds more than two blocks.

Defined cases: words are runs of other than ASCII white space, case counts. A text of one to
four words has one shingle, all its words. Null texts and texts without words are similar to
nothing, each a class of its own. Copies and repeated rows are links of each other. Null ids
are never class ids unless all rows of a class have none.
"""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import (
    WORD,
    column_bytes,
    join_grouped,
    row_key,
    store,
    text_hash,
    text_pieces,
    with_text_hash,
)
from tradewind.llm.graphs import components
from tradewind.llm.substrings import pack, unpack

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999  # of pairs exactly at the threshold
PLACES = 128
DEPTH = 3
MOST_AT_ONCE = 1000  # classes compared in one task at a time, or half as many in each block
_SIFT_DEVIATIONS = 5  # of the minhash estimate: what is farther below the threshold is left
_PIECE_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the shingles of a text, each once, in order."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words))], np.uint64)
    n = len(words) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total = _mix(total * np.uint64(_BASE) + hashes[k : k + n])
    return np.unique(total)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def embed(shingle_set: np.ndarray) -> np.ndarray:
    """Low bits of the least hash of the set under ``PLACES`` hash functions."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle_set), 4096):
        part = shingle_set[at : at + 4096]
        least = np.minimum(least, (part[None, :] * _SEEDS[:, None]).min(axis=1))
    return (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def survival(depth: int, similarity: float, threshold: float = THRESHOLD) -> float:
    """Chance that a run leads a pair, equal at this share of the places, into a common node
    ``depth`` levels down."""
    second = 1 / threshold - 1  # a node draws a second place this often
    met = 1.0
    for _ in range(depth):
        one = similarity * met
        met = (1 - second) * one + second * (1 - (1 - one) ** 2)
    return met


def missed(runs: int, similarity: float, threshold: float = THRESHOLD) -> float:
    """Chance that no run meets a pair. Runs are independent only for a given embedding."""
    return math.fsum(
        math.comb(PLACES, equal) * similarity**equal * (1 - similarity) ** (PLACES - equal)
        * (1 - survival(DEPTH, equal / PLACES, threshold)) ** runs
        for equal in range(PLACES + 1)
    )


def runs_needed(recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold was met with this chance."""
    if not 0 <= recall < 1:
        raise ValueError(f"no number of runs has a recall of {recall}")
    runs = 1
    while missed(runs, threshold, threshold) > 1 - recall:
        runs += 1
    return runs


def _children(rows: np.ndarray, nodes: np.ndarray, values: np.ndarray, threshold: float):
    """One level down: row numbers and nodes. What is drawn depends on the node alone."""
    drawn = _mix(nodes ^ np.uint64(0x5851F42D4C957F2D))
    first = (drawn % np.uint64(PLACES)).astype(np.int64)
    step = 1 + ((drawn >> np.uint64(20)) % np.uint64(PLACES - 1)).astype(np.int64)
    twice = (drawn >> np.uint64(40)).astype(np.float64) / 2**24 < 1 / threshold - 1
    rows_out, nodes_out = [], []
    for place, some in ((first, slice(None)), ((first + step) % PLACES, twice)):
        r, p, n = rows[some], place[some], nodes[some]
        rows_out.append(r)
        key = (p.astype(np.uint64) << np.uint64(16)) | values[r, p].astype(np.uint64)
        nodes_out.append(_mix(n * np.uint64(_BASE) + _mix(key + np.uint64(1))))
    return np.concatenate(rows_out), np.concatenate(nodes_out)


def _values(batch: pa.RecordBatch) -> np.ndarray:
    flat = b"".join(batch.column("sketch").to_pylist())
    return np.frombuffer(flat, np.uint16).reshape(-1, PLACES)


def _members(batch: pa.RecordBatch, rows: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes.view(np.int64)), batch.column("hi").take(at), batch.column("lo").take(at)],
        ["node", "hi", "lo"],
    )


def _descend(runs: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                values = _values(part)
                rows = np.tile(np.arange(part.num_rows), runs)
                nodes = _mix(np.repeat(np.arange(1, runs + 1, dtype=np.uint64), part.num_rows))
                for _ in range(DEPTH):
                    rows, nodes = _children(rows, nodes, values, threshold)
                yield _members(part, rows, nodes)

    return run


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_pieces(batch, "text", _PIECE_BYTES):
            sets = [shingles(t) for t in column_bytes(part, "text")]
            hi, lo = zip(*(_class_of(s) for s in sets), strict=True)
            sketches = [embed(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(map(text_hash, column_bytes(part, "text")), pa.int32()),
                    pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                    pa.array(map(len, sets), pa.int32()), pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "body", "hi", "lo", "n", "sketch"],
            )


def _class_of(shingle_set: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(shingle_set.tobytes())
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


_KEY = ["hi", "lo"]


def near_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    most_at_once: int = MOST_AT_ONCE,
) -> DataFrame:
    """Per row: doc_id, class_id (the least id of its group of linked documents), n_links (the
    number of documents at or above the threshold), n_shingles, a hash ``body`` of the text, and
    whether the row is its group's representative (repeated rows are so together)."""
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    id_kind = own.schema["doc_id"].dataType.simpleString()
    sketched = store(
        own.mapInArrow(_sketch, f"doc_id {id_kind}, body int, hi bigint, lo bigint, n int, sketch binary"),
        "sketches",
    )
    classes = sketched.where("n > 0").groupBy(*_KEY).agg(
        F.count("*").alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body")).alias("rep"),
        F.first("n").alias("n"), F.first("sketch").alias("sketch"),
    )
    classes = store(classes, "classes")
    leaves = _leaves(classes, runs_needed(recall, threshold), threshold)
    lists = leaves.groupBy(*_KEY).agg(F.collect_set("node").alias("nodes"))
    payload = store(classes.join(lists, _KEY), "payload")
    groups = _blocks(leaves, most_at_once)

    # What is left after the sifting carries its payload along.
    rep = [F.col("rep.doc_id").alias("rep_id"), F.col("rep.body").alias("rep_body")]
    members = groups.join(payload.select("*", *rep).drop("rep", "n"), _KEY)
    sifted = store(_by_group(members, _sift(threshold), members.schema), "candidates")
    sets = _sets(own, sifted.select(*_KEY, "rep_id", "rep_body").distinct(), id_kind)
    linked = _by_group(sifted.join(sets, _KEY), _verify(threshold), "hi bigint, lo bigint, links bigint, root_hi bigint, root_lo bigint")
    linked = store(linked, "links")

    name = lambda hi, lo: F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0"))
    roots = components(linked.select(name("hi", "lo").alias("u"), name("root_hi", "root_lo").alias("v")))
    links = linked.groupBy(*_KEY).agg(F.sum("links").alias("links"))
    grouped = (
        classes.select(*_KEY, "copies", "rep", name("hi", "lo").alias("v"))
        .join(links, _KEY, "left").join(roots, "v", "left")
        .select(*_KEY, "copies", "rep", "links", F.coalesce("root", "v").alias("root"))
    )
    least = grouped.groupBy("root").agg(F.min("rep").alias("least"))
    found = store(
        grouped.join(least, "root").select(
            *_KEY, "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "found",
    )
    return sketched.drop("sketch").join(found, _KEY, "left").select(
        "doc_id",
        F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("n").alias("n_shingles"),
        "body",
        (
            (F.col("n") == 0)
            | F.struct("least.doc_id", "least.body").eqNullSafe(F.struct("doc_id", "body"))
        ).alias("is_representative"),
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) that represent their group, each once."""
    found = near_copies(docs).where("is_representative AND n_shingles > 0")
    wanted = found.select(*row_key("doc_id"), "body").distinct()
    names = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    id_, text = names["doc_id"], names["text"]
    own = with_text_hash(docs.toDF(*names.values()), text).select("*", *row_key(id_))
    key = ["id_known", "id_value", "body"]
    chosen = own.join(wanted, key)
    # Repeated rows are at the same place after the join.
    first = Window.partitionBy(*key).orderBy(*[k for k in names.values() if k != text])
    chosen = chosen.withColumn("place", F.row_number().over(first)).where("place = 1")
    wordless = own.where(F.coalesce(~F.col(text).rlike(WORD), F.lit(True)))
    return chosen.select(*names.values()).unionByName(wordless.select(*names.values())).select(
        [F.col(k).alias(c) for c, k in names.items()]
    )


def _leaves(classes: DataFrame, runs: int, threshold: float) -> DataFrame:
    """node, hi, lo and the node's size, for nodes of two classes or more."""
    schema = "node bigint, hi bigint, lo bigint"
    members = store(
        classes.select(*_KEY, "sketch").mapInArrow(_descend(runs, threshold), schema), "members"
    )
    sizes = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return store(join_grouped(members, sizes, ["node"]), "leaves")


def _blocks(leaves: DataFrame, most: int) -> DataFrame:
    """Groups (node, a, b): a whole node, or two blocks of a large one to be held together."""
    blocks = F.when(F.col("size") > most, F.ceil(F.col("size") / (most // 2))).otherwise(1).cast("int")
    block = F.pmod(F.xxhash64("hi", "lo"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        leaves.withColumn("blocks", blocks).withColumn("block", block).withColumn("other", other)
        .select(
            "node", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
            "block", *_KEY,
        )
    )


def _by_group(rows: DataFrame, run, schema) -> DataFrame:
    key = ["node", "a", "b"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of the same (node, a, b) from sorted batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("node", "a", "b")]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for i, j in zip(starts, starts[1:], strict=False):
            own = tuple(c[i] for c in columns)
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(group: pa.Table, threshold: float) -> np.ndarray:
    """Which rows are likely similar and have this group's node as their first in common."""
    m = group.num_rows
    flat = b"".join(group.column("sketch").to_pylist())
    values = np.frombuffer(flat, np.uint16).reshape(m, PLACES)
    equal = np.zeros((m, m), np.int16)
    for column in values.T if m > 24 else ():
        equal += column[:, None] == column[None, :]
    if m <= 24:
        equal = (values[:, None, :] == values[None, :, :]).sum(axis=2)
    deviation = math.sqrt(threshold * (1 - threshold) / PLACES)
    likely = np.triu(equal >= (threshold - _SIFT_DEVIATIONS * deviation) * PLACES, 1)
    block = group.column("block").to_numpy()
    if group.column("a")[0] != group.column("b")[0]:
        likely &= block[:, None] != block[None, :]
    if not likely.any():
        return likely
    node = group.column("node")[0].as_py()
    earlier = [[x for x in nodes if x < node] for nodes in group.column("nodes").to_pylist()]
    return likely & (_common(earlier) == 0)


def _common(lists: list) -> np.ndarray:
    """The number of elements that each two lists of distinct elements have in common."""
    m = len(lists)
    rows = np.repeat(np.arange(m), [len(x) for x in lists])
    total = np.zeros((m, m), np.float32)
    if not len(rows):
        return total
    _, column, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    if not shared.any():
        return total
    rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    width = 2048
    for first in range(0, int(column[-1]) + 1, width):
        i, j = np.searchsorted(column, (first, first + width))
        table = np.zeros((m, width), np.float32)
        table[rows[i:j], column[i:j] - first] = 1
        total += table @ table.T
    return total


def _sift(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            pairs = _pairs(group, threshold)
            some = pairs.any(axis=0) | pairs.any(axis=1)
            if some.any():
                yield from group.filter(pa.array(some)).combine_chunks().to_batches()

    return run


def _sets(own: DataFrame, wanted: DataFrame, id_kind: str) -> DataFrame:
    """The shingle sets of the wanted classes, from the text of one document of each."""
    chosen = _texts(own, wanted, id_kind)
    sets = chosen.select("of_hi", "of_lo", "packed").mapInArrow(
        _set_of, "hi bigint, lo bigint, shingles binary"
    )
    # The same row may come again.
    return store(sets.dropDuplicates(_KEY), "sets")


def _texts(own: DataFrame, wanted: DataFrame, id_kind: str) -> DataFrame:
    """The texts of the wanted ids and text hashes: rows of one id may hold many others."""
    packed = own.mapInArrow(_pack, f"doc_id {id_kind}, body int, packed binary")
    wanted = wanted.select(
        F.col("hi").alias("of_hi"), F.col("lo").alias("of_lo"),
        F.col("rep_id").alias("of_id"), F.col("rep_body").alias("of_body"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("body") == F.col("of_body"))
    return packed.join(wanted, same)


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_pieces(batch, "text", _PIECE_BYTES):
            texts = column_bytes(part, "text")
            hashes = pa.array(map(text_hash, texts), pa.int32())
            packed = pa.array(map(pack, texts), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), hashes, packed], ["doc_id", "body", "packed"])


def _set_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["hi", "lo", "shingles"]
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            rows = []
            part = batch.slice(at, 200).to_pydict()
            for hi, lo, packed in zip(part["of_hi"], part["of_lo"], part["packed"], strict=True):
                found = shingles(unpack(packed))
                if _class_of(found) == (hi, lo):
                    rows.append((hi, lo, found.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )


def _verify(threshold: float):
    names = ["hi", "lo", "links", "root_hi", "root_lo"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            pairs = _pairs(group, threshold)
            if not pairs.any():
                continue
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            common = _common(sets)
            sizes = np.array([len(s) for s in sets])
            union = sizes[:, None] + sizes[None, :] - common
            # Exact for sets below 2 ** 24 shingles: common * 5 >= union * 4 at 0.8.
            similar = pairs & (common >= threshold * union - 1e-6)
            if not similar.any():
                continue
            both = similar | similar.T
            copies = group.column("copies").to_numpy()
            links = (both * copies[None, :]).sum(axis=1)
            root = _forest(both)
            some = np.flatnonzero(links)
            hi, lo = (group.column(c).to_numpy() for c in _KEY)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (hi[some], lo[some], links[some], hi[root[some]], lo[root[some]])],
                names,
            )

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row the first row that it is linked with, also by way of others."""
    root = np.full(len(linked), -1)
    for first in range(len(linked)):
        if root[first] >= 0:
            continue
        reached = np.zeros(len(linked), bool)
        reached[first] = True
        edge = reached
        while edge.any():
            edge = linked[edge].any(axis=0) & ~reached
            reached |= edge
        root[reached] = first
    return root
