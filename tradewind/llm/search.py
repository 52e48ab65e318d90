"""The highest-scoring documents of each item, by the best position algorithm.

A first pass keeps, of each document, its number of terms and the frequencies of the terms that
items have; from these the weights follow. A document's impact for a term depends on no item, so
each task sorts its documents, a block at a time, into one impact list a term. For an item
its lists are read from the top, some positions at a time. Every document met is looked up in the
item's other lists directly, by a table of positions, so its score is complete, and the positions
found count as seen. The best position of a list is the last one before which all are seen; a
document not met yet stands below the best position of every list. The sum of the impacts there
bounds its score, and an item is done with a block once this is strictly below its k-th score so
far. Equal scores are therefore all met, and go by ascending id.

Each task gives ``k`` rows an item, and Spark ranks these. Items are handled in sets of at most
``MOST_BYTES`` of text; a block is small enough for its table of positions to have ``CELLS`` cells.

Defined cases: null texts and texts without terms match nothing and count in no statistic. Rows
of one item id are one item with the terms of all its texts; a null id stays null. Repeated rows
of documents are ranked each. Null document ids come first among equals.
"""

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tradewind.llm.common import column_bytes, store, text_pieces
from tradewind.llm.words import bounded_sets, byte_table, word_runs

BEST = 10
MOST_BYTES = 256 << 10  # of the texts of a set of items
CELLS = 8 << 20  # terms times documents of a block, 32 MB of positions
STEP = 16  # positions of a list read at first; the number doubles
_PIECE_BYTES = 4 << 20
_DOCUMENTS, _TERMS = -1, -2  # in place of a term, in the table of statistics

# Terms are [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, only A-Z lower-cased.
_TABLE = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def terms_of(text: bytes) -> set[bytes]:
    return {term for run in word_runs(text, _TABLE) for term in run}


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_part(n: int, documents: int, total: int) -> int:
    return 100 - 90 + (90 * n * documents) // total


def _frequencies(vocabulary: dict[bytes, int]):
    """Per document: doc_id, n, the numbers of its item terms, how often it has each."""
    names, kinds = ["n", "terms", "tfs"], [pa.int64(), pa.binary(), pa.binary()]

    def of(text: bytes):
        n, counts = 0, Counter()
        for run in word_runs(text, _TABLE):
            n += len(run)
            counts.update(map(vocabulary.get, run))
        del counts[None]
        terms, tfs = np.array([*counts], np.int32), np.array([*counts.values()], np.int64)
        return n, terms.tobytes(), tfs.tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_pieces(batch, "text", _PIECE_BYTES):
                columns = zip(*map(of, column_bytes(part, "text")), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    ["doc_id", *names],
                )

    return run


def _joined(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each term, and their number and all their terms."""
    holding: Counter = Counter()
    for batch in batches:
        n = batch.column("n").to_numpy()
        holding.update({_DOCUMENTS: int((n > 0).sum()), _TERMS: int(n.sum())})
        terms, counts = np.unique(_joined(batch.column("terms"), np.int32), return_counts=True)
        holding.update(dict(zip(terms.tolist(), counts.tolist(), strict=True)))
    yield pa.RecordBatch.from_arrays(
        [pa.array([*holding], pa.int32()), pa.array([*holding.values()], pa.int64())], ["term", "n"]
    )


class Block:
    """Impact lists of the documents of a block, and where each document stands in them."""

    def __init__(self, terms: np.ndarray, documents: np.ndarray, impacts: np.ndarray, size: int):
        some = impacts > 0
        terms, documents, impacts = terms[some], documents[some], impacts[some]
        order = np.lexsort((documents, -impacts, terms))
        terms, self.documents, self.impacts = terms[order], documents[order], impacts[order]
        self.terms, starts = np.unique(terms, return_index=True)
        self.starts = np.append(starts, len(terms))
        self.size = size
        # A document's position in the list of each term of the block from 1 on, 0 if it is not in it.
        self.at = np.zeros((len(self.terms), size), np.int32)
        rows = np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        self.at[rows, self.documents] = np.arange(len(terms)) - self.starts[rows] + 1

    def best(self, item: np.ndarray, k: int, floor: int = 0) -> list[tuple[int, int]]:
        """(score, document) of the ``k`` best for an item's terms, equal ones by document.

        Those below ``floor`` may be missing."""
        rows = np.flatnonzero(np.isin(self.terms, item, assume_unique=True))
        lists = [slice(self.starts[r], self.starts[r + 1]) for r in rows]
        lengths = np.diff(self.starts)[rows]
        seen = [np.zeros(n, bool) for n in lengths]
        best = [0] * len(rows)
        known = np.zeros(self.size, bool)
        documents, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, STEP
        while depth < max(lengths, default=0):
            read = [self.documents[x][depth : depth + step] for x in lists]
            met = np.unique(np.concatenate(read))
            met = met[~known[met]]
            known[met] = True
            positions = self.at[np.ix_(rows, met)]
            held = positions > 0
            found = np.where(held, self.impacts[(positions - 1 + self.starts[rows][:, None]) * held], 0)
            documents, scores = np.append(documents, met), np.append(scores, found.sum(axis=0))
            depth, step, bound = depth + step, 2 * step, 0
            for j, marks in enumerate(seen):
                marks[positions[j][held[j]] - 1] = True
                rest = marks[best[j] :]
                best[j] += len(rest) if rest.all() else int(rest.argmin())
                if best[j] < lengths[j]:
                    # At least ``depth`` positions are seen, so the best position is one of the list's.
                    bound += int(self.impacts[lists[j]][best[j] - 1])
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, -k)[-k]))
            if bound < floor:
                break
        order = np.lexsort((documents, -scores))[:k]
        return [(int(scores[i]), int(documents[i])) for i in order]


def _best(items: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int, cells: int):
    """The ``k`` best rows of a task for each item, by its number."""
    size = max(1, cells // max(1, len(weights)))

    def blocks(batches):
        held, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                if held and rows + part.num_rows > size:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def block(table: pa.Table) -> Block:
        terms, tfs = (_joined(table.column(c), k) for c, k in (("terms", np.int32), ("tfs", np.int64)))
        counts = np.array([len(x) // 4 for x in table.column("terms").to_pylist()])
        of = np.repeat(np.arange(table.num_rows), counts)
        m = np.array([length_part(n, documents, total) for n in table.column("n").to_pylist()], np.int64)
        impacts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[of]))
        return Block(terms, of, impacts, table.num_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By item: (-score, row of the task); rows are in the order of their ids.
        top: list[list[tuple]] = [[] for _ in items]
        ids, before, kind = {}, 0, None
        for table in blocks(batches):
            lists, kind = block(table), table.schema.field("doc_id").type
            own = table.column("doc_id")
            for number, terms in enumerate(items):
                held = top[number]
                floor = -held[-1][0] if len(held) == k else 0
                for score, at in lists.best(terms, k, floor):
                    held.append((-score, before + at))
                    ids[before + at] = own[at].as_py()
                held.sort()
                del held[k:]
            kept = {row for held in top for _, row in held}
            ids = {row: x for row, x in ids.items() if row in kept}
            before += table.num_rows
        rows = [(number, ids[row], -score) for number, held in enumerate(top) for score, row in held]
        if rows:
            number, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())],
                ["item", "doc_id", "score"],
            )

    return run


def rank(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = BEST,
    most_bytes: int = MOST_BYTES,
    cells: int = CELLS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` highest-scoring documents above 0 of
    each item; equal scores by ascending document id."""
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    sets = bounded_sets(items, item_id, item_text, most_bytes)
    kind = items.schema[item_id].dataType.simpleString()
    found = None
    for rows, last in sets:
        part = _rank_set(own, rows, kind, k, cells)
        part = part if last else store(part, "ranked")
        found = part if found is None else found.unionByName(part)
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _rank_set(own: DataFrame, rows: list[Row], item_kind: str, k: int, cells: int) -> DataFrame:
    """item_id, doc_id and score: ``k`` rows an item from each task."""
    items: dict = defaultdict(set)
    for row in rows:
        items[row["item_id"]] |= terms_of(row["text"].encode())
    vocabulary = {term: n for n, term in enumerate(sorted(set().union(*items.values())))}
    numbered = [np.array([vocabulary[t] for t in terms], np.int32) for terms in items.values()]
    kind = own.schema["doc_id"].dataType.simpleString()
    counted = own.mapInArrow(
        _frequencies(vocabulary), f"doc_id {kind}, n bigint, terms binary, tfs binary"
    )
    counted = store(counted, "frequencies")
    statistics = counted.select("n", "terms").mapInArrow(_statistics, "term int, n bigint")
    n = {r["term"]: r["n"] for r in statistics.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, total = n.get(_DOCUMENTS, 0), n.get(_TERMS, 0)
    weights = np.array([weight(documents, n.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    holding = counted.where("length(terms) > 0").sortWithinPartitions(F.asc_nulls_first("doc_id"))
    best = holding.mapInArrow(
        _best(numbered, weights, documents, total, k, cells), f"item int, doc_id {kind}, score bigint"
    )
    names = own.sparkSession.createDataFrame(
        list(enumerate(items)), f"item int, item_id {item_kind}"
    )
    return best.join(names, "item").drop("item")
