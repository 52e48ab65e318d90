"""Benchmark passages in documents, by Wu-Manber search for many strings at once.

The test strings are all windows of ``WINDOW`` consecutive words of the items; an item of fewer
words is one shorter string. The symbols of the search are words. A document is read by the
last two words of where a string could end, its block. A table says by how many words each block
of the test strings lets the search advance; a block that no string holds lets it pass all of
them but one, a word that no string holds passes over itself. Where a block ends some string,
its bucket gives the strings of the same first block, and these are compared word by word.
Strings of each length have tables of their own, so that short items do not shorten the shifts
of the others.

Documents never meet: there is no shuffle, and a frequent passage costs what it is long. Items
are searched for in sets of at most ``MOST_BYTES`` of text, whose tables each task builds; if
there are several sets, the documents are read once for each.

Defined cases: null texts have no words. Rows of one item id are one item, also those of null,
whose name is empty. Repeated rows of documents are each judged. Null document ids stay.
"""

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import column_bytes, store, text_pieces
from tradewind.llm.words import bounded_sets, byte_table, word_runs

WINDOW = 10
MOST_BYTES = 2 << 20  # of the texts of a set of items; its tables take some fifty times that
_PIECE_BYTES = 4 << 20

# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
_TABLE = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def words_of(text: bytes) -> list[bytes]:
    return [word for run in word_runs(text, _TABLE) for word in run]


class _Strings:
    """Tables of the test strings of one length, words given as numbers."""

    def __init__(self, strings: dict[tuple, set]):
        self.length = m = len(next(iter(strings)))
        self.shifts: dict[int, dict] = defaultdict(dict)
        self.buckets: dict[tuple, dict] = defaultdict(lambda: defaultdict(list))
        for string, names in strings.items():
            for end in range(min(1, m - 1), m):
                row = self.shifts[string[end]]
                before = string[end - 1] if m > 1 else None
                row[before] = min(m - 1 - end, row.get(before, m))
            self.buckets[string[-2:]][string[:2]].append((list(string), names))
        # The first word alone ends no block, but can stand under the end of a longer shift.
        for string in strings:
            self.shifts.setdefault(string[0], {})

    def occurrences(self, words: list, at: int) -> Iterator[tuple[int, set]]:
        """Starts of strings whose last word is at ``at`` or later, and their items' names."""
        m, shifts, buckets, n = self.length, self.shifts.get, self.buckets, len(words)
        at = max(at, m - 1)
        while at < n:
            row = shifts(words[at])
            if row is None:
                at += m
                continue
            shift = row.get(words[at - 1] if m > 1 else None, m - 1)
            if shift:
                at += shift
                continue
            start = at - m + 1
            found = words[start : at + 1]
            for string, names in buckets[tuple(found[-2:])].get(tuple(found[:2]), ()):
                if string == found:
                    yield start, names
            at += 1


class Searcher:
    """Tables for a set of (name, text) items."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
            length = min(window, len(words))
            for start in range(len(words) - length + 1) if length else ():
                by_length[length][tuple(words[start : start + length])].add(name)
        self.strings = [_Strings(strings) for strings in by_length.values()]
        self.kept = max(by_length, default=1) - 1

    def search(self, text: bytes) -> tuple[int, list[list[int]], set]:
        """Number of words, runs [start, end) of hit words, names of the items found."""
        spans, names, total, words = [], set(), 0, []
        for run in word_runs(text, _TABLE):
            # The last words of the run before, in which a string may start.
            words = words[max(0, len(words) - self.kept) :] if self.kept else []
            first, base = len(words), total - len(words)
            words.extend(map(self.numbers.get, run))
            for strings in self.strings:
                for start, found in strings.occurrences(words, first):
                    names |= found
                    spans.append((base + start, base + start + strings.length))
            total += len(run)
        return total, merged(spans), names


def merged(spans: list) -> list[list[int]]:
    """Maximal runs covered by spans (start, end)."""
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return runs


_FOUND = "n_words bigint, spans array<array<bigint>>, item_ids array<string>"


def _search(items: list[tuple[str, bytes]], window: int, kept: list[str]):
    names = [*kept, "n_words", "spans", "item_ids"]
    kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items, window)
        for batch in batches:
            for part in text_pieces(batch, "text", _PIECE_BYTES):
                found = [searcher.search(text) for text in column_bytes(part, "text")]
                if "spans" in part.schema.names:
                    before = zip(part.column("spans").to_pylist(), part.column("item_ids").to_pylist(), strict=True)
                    found = [
                        (n, merged(spans + old), items | {*names})
                        for (n, spans, items), (old, names) in zip(found, before, strict=True)
                    ]
                counts, spans, items_found = zip(*found, strict=True)
                columns = [counts, spans, [sorted(x) for x in items_found]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in kept),
                        *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)),
                    ],
                    names,
                )

    return run


def find_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_words, ``spans`` (runs [start, end) of hit words, counted from 0)
    and ``item_ids`` (the items with occurring windows, as sorted strings)."""
    found = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = found.schema["doc_id"].dataType.simpleString()
    name = F.coalesce(items[item_id].cast("string"), F.lit(""))
    named = items.select(name.alias("item_id"), items[item_text].alias("text"))
    for rows, last in bounded_sets(named, "item_id", "text", most_bytes):
        strings = [(r["item_id"], r["text"].encode()) for r in rows]
        kept = {"doc_id": kind} if last else {"doc_id": kind, "text": "string"}
        schema = ", ".join([*(f"{c} {k}" for c, k in kept.items()), _FOUND])
        found = found.mapInArrow(_search(strings, window, [*kept]), schema)
        if not last:
            found = store(found, "searched")
    return found


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of what ``find_items`` returns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
