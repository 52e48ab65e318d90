"""Benchmark windows in documents, against comparing every window with every place."""

import hashlib
import random
import re

import pytest
from documents import corpus, edges, frame, prose

from tradewind.llm import contamination, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def judge(text, items, window=10):
    own, hit, names = words_of(text), set(), set()
    for name, item in items:
        item = words_of(item)
        size = min(window, len(item))
        for start in range(len(item) - size + 1) if size else ():
            for at in range(len(own) - size + 1):
                if own[at : at + size] == item[start : start + size]:
                    hit |= set(range(at, at + size))
                    names.add("" if name is None else str(name))
    return len(own), len(hit), names


def brute_force(docs, items):
    found = []
    for doc_id, text, *_ in docs:
        n, hit, names = judge(text, items)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found.append((doc_id, n, hit, len(names), digest, hit > 0))
    return sorted(map(str, found))


def result(spark, docs, items, extra=False, **kwargs):
    items = spark.createDataFrame(items, ITEMS)
    found = contamination.report(contamination.find_items(frame(spark, docs, extra), items, **kwargs))
    return sorted(map(str, map(tuple, found.collect())))


def planted():
    """Documents with passages of items: whole, cut, in other case, across punctuation, twice."""
    items = [(i, prose(f"item {i}", 30)) for i in range(6)] + [(100 + i, prose(f"short {i}", 2 + i)) for i in range(4)]
    items += [(3, prose("another of the same id", 20)), (200, prose("item 1", 30)), (None, prose("nameless", 15))]
    docs = edges()
    for n, (_, text) in enumerate(items):
        own = text.split()
        for k, part in enumerate((own, own[:12], own[3:13], own[:9], own[-11:] + own[:10])):
            before, after = prose(f"before {n} {k}", 15), prose(f"after {n}", 15)
            passage = ", ".join(part).upper() if k % 2 else "\n".join(part)
            docs.append((1000 + 10 * n + k, f"{before}. {passage}; {after}", "en", "s1", 0))
    return docs, items + [(201, None), (202, ""), (203, "?!")]


@pytest.mark.parametrize("extra", [False, True])
def test_planted_passages(spark, extra):
    docs, items = planted()
    expected = brute_force(docs, items)
    assert result(spark, docs, items, extra) == expected
    assert sum("True" in x for x in expected) > 30


def test_items_in_several_sets(spark):
    docs, items = planted()
    assert result(spark, docs, items, most_bytes=300) == brute_force(docs, items)


def test_spans_are_maximal_runs(spark):
    item = prose("item", 12)
    text = f"{prose('x', 5)} {item} {item} {prose('y', 3)} {item}"
    rows = [(1, text, "en", "s", 0)]
    found = contamination.find_items(frame(spark, rows), spark.createDataFrame([(7, item)], ITEMS)).first()
    assert (found.spans, found.item_ids, found.n_words) == ([[5, 29], [32, 44]], ["7"], 44)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), (corpus(5), []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert result(spark, docs, items) == brute_force(docs, items)


def test_strings_of_few_words_in_every_order():
    draw = random.Random(0)
    for _ in range(1500):
        letters = ["a", "b", "c", "dé", "9"][: draw.randint(1, 5)]
        text = lambda n: " ".join(draw.choices(letters, k=n))  # noqa: B023, E731
        items = [(str(i % 4), text(draw.randint(0, 8))) for i in range(draw.randint(0, 5))]
        window, doc = draw.randint(1, 5), text(draw.randint(0, 40))
        searcher = contamination.Searcher([(n, t.encode()) for n, t in items], window)
        n, spans, names = searcher.search(doc.encode())
        assert (n, sum(end - start for start, end in spans), names) == judge(doc, items, window)


def test_long_texts_are_read_in_runs(monkeypatch):
    item = prose("item", 14)
    doc = f"{prose('a', 40)} {item} {prose('b', 40)} {item}"
    whole = contamination.Searcher([("1", item.encode())]).search(doc.encode())
    monkeypatch.setattr(words.word_runs, "__defaults__", (7,))
    assert contamination.Searcher([("1", item.encode())]).search(doc.encode()) == whole


def test_shifts_skip_most_places():
    item = prose("item", 40)
    searcher = contamination.Searcher([("1", item.encode())])
    looked = []

    class Watched(list):
        def __getitem__(self, at):
            looked.append(at)
            return super().__getitem__(at)

    numbers = Watched(map(searcher.numbers.get, words_of(prose("other", 1000, "ijklm"))))
    assert not list(searcher.strings[0].occurrences(numbers, 0))
    assert len(looked) == 100
