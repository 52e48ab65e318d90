"""The ten best documents of each item, against scores of all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from documents import corpus, edges, frame, prose

from tradewind.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=10):
    lists = [(row[0], terms(row[1])) for row in docs]
    n_docs, total = sum(bool(t) for _, t in lists), sum(len(t) for _, t in lists)
    df = Counter(t for _, words in lists for t in set(words))
    wanted = defaultdict(set)
    for item, text in items:
        if text is not None:
            wanted[item] |= set(terms(text))
    found = []
    for item, own in wanted.items():
        scored = []
        for doc_id, words in lists:
            tf = Counter(words)
            m = 10 + (90 * len(words) * n_docs) // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in own
                if tf[t]
            )
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0))
        for rank, (score, known, doc_id) in enumerate(sorted(scored)[:k], 1):
            found.append((item, rank, doc_id if known else None, -score))
    return sorted(map(str, found))


def items_of(rows, seed=0):
    draw = random.Random(seed)
    texts = [r[1].split() for r in rows if r[1] and r[1].split()]
    return [(i, " ".join(draw.choices(draw.choice(texts), k=draw.randint(1, 12)))) for i in range(12)]


def result(spark, rows, items, extra=False, **kwargs):
    found = search.rank(frame(spark, rows, extra), spark.createDataFrame(items, ITEMS), **kwargs)
    return sorted(map(str, map(tuple, found.collect())))


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    rows = edges()
    items = items_of(rows) + [
        (20, None), (21, ""), (22, "..."), (None, "one two"), (20, rows[3][1][:80]), (3, "one"), (23, "É é 中文 ONE")
    ]
    assert result(spark, rows, items, extra) == brute_force(rows, items)


def test_small_blocks_and_sets_of_items_change_nothing(spark):
    rows = corpus(150)
    items = items_of(rows)
    expected = brute_force(rows, items, 4)
    assert result(spark, rows, items, k=4) == expected
    assert result(spark, rows, items, k=4, cells=2000, most_bytes=200) == expected


def test_copies_tie_by_id(spark):
    rows = [(i, prose("same"), "en", "s", 1) for i in range(400)] + corpus(30, 2)
    rows = [(n, *r[1:]) for n, r in enumerate(reversed(rows))]
    items = [(0, prose("same")), (1, prose("same")[:40])]
    assert result(spark, rows, items) == brute_force(rows, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), (corpus(5), []), ([], [])])
def test_empty_tables(spark, docs, items):
    found = search.rank(frame(spark, docs), spark.createDataFrame(items, ITEMS))
    assert found.count() == 0
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_text_ids(spark):
    rows = [(f"d{i}", r[1], *r[2:]) for i, r in enumerate(corpus(20))]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n bigint")
    items = spark.createDataFrame([("x", rows[7][1])], "item_id string, text string")
    first = search.rank(docs, items).where("rank = 1").first()
    assert (first.item_id, first.doc_id) == ("x", "d7")


def test_block_equals_sorting_all_scores():
    draw = np.random.RandomState(0)
    for trial in range(200):
        size, terms = draw.randint(1, 60), draw.randint(1, 8)
        held = draw.rand(terms, size) < draw.rand()
        of_term, of_doc = np.nonzero(held)
        impacts = draw.randint(0, 6 if trial % 2 else 10_000, len(of_term)).astype(np.int64)
        block = search.Block(of_term.astype(np.int32), of_doc, impacts, size)
        item = np.flatnonzero(draw.rand(terms) < 0.7).astype(np.int32)
        scores = np.zeros(size, np.int64)
        np.add.at(scores, of_doc, np.where(np.isin(of_term, item), impacts, 0))
        order = np.lexsort((np.arange(size), -scores))[:5]
        expected = [(int(scores[i]), int(i)) for i in order if scores[i] > 0]
        assert block.best(item, 5) == expected
        floor = int(draw.randint(0, 10_000))
        found = [x for x in block.best(item, 5, floor) if x[0] >= floor]
        assert found == [x for x in expected if x[0] >= floor]


def test_reading_stops_early(monkeypatch):
    """Few of many documents are met where a few stand out."""
    n = 20_000
    impacts = np.r_[np.full(12, 1000), np.arange(n - 12) % 100 + 1].astype(np.int64)
    block = search.Block(
        np.repeat([0, 1], n).astype(np.int32), np.tile(np.arange(n), 2), np.tile(impacts, 2), n
    )
    met = []
    unique = np.unique
    monkeypatch.setattr(search.np, "unique", lambda x, **kw: met.append(len(x)) or unique(x, **kw))
    assert block.best(np.array([0, 1], np.int32), 10) == [(2000, i) for i in range(10)]
    assert sum(met) < 200
