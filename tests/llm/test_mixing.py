"""The mix: targets, balance, limits, reruns."""

import random
from collections import Counter

import pytest
from documents import edges, frame, prose

from tradewind.llm import mixing


def test_targets_share_by_weight():
    assert mixing.targets([600, 600, 600], [1, 2, 3]) == [300, 600, 900]


def test_targets_stop_at_three_times_the_size():
    found = mixing.targets([1000, 10, 10, 300], [1, 2, 3, 1])
    assert found[1:3] == [30, 30]
    assert found[0] == found[3] == pytest.approx(630)
    assert sum(found) == pytest.approx(1320)
    assert mixing.targets([5], [1]) == [5]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]
    assert mixing.targets([], []) == []


def test_flight_keeps_both_totals_and_leaves_two():
    draw = random.Random(3)
    sizes = [draw.randint(1, 3000) for _ in range(500)]
    chances = [0.37] * 500
    words = sum(s * c for s, c in zip(sizes, chances, strict=True))
    left = mixing.fly(sizes, chances, draw)
    assert len(left) <= 2
    assert sum(s * c for s, c in zip(sizes, chances, strict=True)) == pytest.approx(words)
    assert sum(chances) == pytest.approx(500 * 0.37)
    assert all(c in (0, 1) for i, c in enumerate(chances) if i not in left)


def test_flight_of_equal_sizes():
    chances = [0.25] * 40
    mixing.fly([7] * 40, chances, random.Random(1))
    assert sum(chances) == pytest.approx(10)


def test_the_flight_changes_no_expectation():
    taken = [0.0] * 30
    for seed in range(2000):
        chances = [0.3] * 30
        mixing.fly([10 * (i + 1) for i in range(30)], chances, random.Random(seed))
        taken = [t + c for t, c in zip(taken, chances, strict=True)]
    assert all(abs(t / 2000 - 0.3) < 0.04 for t in taken)


def rows_of(n):
    draw = random.Random(9)
    sources = ["hot"] * 3 + ["a", "b", None, "é", "Z"]
    return [(i, prose(i, draw.choice([5, 30, 80, 700])), "en", draw.choice(sources), 0) for i in range(n)]


def test_sources_come_near_their_targets(spark):
    rows = rows_of(1500)
    found = mixing.mix(frame(spark, rows), block_rows=100).collect()
    size, source = {r[0]: len(r[1].split()) for r in rows}, {r[0]: r[3] for r in rows}
    assert {r.doc_id: r.size for r in found} == size
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    sizes = [sum(size[d] for d in size if source[d] == s) for s in names]
    aims = dict(zip(names, mixing.targets(sizes, [1, 2, 3, 1, 2, 3]), strict=True))
    totals = dict.fromkeys(names, 0)
    for r in found:
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        assert r.target == pytest.approx(aims[source[r.doc_id]])
        totals[source[r.doc_id]] += r.taken
    for s in names:
        # The landing alone could miss by a document, of which the longest has 700 words.
        assert abs(totals[s] - aims[s]) <= 350, s
    again = mixing.mix(frame(spark, rows[::-1], parts=5), block_rows=100).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_mixed_documents_are_the_taken_ones(spark):
    rows = rows_of(300) + rows_of(300)[:20]
    taken = sum(r.taken for r in mixing.mix(frame(spark, rows)).collect())
    docs = mixing.mixed_documents(frame(spark, rows, extra=True))
    assert docs.columns == frame(spark, rows, extra=True).columns
    assert sum(len(r.text.split()) for r in docs.collect()) == taken


def test_many_repeated_rows(spark):
    """A third of the rows is one row again and again; another comes with and without a source."""
    hot = (1007, prose("hot", 30), "en", "a", 0)
    rows = [hot] * 20_000 + [(1008, prose("twice", 30), "en", s, 0) for s in ("b", None)] * 50 + rows_of(300)
    taken = Counter()
    for r in mixing.mix(frame(spark, rows)).collect():
        taken[r.doc_id] += r.copies
    found = mixing.mixed_documents(frame(spark, rows))
    assert Counter(r.doc_id for r in found.collect()) == +taken
    assert {r.source for r in found.where("doc_id = 1008").collect()} <= {"b", None}


def test_edges(spark):
    rows = edges()
    found = mixing.mix(frame(spark, rows, extra=True)).collect()
    assert len(found) == len(rows)
    assert all(r.taken == 0 for r in found if r.size == 0)
    assert mixing.mixed_documents(frame(spark, rows)).where("text IS NULL").count() == 0


def test_empty_tables(spark):
    empty = frame(spark, edges()).limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = frame(spark, [(1, None, "en", "a", 0), (2, " ", "en", "b", 0)])
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]
