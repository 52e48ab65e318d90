"""Removal of repeated strings against all strings of all texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from documents import edges, frame, prose

from tradewind.llm import substrings
from tradewind.llm.substrings import LENGTH


def brute_force(rows):
    texts = [(r[1] or "").encode() for r in rows]
    counts = Counter(t[i : i + LENGTH] for t in texts for i in range(len(t) - LENGTH + 1))
    found = []
    for (doc_id, *_), t in zip(rows, texts, strict=True):
        covered = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - LENGTH + 1):
            if counts[t[i : i + LENGTH]] > 1:
                covered[i : i + LENGTH] = True
        kept = np.frombuffer(t, np.uint8)[~covered[:-1]].tobytes()
        runs = int((np.diff(covered.astype(int)) == -1).sum())
        found.append((doc_id, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, found))


def result(df):
    return sorted(map(str, map(tuple, df.collect())))


def passages(n=60):
    """Texts with passages in common, some just long enough, some just too short."""
    draw = random.Random(4)
    shared = [prose(f"shared {k}", 60)[: draw.choice([199, 200, 201, 230, 300])] for k in range(8)]
    rows = []
    for i in range(n):
        parts = [prose(f"own {i} {k}", draw.randint(1, 60)) for k in range(4)]
        for k in range(3):
            parts.insert(draw.randint(0, len(parts)), draw.choice(shared))
        rows.append((i, draw.choice(["", " "]).join(parts), "en", "s", 0))
    return rows


def test_equals_brute_force(spark):
    rows = passages()
    assert result(substrings.removal_report(frame(spark, rows))) == brute_force(rows)


def test_common_cores_are_taken_apart(spark, monkeypatch):
    """One very common passage, and many more phrases than are sorted together."""
    passage = prose("common", 60)[:260]
    rows = [(i, f"{prose(i, 30)} {passage} {prose(-i - 1, 30)}", "en", "s", 0) for i in range(60)]
    expected = brute_force(rows)
    assert result(substrings.removal_report(frame(spark, rows))) == expected
    monkeypatch.setattr(substrings, "MOST_SORTED", 3)
    assert result(substrings.removal_report(frame(spark, rows))) == expected


def test_repetitive_texts(spark):
    rows = [
        (0, "a" * 1000, "", "", 0), (1, "ab" * 300, "", "", 0), (2, "a" * 199, "", "", 0),
        (3, "a" * 200, "", "", 0), (4, "abc" * 70, "", "", 0), (5, "xyz" * 67 + "x", "", "", 0),
        (6, "\x00" * 250, "", "", 0), (7, "é" * 150, "", "", 0),
    ]
    assert result(substrings.removal_report(frame(spark, rows))) == brute_force(rows)


def test_edges(spark):
    rows = edges()
    found = substrings.removal_report(frame(spark, rows, extra=True))
    assert result(found) == brute_force(rows)


def test_strings_across_the_places_where_long_texts_are_cut(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_CHUNK", 1000)
    substrings._hashes.cache_clear()
    rows = [(i, f"{prose(i, 300)} {prose('x', 100)} {prose(-i - 1, 200)}", "", "", 0) for i in range(3)]
    whole = [substrings.parse(r[1].encode()) for r in rows]
    monkeypatch.undo()
    substrings._hashes.cache_clear()
    for row, parsed in zip(rows, whole, strict=True):
        # The same strings with the same triggers, only the phrases at the cuts in two.
        places = lambda p: {(s + k, t) for s, n, t in zip(*p[:3], strict=True) for k in range(n)}
        assert places(parsed) == places(substrings.parse(row[1].encode()))


def test_every_string_has_one_phrase():
    text = prose(1, 500).encode()
    start, count, trigger, *_ = substrings.parse(text)
    assert count.sum() == len(text) - LENGTH + 1 and start[0] == 0
    assert (start[1:] == (start + count)[:-1]).all()
    assert ((trigger >= start + count - 1) & (trigger < start + substrings.REACH)).all()


def test_documents_keep_their_columns(spark):
    rows = passages(20) + [(90, None, None, None, None), (91, "é" * 400, "x", "y", 400)]
    df = frame(spark, rows, extra=True)
    kept = substrings.remove_repeats(df)
    assert kept.columns == df.columns
    found = {r.doc_id: r for r in kept.collect()}
    assert len(found) == len(rows) and found[90].text is None and found[91].text == ""
    assert all(r.n_chars == len(r.text) for r in found.values() if r.text is not None)
    reported = {r.doc_id: r for r in substrings.removal_report(df).collect()}
    for i in range(20):
        assert hashlib.sha256(found[i].text.encode()).hexdigest() == reported[i].kept_sha256


@pytest.mark.parametrize("rows", [[], [(1, None, "", "", 0)], [(1, "short", "", "", 0)]])
def test_nothing_to_remove(spark, rows):
    df = frame(spark, rows)
    assert result(substrings.removal_report(df)) == brute_force(rows)
    assert substrings.remove_repeats(df).count() == len(rows)
