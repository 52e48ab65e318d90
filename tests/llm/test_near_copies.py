"""The chosen-path join against all pairs."""

import math
import random

import numpy as np
import pytest
from documents import corpus, edges, frame, prose

from tradewind.llm import near_copies as nc


def shingle_set(text):
    words = (text or "").encode().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(rows):
    """Class and links of each row, by its place."""
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(r[0], least[find(i)], links[i]) for i, r in enumerate(rows)]


def changed(text, n, seed):
    draw, words = random.Random(seed), text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


def families():
    rows = corpus(60)
    bases = [prose(f"base {k}", 150 + 20 * k) for k in range(8)]
    for k, base in enumerate(bases):
        for j in range(6):
            rows.append((1000 + 10 * k + j, changed(base, j, f"{k} {j}"), "en", "s", 0))
    return rows


def result(df):
    return sorted(map(str, ((r.doc_id, r.class_id, r.n_links) for r in df.collect())))


def test_equals_all_pairs(spark):
    rows = families()
    assert result(nc.near_copies(frame(spark, rows, extra=True))) == sorted(map(str, brute_force(rows)))


def test_large_groups_are_split_and_compared_in_blocks(spark):
    base = prose("base", 200)
    rows = corpus(30) + [(1000 + i, changed(base, i % 4, i), "en", "s", 0) for i in range(90)]
    found = {r.doc_id: r for r in nc.near_copies(frame(spark, rows), most_at_once=10).collect()}
    expected = brute_force(rows)
    assert {d: r.class_id for d, r in found.items()} == {d: c for d, c, _ in expected}
    # Nodes split seven levels deep: pairs just at the threshold may be missed, none is made up.
    assert all(found[d].n_links <= n for d, _, n in expected)
    assert sum(r.n_links for r in found.values()) >= 0.99 * sum(n for _, _, n in expected)


def test_edges(spark):
    rows = edges()
    found = nc.near_copies(frame(spark, rows, extra=True))
    assert result(found) == sorted(map(str, brute_force(rows)))


def test_one_of_each_group_stays(spark):
    rows = edges() + families()[60:]
    df = frame(spark, rows, extra=True)
    kept = nc.without_near_copies(df)
    assert kept.columns == df.columns
    expected = {c for (d, c, _), r in zip(brute_force(rows), rows, strict=True) if shingle_set(r[1])}
    stay = [tuple(r) for r in kept.select("doc_id", "text").collect() if shingle_set(r.text)]
    assert {d for d, _ in stay} == expected and all(n == 0 for _, _, n in brute_force(stay))
    wordless = [r for r in rows if not shingle_set(r[1])]
    assert kept.where("text IS NULL OR NOT text RLIKE '[^ \\\\n\\\\t]'").count() == len(wordless)


def test_recall_at_the_threshold():
    """Pairs of sets exactly at 0.8 meet in a common node at least as often as promised."""
    draw, met, pairs = np.random.RandomState(0), 0, 3000
    for _ in range(pairs):
        tokens = draw.randint(0, 2**62, 100).astype(np.uint64)
        values = np.stack([nc.embed(tokens[:90]), nc.embed(tokens[10:])])
        rows = np.tile(np.arange(2), nc.runs_needed())
        nodes = np.repeat(np.arange(1, nc.runs_needed() + 1, dtype=np.uint64), 2)
        for _ in range(nc.DEPTH):
            rows, nodes = nc._children(rows, nodes, values, nc.THRESHOLD)
        met += bool(set(nodes[rows == 0].tolist()) & set(nodes[rows == 1].tolist()))
    assert met / pairs > 0.997


def test_survival_and_runs():
    assert nc.survival(0, 0.8) == 1 and nc.survival(1, 0.8) == pytest.approx(0.84)
    assert (1 - nc.survival(nc.DEPTH, 0.8)) ** nc.runs_needed(0.9999) <= 1e-4


def test_recall_over_all_embeddings():
    """All runs share one embedding: the target holds for the mean over it."""
    places = nc.PLACES
    missed = sum(
        math.comb(places, k) * 0.8**k * 0.2 ** (places - k)
        * (1 - nc.survival(nc.DEPTH, k / places)) ** nc.runs_needed()
        for k in range(places + 1)
    )
    assert missed <= 1e-4


def test_large_families_keep_all_links(spark):
    """Nodes above ``most_at_once`` lose no pair that is near the threshold."""
    base = prose("base", 200)
    rows = [(i, changed(base, 2, f"near {i}"), "en", "s", 0) for i in range(80)]
    found = nc.near_copies(frame(spark, rows), most_at_once=10)
    assert result(found) == sorted(map(str, brute_force(rows)))


@pytest.mark.parametrize("same_id", [None, 7])
def test_texts_of_one_id_are_fetched_once_each(spark, same_id, monkeypatch):
    """Many near copies under one id: no join of all texts of it with all its classes."""
    fetched, plain = [], nc._texts

    def counted(*args):
        fetched.append(plain(*args).count())
        return plain(*args)

    monkeypatch.setattr(nc, "_texts", counted)
    base = prose("base", 200)
    rows = [(same_id, changed(base, 1, i), "en", "s", 0) for i in range(40)]
    assert result(nc.near_copies(frame(spark, rows))) == sorted(map(str, brute_force(rows)))
    assert fetched == [40]


def test_empty_table(spark):
    empty = frame(spark, edges()).limit(0)
    assert nc.near_copies(empty).count() == 0 and nc.without_near_copies(empty).count() == 0
