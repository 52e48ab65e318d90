"""Shards: sizes, slots, whole groups, and the tree on awkward metadata."""

import zlib

import pytest
from documents import edges, frame, prose

from tradewind.llm import sharding


def check(rows, found, shards):
    assert len(found) == len(rows)
    key = lambda doc_id, text: (doc_id, len((text or "").encode()) + 16, zlib.crc32((text or "").encode()))
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in found))) == sorted(
        map(str, (key(d, t) for d, t, *_ in rows))
    )
    by_shard = {}
    for r in found:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by_shard.setdefault(r.shard, []).append(r)
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    return {s: sum(r.size for r in m) for s, m in by_shard.items()}


def test_sizes_are_near_equal(spark):
    rows = [(i, prose(i, 10 + i % 90), "en" if i % 3 else "de", f"s{i % 7}", 0) for i in range(2000)]
    found = sharding.shard(frame(spark, rows), 10).collect()
    sizes = check(rows, found, 10)
    mean = sum(sizes.values()) / 10
    assert len(sizes) == 10
    assert all(abs(s - mean) < 0.02 * mean for s in sizes.values())
    again = sharding.shard(frame(spark, rows[::-1], parts=7), 10).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_equal_texts_stay_together_unless_they_outweigh_a_shard(spark):
    rows = [(i, prose(i, 50), "en", f"s{i % 5}", 0) for i in range(600)]
    rows += [(1000 + i, prose(i // 4, 50), "de", f"s{i % 3}", 0) for i in range(100)]
    rows += [(5000 + i, prose("hot", 50), "en", "s1", 0) for i in range(400)]
    found = sharding.shard(frame(spark, rows), 8).collect()
    sizes = check(rows, found, 8)
    mean = sum(sizes.values()) / 8
    assert all(abs(s - mean) < 0.05 * mean for s in sizes.values())
    texts = {r[0]: r[1] for r in rows}
    places = {}
    for r in found:
        places.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert {t for t, s in places.items() if len(s) > 1} == {prose("hot", 50)}


def test_all_alike(spark):
    rows = [(7, "same", "en", "s", 0)] * 30 + [(i, "x" * 40, "en", "s", 0) for i in range(50)]
    check(rows, sharding.shard(frame(spark, rows), 4).collect(), 4)


def test_repeated_rows_are_dealt_out(spark):
    """A third of the rows, and of the bytes, are one row again and again."""
    rows = [(7, prose("hot", 50), "en", "s", 0)] * 900
    rows += [(i, prose(i, 50), "en", f"s{i % 5}", 0) for i in range(1800)]
    found = sharding.shard(frame(spark, rows), 10).collect()
    sizes = check(rows, found, 10)
    mean = sum(sizes.values()) / 10
    assert len(sizes) == 10 and all(abs(s - mean) < 0.02 * mean for s in sizes.values())
    again = sharding.shard(frame(spark, rows[::-1], parts=7), 10).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_names_are_ranked_whole(spark):
    """Sources of a long common head part the documents as short ones do."""
    names = ["https://example.com/a", "https://example.com/b", "source_01", "source_02", "é", "", None]
    docs = frame(spark, [(i, "text", "en", names[i % 7], 0) for i in range(50)], parts=5)
    ranked = sharding._ranked(docs, "source")
    assert ranked.count() == 50
    found = {names[r.doc_id % 7]: r.by_source for r in ranked.collect()}
    known = sorted((n for n in names if n is not None), key=lambda n: n.encode())
    assert found == {None: -1} | {n: k for k, n in enumerate(known)}


def test_long_names_split_a_dimension(spark):
    rows = [(5, prose(i, 40)[:100], "en", f"https://site.example/{i % 8}", 0) for i in range(800)]
    found = sharding.shard(frame(spark, rows), 8).collect()
    check(rows, found, 8)
    by_crc = {zlib.crc32(r[1].encode()): r[3] for r in rows}
    shards = {}
    for r in found:
        shards.setdefault(by_crc[r.text_crc32], set()).add(r.shard)
    assert sum(map(len, shards.values())) <= 8 + 7


def test_edges(spark):
    rows = edges()
    check(rows, sharding.shard(frame(spark, rows, extra=True), 5).collect(), 5)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_rows_than_shards(spark, n):
    rows = edges()[:n]
    check(rows, sharding.shard(frame(spark, rows), 40).collect(), 40)
