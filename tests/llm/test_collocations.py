"""Collocations against counting every phrase of every text."""

import random
import re
from collections import Counter, defaultdict

import pytest
from documents import EXTRA, edges, prose

from tradewind.llm import collocations

SCHEMA = "text string, lang string"


def pieces(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", folded)]


def brute_force(rows, support, best):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in pieces(text):
            totals[lang] += len(piece)
            for size in range(1, 5):
                for at in range(len(piece) - size + 1):
                    counts[lang][tuple(piece[at : at + size])] += 1
    found = []
    for lang, f in counts.items():
        frequent = {p: n for p, n in f.items() if n >= support}
        kept = []
        for p, a in frequent.items():
            if len(p) == 1:
                continue
            covered = any(
                100 * n >= 80 * a and len(q) > len(p)
                and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, n in frequent.items()
            )
            score, _, l, r = min(
                (2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))
            )
            if not covered:
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:best], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(map(str, found))


def texts(n, seed=0):
    """Few words, so that phrases repeat; some come together, some only inside longer ones."""
    draw = random.Random(seed)
    common = [prose(f"common {i}", 1) for i in range(12)]
    fixed = [prose(f"fixed {i}", 2 + i % 4) for i in range(8)]
    rows = []
    for _ in range(n):
        words = draw.choices(common, k=draw.randint(3, 30)) + draw.choices(fixed, k=draw.randint(0, 6))
        draw.shuffle(words)
        ends = draw.choices([" ", " ", "\t", ", ", ". ", "\n", " ! ", "\r\n"], k=len(words))
        text = "".join(w.upper() + e if draw.random() < 0.1 else w + e for w, e in zip(words, ends, strict=True))
        rows.append((text, draw.choice(["en", "en", "de", None, "und"])))
    return rows


def result(spark, rows, support=8, best=40, extra=False, **kwargs):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        docs = docs.selectExpr("*", *(f"concat('x', lang) AS {c}" for c in ("phrase", "words", "parts", *EXTRA)))
    found = collocations.mine(docs, support=support, best=best, **kwargs)
    return sorted(map(str, map(tuple, found.collect())))


@pytest.mark.parametrize("shards", [1, 4, 7])
def test_all_phrases(spark, shards):
    rows = texts(150) + [r[1:3] for r in edges()] * 2
    assert result(spark, rows, shards=shards, extra=shards == 4) == brute_force(rows, 8, 40)


def test_hot_pair_repeated_rows_and_support_below_the_shards(spark):
    hot = "the same " + prose("tail", 3)
    rows = [(f"{hot} {prose(i, 2)}", "en") for i in range(200)] + texts(30, 1) * 3
    assert result(spark, rows, support=2) == brute_force(rows, 2, 40)


def test_full_filters_lose_nothing(spark, monkeypatch):
    rows = texts(60, 2)
    everything = lambda frequent: collocations.np.full(1 << 20, -1, "i8").view("u8")
    monkeypatch.setattr(collocations, "_filter", everything)
    assert result(spark, rows, run_words=100) == brute_force(rows, 8, 40)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("", "en"), (" \n", "de"), ("..", None)]])
def test_nothing_to_find(spark, rows):
    found = collocations.mine(spark.createDataFrame(rows, SCHEMA))
    assert found.count() == 0
    assert dict(found.dtypes) == dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint") | {
        "lang": "string", "phrase": "string"
    }


def test_numbers_of_pieces(monkeypatch):
    text = "One, two\tTWO\x0b\x0cone \xe9.".encode("latin-1").decode("latin-1").encode()
    numbers = collocations._Numbers()
    whole = collocations.numbered(text, numbers)
    assert whole.tolist() == [1, 0, 2, 2, 0, 0, 1, 3, 0, 0]
    monkeypatch.setattr(collocations, "_RUN_BYTES", 3)
    assert collocations.numbered(text, collocations._Numbers()).tolist() == whole.tolist()


def test_sums_past_64_bits(spark):
    big = 4 * 10**12
    rows = [("en", "a b", 2, big, ["a", "b"])]
    candidates = spark.createDataFrame(rows, "lang string, phrase string, words int, n bigint, parts array<string>")
    frequent = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big * 2)], "lang string, phrase string, n bigint")
    found = collocations._scored(candidates, frequent).first()
    assert found.score == 2_000_000 * big // (3 * big + 1)
