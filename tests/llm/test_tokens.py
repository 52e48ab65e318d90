"""Encoding, decoding and counting against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from documents import edges, frame
from tokenizers import Tokenizer

from tradewind.llm import bpe, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def some_texts(n=3000):
    draw = random.Random(5)
    letters = "abAB c'st <|>é́Σσ1٣  İßÑ中!!##\n\t\x1c\x00\x7f\x85\xa0ñ \U0001F600क़\u0378ſ'LL"
    ends = ["", "<|endoftext|>", "aaaaaaa", "<|startoftext|>x", "<|endoftext|", "'ll've", "x" * 300]
    return ["".join(draw.choices(letters, k=draw.randint(0, 60))) + draw.choice(ends) for _ in range(n)]


def test_ids_and_decoding_equal_the_library():
    texts = some_texts()
    own = bpe.PairIndexEncoder(PATH)
    ids = own.encode_texts([t.encode() for t in texts])
    for text, found, decoded in zip(texts, ids, own.decode(ids), strict=True):
        expected = library_ids(text)
        assert np.frombuffer(found, "<u4").tolist() == expected, text
        assert decoded.decode() == LIBRARY.decode(expected, skip_special_tokens=False)


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(token_counts, "CACHED_WORDS", 5)
    monkeypatch.setattr(token_counts, "CALL_BYTES", 10)
    own, counter = bpe.PairIndexEncoder(PATH), token_counts.TokenCounter(PATH)
    for text in some_texts(200):
        expected = library_ids(text)
        assert np.frombuffer(own.encode_texts([text.encode()])[0], "<u4").tolist() == expected
        assert counter.count([text.encode()]) == [len(expected)]
    assert len(counter._cache) <= 5
    most = max(len(set(t.split())) for t in some_texts(200))
    assert len(own._words._new) + len(own._words._old) <= 2 * (5 // 2 + most)


def test_what_was_met_last_is_kept():
    made = []
    recent = bpe.Recent(4)

    def find(keys):
        made.extend(keys)
        return [str(k).encode() for k in keys]

    for turn in range(50):
        table = recent.look_up({"often", turn}, find)
        assert table["often"] == b"often" and table[turn] == str(turn).encode()
    assert made.count("often") == 1 and len(recent._new) + len(recent._old) <= 8


@pytest.mark.parametrize("texts", [[], [b""], [b" \n", b"", b" a  b\x0b\x0cc\r\n", "\u2028x\x85y\x1cz".encode()]])
def test_white_space_at_all_places(texts):
    own = bpe.PairIndexEncoder(PATH)
    found = [np.frombuffer(x, "<u4").tolist() for x in own.encode_texts(texts)]
    assert found == [library_ids(t.decode()) for t in texts]


@pytest.mark.parametrize("text", ["aaaaa", "aaaaaaaa", "abababab", "thethethe", "…………", "!!!!!!!"])
def test_overlapping_pairs_merge_from_the_left(text):
    own = bpe.PairIndexEncoder(PATH)
    assert np.frombuffer(own.encode_texts([text.encode()])[0], "<u4").tolist() == library_ids(text)


def test_documents(spark):
    rows = edges()
    encoded = bpe.encode_documents(frame(spark, rows, extra=True), PATH, with_ids=True).collect()
    assert len(encoded) == len(rows)
    for r in encoded:
        expected = library_ids(r.text)
        assert r.ids == expected and r.n_tokens == len(expected)
        packed = np.array(expected, "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        decoded = LIBRARY.decode(expected, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_counts(spark):
    rows = edges()
    found = token_counts.count_tokens(frame(spark, rows, extra=True), PATH, limit=100).collect()
    expected = []
    for doc_id, text, *_ in rows:
        n = len(library_ids(text))
        expected.append((doc_id, len((text or "").encode()), n, n > 100))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_empty_table(spark):
    empty = frame(spark, edges()).limit(0)
    assert bpe.encode_documents(empty, PATH).count() == 0
    assert token_counts.count_tokens(empty, PATH).count() == 0
