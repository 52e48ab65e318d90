"""Transcripts: markers, Viterbi, blocks, rendering."""

import itertools

import numpy as np
import pytest
from documents import EXTRA

from tradewind.llm import chats

SCHEMA = "conv_id bigint, turn bigint, role string, raw string"


@pytest.mark.parametrize(
    ("line", "marker", "rest"),
    [
        ("User: hi", 2, "hi"), ("<|assistant|>", 3, ""), ("### Human:", 2, ""), ("[agent] yes", 3, "yes"),
        ("**System:** be kind", 0, "**System:** be kind"), ("SYSTEM: x", 1, "x"), ("Bob: hello", 4, "Bob: hello"),
        ("plain text", 0, "plain text"), ("", 0, ""), ("at 10:30 we met", 0, "at 10:30 we met"),
        ("http://x", 0, "http://x"),
    ],
)
def test_markers(line, marker, rest):
    assert chats.features(line)[0] == marker and chats.without_marker(line) == rest


def model(spark, rows):
    return chats.train(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "raw")


def talk(n, marked=True):
    roles = ["user", "assistant"]
    return [
        (c, t, roles[t % 2], (f"{roles[t % 2].title()}: " if marked else "") + f"Some text {c}.\nand more of it")
        for c in range(n)
        for t in range(6)
    ]


def test_decode_is_the_best_of_all_paths(spark):
    own = model(spark, talk(4))
    seen = chats._seen(["User: hi?", "and so", "Well", "Assistant: no"])
    scores, size = own.scores(seen), chats._STATES

    def value(path):
        total = own.start[path[0]] + scores[0, path[0]]
        return total + sum(own.steps[a, b] + scores[k, b] for k, (a, b) in enumerate(itertools.pairwise(path), 1))

    best = max(itertools.product(range(size), repeat=4), key=value)
    last = int(own.block(seen)[size].argmax())
    assert own.decode(seen, size, last) == list(best)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", ("User: " if t % 2 == 0 else "Assistant: ") * (t % 5 > 0) + f"Text {t}.\nmore") for t in range(60)]
    own, df = model(spark, rows), spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, chats.parse(df, own).collect()))
    monkeypatch.setattr(chats, "BLOCK_TURNS", 7)
    assert sorted(map(tuple, chats.parse(df, own).collect())) == whole
    assert len({r[1] for r in whole}) == 60


@pytest.mark.parametrize("turn", [None, 5])
def test_a_crowded_turn_is_cut_into_places(spark, monkeypatch, turn):
    """Many rows of one turn or none, a third of them equal: as one Viterbi over all, in small places."""
    monkeypatch.setattr(chats, "BLOCK_TURNS", 8)
    monkeypatch.setattr(chats, "CROWDED", 40)
    texts = [f"{'User: ' if k % 3 else 'Well, '}{k} and some more?\nso" for k in range(150)] + ["Assistant: yes"] * 75
    rows = [(None, turn, None, x) for x in texts] + [(None, t, None, f"User: {t}") for t in range(-3, 12)] + talk(3)
    df, own = spark.createDataFrame(rows, SCHEMA), model(spark, talk(6))
    noise = np.random.default_rng(1)  # so that no two paths are equally good
    own.steps += 0.01 * noise.random(own.steps.shape)
    own.emit += 0.01 * noise.random(own.emit.shape)

    placed = chats._placed(df.selectExpr(
        "conv_id IS NOT NULL AS known", "coalesce(string(conv_id), '') AS conv", "coalesce(floor(turn / 8), -1) AS block",
        "xxhash64(raw) AS tie", "conv_id", "turn", "raw",
    ))
    assert placed.count() == len(rows)
    assert max(n for *_, n in placed.groupBy(*chats._PLACE).count().collect()) <= 40

    ties = {r.raw: r.tie for r in df.selectExpr("raw", "xxhash64(raw) AS tie").distinct().collect()}
    many = {x for x in texts if texts.count(x) > 8}
    place = lambda t: -100 if t is None else t
    alone = sorted((r for r in rows if r[0] is None), key=lambda r: (place(r[1]), r[3] in many, ties[r[3]]))
    lines = [r[3].split("\n") for r in alone]
    seen = np.concatenate([chats._seen(x) for x in lines])
    states = own.decode(seen, chats._STATES, int(own.block(seen)[chats._STATES].argmax()))
    wanted, start = [], 0
    for (_, t, _, _), x in zip(alone, lines, strict=True):
        for k, (state, part) in enumerate(chats._turns(x, states[start : start + len(x)])):
            wanted.append((place(t), k, chats.ROLES[state % 3], state >= 3, len(part)))
        start += len(x)
    found = chats.parse(df, own).where("conv_id IS NULL").collect()
    assert sorted((place(r.turn), *r[2:6]) for r in found) == sorted(wanted)


def test_roles_and_rendering(spark):
    rows = talk(5)
    found = sorted(chats.parse(spark.createDataFrame(rows, SCHEMA), model(spark, rows)).collect())
    assert [(r.conv_id, r.turn, r.role) for r in found] == [r[:3] for r in rows]
    assert found[0].rendered == "<|user|>\nSome text 0.\nand more of it"
    assert not any(r.continues for r in found) and all(r.n_lines == 2 for r in found)


def test_an_unmarked_turn_starts_where_its_first_line_says_so(spark):
    rows = talk(40, marked=True) + [(100 + c, t, r, raw.split(": ", 1)[1]) for c, t, r, raw in talk(40)]
    found = chats.parse(spark.createDataFrame(rows, SCHEMA), model(spark, rows)).collect()
    roles = {(r.conv_id, r.turn): r.role for r in found if r.segment == 0}
    right = [roles[c, t] == r for c, t, r, _ in rows]
    assert sum(right) / len(right) > 0.95


def test_held_out_accuracy(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    raw = chats.raw_transcripts(turns)
    own = chats.train(raw.where("conv_id % 2 = 0"), "conv_id", "turn", "role", "raw")
    found = chats.parse(raw.where("conv_id % 2 = 1"), own).where("segment = 0")
    joined = found.withColumnRenamed("role", "found").join(turns, ["conv_id", "turn"])
    right, n = joined.selectExpr("count_if(found = role)", "count(*)").first()
    assert n > 30 and right / n > 0.85


def test_edges(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "x"), (1, None, "narrator", "A: b"), (1, 2, "user", ""),
        (1, 2, "user", ""), (1, 2, "user", "User: tie"), (2, -5, "system", "\n\n"), (3, 1, None, "x" * 100_000),
        (3, 2**40, "user", "line\n" * 3000),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"'x' AS {c}" for c in (*EXTRA, "known", "conv", "seen", "segment")))
    found = chats.parse(df, chats.train(df, "conv_id", "turn", "role", "raw")).collect()
    assert {(r.conv_id, r.turn) for r in found} == {r[:2] for r in rows}
    assert sum(r.n_lines for r in found) >= 3000 and all(r.role in chats.ROLES for r in found)


def test_repeated_turns_share_the_transitions(spark, monkeypatch):
    """Rows of one turn number count once for each row after them, not with each row before."""
    monkeypatch.setattr(chats, "Model", lambda follows, lines: follows)
    rows = [(None, 0, chats.ROLES[0], "a")] * 30 + [(None, 0, chats.ROLES[1], "b")] * 10
    rows += [(None, 1, chats.ROLES[1], "c")] * 8
    rows += [(1, 0, chats.ROLES[0], "a"), (1, 1, chats.ROLES[1], "b")]
    follows = model(spark, rows)
    assert follows[0, 1] == 8 * 0.75 + 1 and follows[1, 1] == 8 * 0.25
    assert follows[-1].tolist()[:2] == [31, 10] and follows.sum() == len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    own = chats.train(df, "conv_id", "turn", "role", "raw")
    assert chats.parse(df, own).count() == 0 and np.isfinite(own.emit).all()
