"""Small corpora with every edge, and brute-force forms of what the operators compute."""

import random
from collections import Counter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names the operators use inside.
EXTRA = (
    "body", "core", "n", "node", "k0", "k1", "grp", "size", "chance", "hi", "lo", "spans",
    "copies", "ids", "shard", "tie", "packed", "others", "block", "distance", "n_words", "salt",
    "place", "kept", "name", "of", "start", "x0", "count",
)


def prose(seed, words=60, letters="abcdefgh"):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(letters, k=draw.randint(2, 8))) for _ in range(words))


def corpus(n=60, seed=0):
    """Rows of (doc_id, text, lang, source, n_chars)."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(f"{seed} {i}", draw.randint(20, 120))
        # A third of all rows has one source.
        rows.append((i, text, draw.choice(["en", "de"]), "hot" if i % 3 == 0 else f"s{i % 4}"))
    return [(*r, len(r[1])) for r in rows]


def edges():
    """Nulls in every column, empty and wordless texts, copies, repeated rows, one long text."""
    long = prose("long", 40_000)
    rows = corpus(40)
    rows += [(100 + i, rows[3][1], "en", f"s{i}") for i in range(4)]
    rows += [
        (200, None, "en", "s1"), (201, "", "en", "s1"), (202, " \n\t ", None, None),
        (None, prose("a"), "en", "s1"), (None, prose("b"), None, "s1"), (None, None, None, None),
        (203, "one", "en", "s1"), (204, "one two three four", "de", None),
        (205, long, "en", "hot"), (206, "x" * 5000, "en", "s2"), (207, "é" * 300 + " 中文", "zh", "s2"),
        (3, prose("other text of the same id"), "en", "s1"),
    ]
    rows += [rows[5], rows[5], rows[6]]
    return [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]


def frame(spark, rows, extra=False, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if extra:
        df = df.selectExpr("*", *(f"concat('x', doc_id) AS {c}" for c in EXTRA))
    return df


def same_rows(a, b):
    return Counter(map(tuple, a)) == Counter(map(tuple, b))
