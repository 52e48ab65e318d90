"""Quality rules: base rules, then robust multivariate outliers.

Documents that pass the base rules get a vector of transformed statistics. For each language
and source the minimum covariance determinant (MCD) estimate gives a center and a scatter that
outliers cannot pull away; a document is rejected if its Mahalanobis distance is too large.

Statistics are whole multiples of 1/1024 and moments are sums of longs, so results do not depend
on the order of rows. Each concentration step is one aggregation over all rows: distances fall
into narrow bins, moments are summed by bin, and the bins of the smallest distances that hold
three quarters of the rows are added up.

Defined cases: null and empty texts have no words and fail the base rules. Null languages and
sources are values like any other. Rows are judged one by one, so repeated rows get the same
verdict. Groups of fewer than ``min_rows`` rows are judged together with the other small groups
of their language, then of the corpus; where even these are too few only the base rules count.
"""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import column_bytes, store, text_pieces

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Smallest standard deviation taken for each statistic of the vector, in its own unit. Most
#: documents of a group may share one value, and a single symbol is no outlier.
FLOORS = {"word_length": 0.2, "symbols": 0.4, "dup_lines": 1.25, "repeats": 1.0}
DIMS = len(FLOORS)
SCALE = 1024  # statistics are whole multiples of 1 / SCALE
KEPT_SHARE = 0.75  # rows that a concentration step keeps
STEPS = 4
REJECT_AT = 1e-5  # chance that a document as its group's best fit is rejected
MIN_ROWS = 50
_BINS_PER_DOUBLING = 16

# The characters of the symbol count, the least words, the repeat limit.
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_LEAST_WORDS = 20
_MOST_REPEATED_PERCENT = 30
_WINDOW = 8


def text_counts(text: bytes) -> tuple[int, ...]:
    """The base counts of one text, in the order of ``COUNTS``."""
    words = text.split()
    bare = text.translate(None, _SPACES)
    word_chars = len(bare) if bare.isascii() else len(bare.decode())
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows that are found twice or more."""
    windows = list(zip(*(words[i:] for i in range(_WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    starts = set()
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            starts.update((i, j))
    covered, reached = 0, 0
    for i in sorted(starts):
        covered += i + _WINDOW - max(i, reached)
        reached = i + _WINDOW
    return covered


def add_counts(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs``, without the text if it is not asked for, and the base counts."""
    others = [c for c in docs.columns if c not in COUNTS and (keep_text or c != text)]
    schema = T.StructType(
        [*docs.select(others).schema, *(T.StructField(c, T.LongType()) for c in COUNTS)]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_pieces(batch, text, 4 << 20):
                counts = [text_counts(t) for t in column_bytes(part, text)]
                arrays = [part.column(c) for c in others]
                arrays += [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [*others, *COUNTS])

    return docs.select(*dict.fromkeys([*others, text])).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < _LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > _MOST_REPEATED_PERCENT * F.col("n_words")
    )


def statistics() -> list[Column]:
    """The vector: logarithms, so that a ratio counts alike at either end."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    values = {
        "word_length": F.log(chars / words),
        "symbols": F.log1p(100 * F.col("n_symbols") / chars),
        # Of words, for the number of lines is not counted; a line holds about ten.
        "dup_lines": F.log1p(1000 * F.col("n_dup_lines") / words),
        "repeats": F.log1p(100 * F.col("n_repeat_words") / words),
    }
    return [F.rint(v * SCALE).cast("bigint").alias(f"x{i}") for i, v in enumerate(values.values())]


def judge(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """One row per document: the columns of ``keep``, the base counts, base_failed, kept, and
    the squared distance (null where the method did not judge)."""
    own = docs.select(
        *[docs[c].alias(f"k{i}") for i, c in enumerate(keep)],
        docs[lang].cast("string").alias("lang"),
        docs[source].cast("string").alias("source"),
        docs[text].alias("text"),
    )
    rows = store(add_counts(own), "counts")
    return apply(rows, *estimate(rows, min_rows)).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        *COUNTS, "base_failed", "kept", "distance",
    )


def kept_documents(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of ``docs`` (text, lang, source and others) that are kept.

    Counts are taken twice, for the estimates and for the verdicts: that moves no text.
    """
    names = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values())
    groups = [F.col(names[c]).cast("string").alias(c) for c in ("lang", "source")]
    body = F.col(names["text"]).alias("text")
    rows = store(add_counts(own.select(*groups, body)), "counts")
    counted = add_counts(own.select("*", *groups, body.alias("text")))
    judged = apply(counted, *estimate(rows, min_rows)).where("kept")
    return judged.select([F.col(k).alias(c) for c, k in names.items()])


def estimate(rows: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """Which group a language and source is judged in, and each group's center and scatter.

    Documents that fail the base rules do not shape what is normal.
    """
    sound = rows.where(~base_failed())
    groups = _groups(sound, min_rows)
    vectors = _with_group(sound, groups).where("grp IS NOT NULL")
    return groups, fit(store(vectors.select("grp", *statistics()), "vectors"))


def apply(rows: DataFrame, groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """Add base_failed, distance and kept to counted rows."""
    named = _with_group(rows.withColumn("base_failed", base_failed()), groups)
    judged = named.select("*", *statistics()).join(
        estimates.withColumnRenamed("grp", "of"), F.col("grp") == F.col("of"), "left"
    )
    limit = F.lit(_chi2_quantile(DIMS, 1 - REJECT_AT))
    return judged.withColumn("distance", F.when(~F.col("base_failed"), _distance())).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))
    )


_XS = [f"x{i}" for i in range(DIMS)]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _groups(sound: DataFrame, min_rows: int) -> DataFrame:
    """``grp`` by language and source: itself, or what a small one is judged with, or null."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    cells = sound.groupBy(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"))
    cells = store(cells.agg(F.count("*").alias("n")), "cells")
    small = cells.where(F.col("n") < min_rows)
    by_lang = small.groupBy(F.col("of_lang").alias("small_lang")).agg(F.sum("n").alias("n_lang"))
    rest = by_lang.where(F.col("n_lang") < min_rows).agg(F.sum("n_lang")).first()[0] or 0
    group = (
        F.when(F.col("n") >= min_rows, F.concat(name("of_lang"), F.lit("\n"), name("of_source")))
        .when(F.col("n_lang") >= min_rows, F.concat(name("of_lang"), F.lit("\n")))
        .when(F.lit(rest >= min_rows), F.lit(""))
    )
    placed = cells.join(by_lang, F.col("of_lang").eqNullSafe(F.col("small_lang")), "left")
    return store(placed.select("of_lang", "of_source", group.alias("grp")), "groups")


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(
        F.col("of_source")
    )
    return rows.join(groups, same, "left").drop("of_lang", "of_source")


def fit(vectors: DataFrame) -> DataFrame:
    """The MCD estimate of each group: ``grp``, center m*, and inverse scatter p*_*."""
    estimates = _starts(vectors)
    for step in range(STEPS):
        moments = _nearest_moments(vectors.join(estimates, "grp"))
        estimates = store(_estimates(moments, KEPT_SHARE), f"step{step}")
    # The start that ended with the smallest determinant; ties go to the first.
    best = estimates.groupBy("grp").agg(F.min(F.struct("det", "start")).alias("best"))
    best = best.select("grp", F.col("best.start").alias("start"))
    chosen = store(estimates.join(best, ["grp", "start"]), "mcd")
    # Reweighting: the usual estimates over all rows that are no outliers at 2.5 per cent.
    within = vectors.join(chosen, "grp").where(_distance() <= _chi2_quantile(DIMS, 0.975))
    moments = within.groupBy("grp", "start").agg(*_sums())
    return store(_estimates(moments, 0.975).drop("start", "det"), "reweighted")


def _sums() -> list[Column]:
    return [
        F.count("*").alias("n"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_XS)],
        *[F.sum(F.col(_XS[i]) * F.col(_XS[j])).alias(f"s{i}_{j}") for i, j in _PAIRS],
    ]


_SUMS = ["n", *(f"s{i}" for i in range(DIMS)), *(f"s{i}_{j}" for i, j in _PAIRS)]


def _distance() -> Column:
    z = [F.col(x) / SCALE - F.col(f"m{i}") for i, x in enumerate(_XS)]
    terms = [(1 if i == j else 2) * F.col(f"p{i}_{j}") * z[i] * z[j] for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _nearest_moments(joined: DataFrame) -> DataFrame:
    """Sums over the rows of smallest distance, by group and start."""
    per_bin = F.floor(_BINS_PER_DOUBLING * F.log2(F.greatest(_distance(), F.lit(0.0)) + 2.0**-10))
    bins = joined.withColumn("bin", per_bin).groupBy("grp", "start", "bin").agg(*_sums())
    # A group has a few hundred bins, whatever its rows.
    own = Window.partitionBy("grp", "start")
    before = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    nearest = (
        bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("all", F.sum("n").over(own))
        .where(F.col("before") < KEPT_SHARE * F.col("all"))
    )
    return nearest.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _estimates(moments: DataFrame, share: float) -> DataFrame:
    """Center and inverse scatter from sums, made consistent for the share of rows they hold."""
    quantile = _chi2_quantile(DIMS, share)
    factor = share / _chi2_below(DIMS + 2, quantile)
    floors = np.diag(np.square(list(FLOORS.values())))
    names = [
        "grp", "start", "det", *(f"m{i}" for i in range(DIMS)), *(f"p{i}_{j}" for i, j in _PAIRS)
    ]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.itertuples(index=False):
                sums = dict(zip(frame.columns, row, strict=True))
                n = int(sums["n"])
                center = np.array([int(sums[f"s{i}"]) for i in range(DIMS)]) / n / SCALE
                scatter = np.empty((DIMS, DIMS))
                for i, j in _PAIRS:
                    mean = int(sums[f"s{i}_{j}"]) / n / SCALE**2
                    scatter[i, j] = scatter[j, i] = mean - center[i] * center[j]
                scatter = factor * scatter + floors
                inverse = np.linalg.inv(scatter)
                found.append(
                    [
                        sums["grp"], sums["start"], float(np.linalg.det(scatter)), *center,
                        *(inverse[i, j] for i, j in _PAIRS),
                    ]
                )
            yield pd.DataFrame(found, columns=names)

    schema = ", ".join(["grp string", "start int", *(f"{c} double" for c in names[2:])])
    return moments.mapInPandas(run, schema)


def _starts(vectors: DataFrame) -> DataFrame:
    """Two deterministic starts per group: quartile scales alone, and with spatial signs."""
    dims = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(x).alias("x")) for i, x in enumerate(_XS)]))
    # 64 bins a unit: a few hundred values at most of each statistic.
    counts = (
        vectors.select("grp", dims.alias("d"))
        .groupBy("grp", F.col("d.dim").alias("dim"), F.floor(F.col("d.x") / 16).alias("v"))
        .agg(F.count("*").alias("n"))
    )
    own = Window.partitionBy("grp", "dim")
    upto = own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    share = counts.select(
        "grp", "dim", (F.col("v") / 64).alias("v"),
        (F.sum("n").over(upto) / F.sum("n").over(own)).alias("p"),
    )
    at = lambda q: F.min(F.when(F.col("p") >= q, F.col("v")))
    marks = share.groupBy("grp", "dim").agg(
        at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("sd")
    )
    floor = F.element_at(F.lit(list(FLOORS.values())), F.col("dim") + 1)
    marks = marks.withColumn("sd", F.greatest(F.col("sd"), floor))
    pick = lambda i, c: F.max(F.when(F.col("dim") == i, F.col(c)))
    diagonal = marks.groupBy("grp").agg(
        *[pick(i, "mid").alias(f"m{i}") for i in range(DIMS)],
        *[pick(i, "sd").alias(f"d{i}") for i in range(DIMS)],
    )
    diagonal = store(diagonal, "marks")
    plain = diagonal.select(
        "grp", F.lit(0).alias("start"), F.lit(0.0).alias("det"), *[f"m{i}" for i in range(DIMS)],
        *[
            (F.lit(1.0) / F.col(f"d{i}") ** 2 if i == j else F.lit(0.0)).alias(f"p{i}_{j}")
            for i, j in _PAIRS
        ],
    )
    # Spatial signs: each row's direction from the center counts, not its distance.
    z = [(F.col(x) / SCALE - F.col(f"m{i}")) / F.col(f"d{i}") for i, x in enumerate(_XS)]
    norm = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    signs = vectors.join(diagonal, "grp").select(
        "grp",
        *[
            F.rint(F.coalesce(v / F.nullif(norm, F.lit(0.0)), F.lit(0.0)) * SCALE).cast("bigint").alias(x)
            for v, x in zip(z, _XS, strict=True)
        ],
    )
    signed = signs.groupBy("grp").agg(*_sums())
    names = plain.columns

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.itertuples(index=False):
                sums = dict(zip(frame.columns, row, strict=True))
                d = np.array([sums[f"d{i}"] for i in range(DIMS)])
                scatter = np.empty((DIMS, DIMS))
                for i, j in _PAIRS:
                    mean = int(sums[f"s{i}_{j}"]) / int(sums["n"]) / SCALE**2
                    scatter[i, j] = scatter[j, i] = DIMS * mean * d[i] * d[j]
                scatter += np.diag(np.square(list(FLOORS.values())))
                inverse = np.linalg.inv(scatter)
                found.append(
                    [sums["grp"], 1, 0.0, *(sums[f"m{i}"] for i in range(DIMS)), *(inverse[i, j] for i, j in _PAIRS)]
                )
            yield pd.DataFrame(found, columns=names)

    return store(plain.unionByName(signed.join(diagonal, "grp").mapInPandas(run, plain.schema)), "starts")


def _chi2_below(dims: int, x: float) -> float:
    """Probability that a chi-square value is below x: the series of the incomplete gamma."""
    a, half = dims / 2, x / 2
    term = total = 1 / a
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= half / (a + k)
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a))) if x > 0 else 0.0


def _chi2_quantile(dims: int, p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_below(dims, mid) < p else (low, mid)
    return high
