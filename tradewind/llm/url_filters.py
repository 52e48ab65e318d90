"""URL filters: rules first, then naive Bayes over words segmented from hosts and paths.

Host names run words together. A unigram model, counted over all words of all pages, gives the
most likely split of each name by Viterbi; the words, those of the path and the shape of its
numbers are the tokens of a multinomial naive Bayes model, trained on all pages that a rule
decides and applied to all others.

Letters are those of any script; of a host only A-Z are lower-cased in what is returned, of the
names all are. Words and tokens stay tables. Each different name is joined to it by its substrings of up to
``HEAD`` letters, which find longer words by their first letters.

Defined cases: a null URL or one without ``://`` has an empty host and path, no tokens, and gets
the verdict of the larger class. Null pages count no words. Where no rule decides any page,
everything without a rule is allowed. Repeated rows are judged alike, and train twice.
"""

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import store

#: (verdict, host, path): fits the host and its subdomains, if the path starts so.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
HEAD = 20  # letters by which words are looked up
HELD = 50_000  # different words that a task counts at once
_UNSEEN = math.log(10)  # cost of each letter of an unknown word
# Letters of any script, with the marks that belong to them, are in words and names.
_LETTERS = r"\p{L}\p{M}"
_NAME = regex.compile(rf"[{_LETTERS}]+|[0-9]+")
_WORD = regex.compile(rf"[{_LETTERS}]+")
_TAG = regex.compile("<[^>]*>")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, capitals, capitals.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, of, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule = F.when(fits, F.lit(of + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the score of the method (null under a rule)."""
    host, path = host_and_path(pages[url].cast("string"))
    named = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.withColumn("rule", rule).withColumn("ruled", verdict)
    counts = store(word_counts(pages.select(pages[html].alias("html"))), "words")
    size = counts.agg(F.sum("n").alias("total"), F.min("n").alias("least")).first()
    words = counts.select("word", (-F.log(F.col("n") / F.lit(size.total))).alias("cost"))
    unknown = _UNSEEN + (math.log(size.total / size.least) if size.total else 0.0)
    tokens = _tokens(ruled, words, unknown)
    return _apply(ruled, tokens, _model(ruled, tokens))


def word_counts(pages: DataFrame) -> DataFrame:
    """word and n: the words of all pages, without their tags."""
    counts = pages.select("html").mapInArrow(_count_words, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they came, each once for about ``HELD`` different ones."""
    counts: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    for batch in batches:
        for html in batch.column("html").to_pylist():
            counts.update(_WORD.findall(_TAG.sub(" ", (html or "").lower())))
            if len(counts) > HELD:
                yield counted()
    yield counted()


def unigrams(pages: DataFrame) -> dict[str, float]:
    """Negative log probabilities of all words of a small table, for the driver."""
    counts = word_counts(pages).collect()
    total = sum(r.n for r in counts)
    return {r.word: -math.log(r.n / total) for r in counts}


def cheapest(name: str, known: Iterable[tuple[int, int, float]], unknown: float) -> tuple[str, ...]:
    """The cheapest split into known words (start, end, cost) and unknown letters."""
    if name.isdigit():
        return (name,)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(len(name) + 1)]
    for start, end, cost in known:
        ending[end].append((start, cost))
    best, back = [0.0], [0]
    # An unknown word costs its letters: its best start is the same for all later ends.
    cheap = (0.0, 0)
    for end in range(1, len(name) + 1):
        choices = [(cheap[0] + unknown + _UNSEEN * end, cheap[1])]
        choices += [(best[start] + cost, start) for start, cost in ending[end]]
        least, start = min(choices)
        best.append(least)
        back.append(start)
        cheap = min(cheap, (least - _UNSEEN * end, end))
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return tuple(reversed(words))


def _named_runs(host: str, path: str) -> Iterator[tuple[str, str]]:
    """Names of the host and of the path, and the shapes of numbers."""
    for kind, text in (("h", host), ("p", path)):
        for run in _NAME.findall(text.lower()):
            yield kind, "0" * len(run) if run.isdigit() else run


class Segmenter:
    """Splits names into words on one machine, with the costs of a unigram model."""

    def __init__(self, costs: dict[str, float]):
        self._costs = costs
        self._unknown = max(costs.values(), default=0.0) + _UNSEEN
        self._longest = max(map(len, costs), default=0)
        self.split = lru_cache(100_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        spans = (
            (start, end)
            for start in range(len(name))
            for end in range(start + 1, min(start + self._longest, len(name)) + 1)
        )
        known = ((i, j, self._costs[name[i:j]]) for i, j in spans if name[i:j] in self._costs)
        return cheapest(name, known, self._unknown)

    def tokens(self, host: str, path: str) -> list[str]:
        """Words and number shapes of the host and of the path."""
        return [f"{kind}:{word}" for kind, run in _named_runs(host, path) for word in self.split(run)]


def _url() -> Column:
    """A key of host and path: the path starts with the first slash."""
    return F.unhex(F.md5(F.concat("host", "path"))).alias("url")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("host", "path")), strict=True)
        found = [(i, *run) for i, row in enumerate(rows) for run in _named_runs(*row)]
        for at in range(0, len(found), 10_000):
            of, kind, name = zip(*found[at : at + 10_000], strict=True)
            kept = [batch.column(c).take(pa.array(of)) for c in ("url", "ruled", "copies")]
            texts = [pa.array(kind, pa.string()), pa.array(name, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *texts], ["url", "ruled", "copies", "kind", "name"])


def _split_names(unknown: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = []
        for name, known in zip(*(batch.column(c).to_pylist() for c in ("name", "known")), strict=True):
            spans = (
                (k["start"] - 1, k["start"] - 1 + k["size"], k["cost"])
                for k in known or ()
                if k["word"] is None or name.startswith(k["word"], k["start"] - 1)
            )
            split.append(cheapest(name, spans, unknown))
        kinds = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(split, kinds)], ["name", "words"])


def _segment(names: DataFrame, words: DataFrame, unknown: float) -> DataFrame:
    """name and its words."""
    keyed = names.withColumn("key", F.unhex(F.md5("name")))
    left = F.length("name") - F.col("start") + 1
    spans = (
        keyed.where("name NOT RLIKE '^[0-9]'")
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.length("name"))))
        .withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD), left))))
        .select("key", "start", F.col("name").substr(F.col("start"), F.col("size")).alias("head"))
    )
    looked_up = words.select(
        F.substring("word", 1, HEAD).alias("head"), F.length("word").alias("size"), "cost",
        # What goes on after its head is compared where the name is at hand.
        F.when(F.length("word") > HEAD, F.col("word")).alias("word"),
    )
    known = spans.join(looked_up, "head").groupBy("key").agg(
        F.collect_list(F.struct("start", "size", "cost", "word")).alias("known")
    )
    return keyed.join(known, "key", "left").select("name", "known").mapInArrow(
        partial(_split_names, unknown), "name string, words array<string>"
    )


def _tokens(ruled: DataFrame, words: DataFrame, unknown: float) -> DataFrame:
    """url, its verdict under a rule, its number of rows, and each of its tokens."""
    urls = ruled.groupBy("host", "path", "ruled").agg(F.count("*").alias("copies"))
    runs = urls.select(_url(), "ruled", "copies", "host", "path").mapInArrow(
        _runs, "url binary, ruled string, copies bigint, kind string, name string"
    )
    runs = store(runs, "runs")
    split = store(_segment(runs.select("name").distinct(), words, unknown), "split")
    tokens = runs.join(split, "name").select("url", "ruled", "copies", "kind", F.explode("words").alias("word"))
    return store(tokens.select("url", "ruled", "copies", F.concat_ws(":", "kind", "word").alias("token")), "tokens")


def _by_verdict(n: Column) -> list[Column]:
    return [
        F.coalesce(F.sum(F.when(F.col("ruled") == v, n)), F.lit(0)).alias(v) for v in ("block", "allow")
    ]


def _model(ruled: DataFrame, tokens: DataFrame) -> tuple[DataFrame, float]:
    """Log ratios of block to allow by token, and that of the classes."""
    rows = ruled.agg(*_by_verdict(F.lit(1))).first()
    counts = tokens.where("ruled IS NOT NULL").groupBy("token").agg(*_by_verdict(F.col("copies")))
    counts = store(counts, "token_counts")
    size = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("block", "allow")), F.count("*").alias("n")).first()
    share = lambda c: F.log((F.col(c) + 1) / F.lit(size[c] + size.n + 1))
    ratios = counts.select("token", (share("block") - share("allow")).alias("ratio"))
    return ratios, math.log((rows.block + 1) / (rows.allow + 1))


def train(labelled: DataFrame, words: dict[str, float]) -> dict[str, float]:
    """Log ratios of block to allow by token, of a small table, for the driver; under ``""`` that
    of the classes."""
    table = pa.table({"word": pa.array(list(words), pa.string()), "cost": pa.array(list(words.values()), pa.float64())})
    unknown = max(words.values(), default=0.0) + _UNSEEN
    ratios, classes = _model(labelled, _tokens(labelled, labelled.sparkSession.createDataFrame(table), unknown))
    return {r.token: r.ratio for r in ratios.collect()} | {"": classes}


def _apply(ruled: DataFrame, tokens: DataFrame, model: tuple[DataFrame, float]) -> DataFrame:
    ratios, classes = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # An exact sum, as the order of a list is not fixed.
            scores = [math.fsum([classes, *found]) for found in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(scores, pa.float64())], ["url", "sum"])

    open_tokens = tokens.where("ruled IS NULL").select("url", "token")
    found = open_tokens.join(ratios, "token").groupBy("url").agg(F.collect_list("ratio").alias("found"))
    sums = store(found.mapInArrow(run, "url binary, sum double"), "scores")
    # Only rows without a verdict have a key to join by.
    keyed = ruled.withColumn("url", F.when(F.col("ruled").isNull(), _url()))
    score = F.when(F.col("ruled").isNull(), F.coalesce("sum", F.lit(classes)))
    judged = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return keyed.join(sums, "url", "left").withColumn("score", score).select(
        "page_id", "host", "path", "rule", judged.alias("verdict"), "score"
    )
