"""Chat formatting: roles recovered from raw transcripts, then turns in one canonical form.

A transcript is a sequence of lines. A hidden Markov model has a state for the first line of a
turn of each role and one for its further lines; it sees of each line the kind of speaker marker
and a few features. Its probabilities are counted over labelled turns. Viterbi finds the most
likely states of all lines, so a turn without a marker gets its role from its neighbours.

Conversations may be of any length. Blocks of ``BLOCK_TURNS`` turns are summed up as matrices of
best scores from the state before to the state at the end; per conversation only these are
scanned to find the states between blocks, and each block is then decoded by itself. A block of
more than ``CROWDED`` rows, where many have one turn number or none, is cut further: by turn, then
by ranges of a hash of the text, and equal rows are counted and dealt out by their number.

Defined cases: null ids make one conversation, null turns come first, null text is one empty
line, turns of the same number follow each other in order of a hash of their text; in a crowded
block texts with more than ``BLOCK_TURNS`` copies under a turn come after its others. An unlabelled
turn trains nothing. Without any labelled turn all probabilities are even.
"""

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import row_key, store

ROLES = ("system", "user", "assistant")
BLOCK_TURNS = 256
CROWDED = 8 * BLOCK_TURNS
# Names under which speakers appear, by role.
SPEAKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a"),
}
_ROLE_OF = {name: ROLES.index(role) for role, names in SPEAKERS.items() for name in names}
# <|name|>, [name], ### name: or name: at the start of a line.
_MARKER = re.compile(
    r"\s*(?:<\|([A-Za-z]+)\|>|\[([A-Za-z]+)\]|(?:#+\s*|\*\*)?([A-Za-z]+)(?:\*\*)?\s*:)(?:\s+|$)"
)
_STATES = 2 * len(ROLES)  # first line of a turn, then further line, by role
# Values of each feature: marker (none, the roles, another name), length, question, lower case.
_SIZES = (2 + len(ROLES), 4, 2, 2)
_OFFSETS = (0, *np.cumsum(_SIZES)[:-1].tolist())
_VALUES = sum(_SIZES)


def features(line: str) -> tuple[int, ...]:
    found = _MARKER.match(line)
    marker = 0
    if found:
        name = next(g for g in found.groups() if g).lower()
        marker = 1 + _ROLE_OF.get(name, len(ROLES))
    text = line[found.end() :] if found else line
    length = (len(text) > 0) + (len(text) > 40) + (len(text) > 200)
    return marker, length, text.rstrip().endswith("?"), text[:1].islower()


def without_marker(line: str) -> str:
    found = _MARKER.match(line)
    return line[found.end() :] if found and features(line)[0] <= len(ROLES) else line


def _seen(lines: list[str]) -> np.ndarray:
    """A row per line: the places of its feature values."""
    return np.array([features(x) for x in lines], np.int64) + np.array(_OFFSETS)


class Model:
    """Log probabilities: of the first state, of steps, and of feature values by state."""

    def __init__(self, turns: np.ndarray, lines: np.ndarray):
        """``turns``: how often role j follows role i, the last row how often it opens.
        ``lines``: how often a state has a feature value."""
        opens, follows = turns[-1] + 1.0, turns[:-1] + 1.0
        counts = np.stack([lines[s, : _SIZES[0]].sum() for s in range(_STATES)]) + 1.0
        first, further = counts[: len(ROLES)], counts[len(ROLES) :]
        goes_on = further / (first + further)
        steps = np.zeros((_STATES, _STATES))
        for role in range(len(ROLES)):
            for state in (role, role + len(ROLES)):
                steps[state, : len(ROLES)] = (1 - goes_on[role]) * follows[role] / follows[role].sum()
                steps[state, role + len(ROLES)] = goes_on[role]
        start = np.r_[opens / opens.sum(), np.zeros(len(ROLES))]
        emit = lines + 0.5
        for offset, size in zip(_OFFSETS, _SIZES, strict=True):
            part = emit[:, offset : offset + size]
            part /= part.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            self.start, self.steps, self.emit = np.log(start), np.log(steps), np.log(emit)

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return self.emit[:, seen].sum(axis=2).T

    def block(self, seen: np.ndarray) -> np.ndarray:
        """Best score from each state before (the last row: none) to each state at the end."""
        scores = self.scores(seen)
        best = np.vstack([self.steps, self.start]) + scores[0]
        for score in scores[1:]:
            best = (best[:, :, None] + self.steps).max(axis=1) + score
        return best

    def decode(self, seen: np.ndarray, before: int, end: int) -> list[int]:
        """States of a block's lines, given the state before (or ``_STATES``) and the last."""
        scores = self.scores(seen)
        best = np.vstack([self.steps, self.start])[before] + scores[0]
        back = []
        for score in scores[1:]:
            ways = best[:, None] + self.steps
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + score
        states = [end]
        for choice in reversed(back):
            states.append(int(choice[states[-1]]))
        return states[::-1]


def train(turns: DataFrame, conv_id: str, turn: str, role: str, raw: str) -> Model:
    """Counts over all labelled turns. Where a turn number comes again in a conversation, its rows
    share the transitions of each row after them. A few hundred numbers reach the driver, and some
    for each different number of rows of one turn."""
    own = turns.select(
        *[c.alias(n) for c, n in zip(row_key(conv_id), ("known", "conv"), strict=True)],
        F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"),
        F.coalesce(F.col(raw), F.lit("")).alias("raw"),
    ).where(F.col("role").isin(*ROLES))
    # Spread by conversation and turn, so a long conversation is no hot key.
    key = ["known", "conv", "turn"]
    here = own.withColumn("turn", F.coalesce("turn", F.lit(-1))).groupBy(*key, "role").agg(F.count("*").alias("n"))
    before = here.withColumn("turn", F.col("turn") + 1).groupBy(*key).agg(
        F.collect_list(F.struct("role", "n")).alias("lasts"), F.sum("n").alias("among")
    )
    pairs = (
        here.join(before, key, "left").select("role", "n", "among", F.explode_outer("lasts").alias("last"))
        .groupBy("last.role", "role", "among").agg(F.sum(F.col("n") * F.coalesce("last.n", F.lit(1))))
    )
    shares = defaultdict(list)
    for last, next_, among, n in pairs.collect():
        shares[ROLES.index(last) if last else len(ROLES), ROLES.index(next_)].append(n / (among or 1))
    follows = np.zeros((len(ROLES) + 1, len(ROLES)))
    for at, found in shares.items():
        follows[at] = math.fsum(found)
    seen = own.select("role", "raw").mapInArrow(_count_lines, "state int, value int, n bigint")
    lines = np.zeros((_STATES, _VALUES))
    for state, value, n in seen.groupBy("state", "value").agg(F.sum("n")).collect():
        lines[state, value] = n
    return Model(follows, lines)


def _count_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros((_STATES, _VALUES), np.int64)
        rows = zip(batch.column("role").to_pylist(), batch.column("raw").to_pylist(), strict=True)
        for role, raw in rows:
            seen = _seen(raw.split("\n"))
            state = ROLES.index(role)
            np.add.at(counts[state], seen[0], 1)
            np.add.at(counts[state + len(ROLES)], seen[1:].ravel(), 1)
        state, value = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(state, pa.int32()), pa.array(value, pa.int32()), pa.array(counts[state, value])],
            ["state", "value", "n"],
        )


def parse(
    transcripts: DataFrame, model: Model, conv_id: str = "conv_id", turn: str = "turn", raw: str = "raw"
) -> DataFrame:
    """A row per recovered turn, or part of one within an input row: conv_id, turn, segment,
    role, continues (the turn began in an earlier row), n_lines, and the canonical text."""
    id_kind, turn_kind = (transcripts.schema[c].dataType.simpleString() for c in (conv_id, turn))
    rows = _placed(
        transcripts.select(
            *[c.alias(n) for c, n in zip(row_key(conv_id), ("known", "conv"), strict=True)],
            F.coalesce(F.floor(F.col(turn) / BLOCK_TURNS), F.lit(-1)).cast("bigint").alias("block"),
            F.xxhash64(raw).alias("tie"),
            F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
            F.coalesce(F.col(raw), F.lit("")).alias("raw"),
        )
    )
    order = [*_PLACE, F.asc_nulls_first("turn"), "tie"]
    codes = rows.drop("conv_id").mapInArrow(_see, f"{_PLACE_KINDS}, tie bigint, turn {turn_kind}, seen binary")
    sums = codes.repartition(*_PLACE).sortWithinPartitions(*order).mapInArrow(
        _sum_blocks(model), f"{_PLACE_KINDS}, best array<double>"
    )
    ends = sums.repartition("known", "conv").sortWithinPartitions(*_PLACE).mapInArrow(
        _scan(model), f"{_PLACE_KINDS}, before int, last int"
    )
    return (
        rows.join(store(ends, "ends"), list(_PLACE)).repartition(*_PLACE).sortWithinPartitions(*order)
        .mapInArrow(
            _render(model),
            f"conv_id {id_kind}, turn {turn_kind}, segment int, role string, continues boolean, "
            "n_lines int, rendered string",
        )
    )


# Where a row stands: its conversation and block, and within a crowded block its turn, whether its
# text is a frequent one, which, and the range of texts or of copies.
_PLACE = ("known", "conv", "block", "at", "frequent", "of", "part")
_PLACE_KINDS = "known boolean, conv string, block bigint, at bigint, frequent boolean, of bigint, part bigint"


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with their place; rows of one place are one task's, a few times ``CROWDED`` at most."""
    key = ["known", "conv", "block"]
    crowded = store(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).drop("n"), "crowded")
    zero = F.lit(0).cast("bigint")
    plain = rows.join(crowded, key, "left_anti").select(
        "*", zero.alias("at"), F.lit(False).alias("frequent"), zero.alias("of"), zero.alias("part")
    )
    # Null turns come before all others of their block.
    at = F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 63)))
    counted = store(
        rows.join(crowded, key, "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("at", at),
        "counted",
    )
    frequent = F.col("n") > BLOCK_TURNS
    # Ranges of about a block of rows each, by the hash as a share of all hashes.
    ranges = counted.where(~frequent).groupBy(*key, "at").agg(F.ceil(F.sum("n") / BLOCK_TURNS).alias("ranges"))
    share = F.col("tie") / F.lit(2.0**64) + F.lit(0.5)
    ranged = F.least(F.floor(share * F.col("ranges")), F.col("ranges") - 1)
    others = counted.where(~frequent).join(store(ranges, "ranges"), [*key, "at"]).select(
        *rows.columns, "at", F.lit(False).alias("frequent"), zero.alias("of"), ranged.alias("part"), "n"
    )
    parts = F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK_TURNS})"))
    copies = counted.where(frequent).select(
        *rows.columns, "at", F.lit(True).alias("frequent"), F.col("tie").alias("of"), parts.alias("part"), "n"
    ).withColumn("n", F.least(F.lit(BLOCK_TURNS), F.col("n") - F.col("part") * BLOCK_TURNS))
    again = F.explode(F.expr("sequence(1L, n)")).alias("copy")
    dealt = others.unionByName(copies).select("*", again).drop("n", "copy")
    return plain.unionByName(dealt)


def _see(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature places of each row's lines, one byte each, instead of its text."""
    for batch in batches:
        seen = [_seen(raw.split("\n")).astype(np.uint8).tobytes() for raw in batch.column("raw").to_pylist()]
        kept = [*_PLACE, "tie", "turn"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(seen, pa.binary())], [*kept, "seen"]
        )


def _rows_by(batches: Iterable[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[list[dict]]:
    """Lists of the rows of each key from sorted batches."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][c] != row[c] for c in key):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sum_blocks(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_by(batches, _PLACE):
            flat = np.frombuffer(b"".join(r["seen"] for r in rows), np.uint8)
            best = model.block(flat.reshape(-1, len(_SIZES)).astype(np.int64))
            place = [rows[0][c] for c in _PLACE]
            yield _batch([(*place, best.ravel().tolist())], [*_PLACE, "best"], [*_KINDS, pa.list_(pa.float64())])

    return run


_KINDS = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
    )


def _scan(model: Model):
    """States at the ends of a conversation's blocks; of each only its sums are held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_by(batches, ("known", "conv")):
            score, ways = None, []
            for row in rows:
                best = np.array(row["best"]).reshape(-1, _STATES)
                if score is None:
                    ways.append(np.full(_STATES, _STATES))
                    score = best[_STATES]
                else:
                    paths = score[:, None] + best[:_STATES]
                    ways.append(paths.argmax(axis=0))
                    score = paths.max(axis=0)
            last = int(score.argmax())
            found = []
            for row, way in zip(reversed(rows), reversed(ways), strict=True):
                found.append((*(row[c] for c in _PLACE), int(way[last]), last))
                last = int(way[last])
            yield _batch(found, [*_PLACE, "before", "last"], [*_KINDS, pa.int32(), pa.int32()])

    return run


def _render(model: Model):
    names = ["conv_id", "turn", "segment", "role", "continues", "n_lines", "rendered"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_by(_kinds_seen(batches, kinds := []), _PLACE):
            lines = [row["raw"].split("\n") for row in rows]
            seen = np.concatenate([_seen(x) for x in lines])
            states = model.decode(seen, rows[0]["before"], rows[0]["last"])
            out, at = [], 0
            for row, own in zip(rows, lines, strict=True):
                for k, (state, part) in enumerate(_turns(own, states[at : at + len(own)])):
                    role = ROLES[state % len(ROLES)]
                    goes_on = state >= len(ROLES)
                    text = "\n".join(part)
                    shown = text if goes_on else f"<|{role}|>\n{text}"
                    out.append((row["conv_id"], row["turn"], k, role, goes_on, len(part), shown))
                at += len(own)
            yield _batch(out, names, [*kinds, pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string()])

    return run


def _kinds_seen(batches: Iterable[pa.RecordBatch], kinds: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds[:] = [batch.schema.field(c).type for c in ("conv_id", "turn")]
        yield batch


def _turns(lines: list[str], states: list[int]) -> Iterator[tuple[int, list[str]]]:
    """Lines from one first line to the next, with the state of their first; markers go."""
    start = 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or states[k] < len(ROLES):
            first = without_marker(lines[start])
            # A marker on a line of its own leaves nothing.
            head = [first] if first or k == start + 1 else []
            yield states[start], [*head, *lines[start + 1 : k]]
            start = k


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, raw: turns as they stand in files, in one of four styles by
    conversation, a fifth of them without a speaker marker."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    name = lambda system, user, assistant: (
        F.when(F.col("role") == "system", system).when(F.col("role") == "user", user)
        .when(F.col("role") == "assistant", assistant)
    )
    marker = (
        F.when(style == 0, name("System: ", "User: ", "Assistant: "))
        .when(style == 1, name("<|system|>\n", "<|user|>\n", "<|assistant|>\n"))
        .when(style == 2, name("### Instructions:\n", "### Human:\n", "### AI:\n"))
        .otherwise(name("[system] ", "[customer] ", "[agent] "))
    )
    shown = F.when(bare, F.lit("")).otherwise(F.coalesce(marker, F.lit("")))
    raw = F.concat(shown, F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", "role", raw.alias("raw"))
