"""BPE encoding and decoding with an index of pair occurrences.

The distinct words of a batch are laid out as one linked list of symbols. An index maps the
rank of each mergeable pair to all its positions; the lowest active rank is applied to all its
positions at once, and the pairs this makes are added to the lists of their ranks.

Null text counts as empty and has no tokens. Every other text is encoded whole: it is cut at
ASCII white space, which no token spans, so a long text costs no more memory than its words.
"""

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind.llm.common import column_bytes, text_pieces

# Words and pieces kept from run to run, per task: those met last, and so all frequent ones. Of the
# words of a run none goes before its end.
CACHED_WORDS = 100_000
CACHED_PIECES = 100_000
RUN_BYTES = 8 << 20
_SHIFT = 20  # symbol ids are below 2 ** 20
# Words of printable Latin letters and signs, which normalization leaves as they are but for
# case, can be cut without the library.
_PLAIN = re.compile(r"[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
_END = b"\xff" * 4  # between the ids of words: no id


class Recent:
    """What was looked up last, by key: two tables, of which the older goes when the other is full."""

    def __init__(self, most: int):
        self._most = most
        self._new: dict = {}
        self._old: dict = {}

    def look_up(self, keys: set, find: Callable[[list], list[bytes]]) -> dict:
        """A table with all ``keys``; those not in it yet are found together."""
        if len(self._new) > self._most // 2:
            self._new, self._old = {}, self._new
        known, missing = self._new, keys.difference(self._new)
        again = missing.intersection(self._old)
        known.update((k, self._old[k]) for k in again)
        first = list(missing.difference(again))
        known.update(zip(first, find(first) if first else [], strict=True))
        return known


class PairIndexEncoder:
    """Encodes words as the tokenizer file says: its own normalizer, splitter and merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self._normalize = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self._suffix = model["end_of_word_suffix"]
        pairs = np.array([(self.vocab[a], self.vocab[b]) for a, b in model["merges"]], np.int64)
        self._left, self._right = pairs.T
        self._merged = np.array([self.vocab[a + b] for a, b in model["merges"]], np.int64)
        keys = (self._left << _SHIFT) | self._right
        self._rank_of_key = np.argsort(keys, kind="stable")
        self._keys = keys[self._rank_of_key]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = {t: np.uint32(i).tobytes() for t, i in special.items()}
        self._special_cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        names = {i: t for t, i in (self.vocab | special).items()}
        self.names = pa.array([names[i] for i in range(max(names) + 1)], pa.large_string())
        # Ids of the single characters that stand for bytes, inside and at the end of a piece.
        letters = [t for t in self.vocab if len(t) == 1]
        self._inside = np.full(max(map(ord, letters)) + 1, -1, np.int64)
        self._at_end = self._inside.copy()
        for t in letters:
            self._inside[ord(t)], self._at_end[ord(t)] = self.vocab[t], self.vocab[t + self._suffix]
        # A byte that is no printable Latin sign is written as another character.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        self._shown = {b: 256 + i for i, b in enumerate(others)}
        self._words = Recent(CACHED_WORDS)
        # By the text of plain pieces, and by the signs that stand for the bytes of others.
        self._plain_pieces, self._shown_pieces = Recent(CACHED_PIECES), Recent(CACHED_PIECES)

    def encode_texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        places = pc.dictionary_encode(split.flatten())
        words = places.dictionary.to_pylist()
        known = self._words.look_up(set(words), self._encode_words)
        # The ids of all words, one after the other: those of a text lie side by side.
        flat = pa.array([known[w] for w in words], pa.large_binary()).take(places.indices)
        _, ends, data = flat.buffers()
        ends = np.frombuffer(ends, np.int64, len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
        cuts = ends[split.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [data[i:j].tobytes() for i, j in itertools.pairwise(cuts)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Names of the tokens joined by blanks, special tokens included, as UTF-8.

        This is the decoding of a tokenizer file that names no decoder.
        """
        flat = np.frombuffer(b"".join(ids), "<u4")
        ends = np.cumsum([0] + [len(x) // 4 for x in ids])
        tokens = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self.names.take(flat))
        joined = pc.binary_join(tokens, pa.scalar(" ", pa.large_string()))
        return joined.cast(pa.large_binary()).to_pylist()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Plain words are cut all at once, others one by one; only distinct pieces are merged."""
        is_plain = [_PLAIN.fullmatch(w) is not None and "<|" not in w for w in words]
        plain = self._encode_plain(list(itertools.compress(words, is_plain)))
        if all(is_plain):
            return plain
        other = self._encode_other([w for w, p in zip(words, is_plain, strict=True) if not p])
        sources = (iter(other), iter(plain))
        return [next(sources[p]) for p in is_plain]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        pieces = _PIECE.findall("\n".join(words).lower() + "\n")
        known = self._plain_pieces.look_up(
            set(pieces) - {"\n"},
            lambda new: self._merge([p if p.isascii() else self._show(p) for p in new]),
        )
        known["\n"] = _END
        ids = b"".join(map(known.__getitem__, pieces))
        del known["\n"]
        ends = np.flatnonzero(np.frombuffer(ids, "<u4") == 0xFFFFFFFF) * 4
        return [ids[i:j] for i, j in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]

    def _show(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self._shown)

    def _encode_other(self, words: list[str]) -> list[bytes]:
        cut = [self._pieces(w) for w in words]
        special = self._special
        known = self._shown_pieces.look_up({p for ps in cut for p in ps}.difference(special), self._merge)
        return [b"".join([special[p] if p in special else known[p] for p in ps]) for ps in cut]

    def _pieces(self, word: str) -> list[str]:
        """Special tokens, and pieces in the signs that stand for their bytes."""
        found = []
        for part in self._special_cut.split(word):
            if part in self._special:
                found.append(part)
            elif part:
                found += [p for p, _ in self._split(self._normalize(part))]
        return found

    def _merge(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        letters = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        sym = self._inside[letters]
        last = np.cumsum(sizes) - 1
        first = last - sizes + 1
        sym[last] = self._at_end[letters[last]]
        nxt = np.arange(1, len(sym) + 1)
        prv = nxt - 2
        nxt[last], prv[first] = -1, -1

        positions: dict[int, list[np.ndarray]] = {}  # the index: rank to places of its pair
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            keys = (sym[at] << _SHIFT) | sym[nxt[at]]
            slot = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
            known = self._keys[slot] == keys
            ranks, at = self._rank_of_key[slot[known]], at[known]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(at)]
            for rank, i, j in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                part = at[i:j]
                if rank not in positions:
                    positions[rank] = []
                    heapq.heappush(active, rank)
                positions[rank].append(part)

        add(np.flatnonzero(nxt >= 0))
        while active:
            rank = heapq.heappop(active)
            at = np.sort(np.concatenate(positions.pop(rank)))
            at = at[np.diff(at, prepend=-1) > 0]
            a, b = self._left[rank], self._right[rank]
            to = nxt[at]
            at = at[(sym[at] == a) & (to >= 0) & (sym[to] == b)]
            if a == b:
                at = _without_overlaps(at, nxt)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone], nxt[at] = self._merged[rank], -1, after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            add(np.concatenate([at[after >= 0], before[before >= 0]]))

        alive = sym >= 0
        ends = np.cumsum(alive)[last] * 4
        ids = sym[alive].astype("<u4").tobytes()
        return [ids[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _without_overlaps(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of places of a pair of two equal symbols, those that merging from the left uses."""
    kept, used = [], -1
    for p in at.tolist():
        if p != used:
            kept.append(p)
            used = int(nxt[p])
    return np.array(kept, np.int64)


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """The columns of ``docs``, the number of tokens, digests of the ids and of the text that
    is decoded from them, and the ids themselves if asked for."""
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if with_ids:
        added["ids"] = T.ArrayType(T.IntegerType())
    docs = docs.select([c for c in docs.columns if c not in added])
    schema = T.StructType([*docs.schema, *(T.StructField(c, k) for c, k in added.items())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None  # freed with the task, for the worker lives on and serves other stages
        for batch in batches:
            for part in text_pieces(batch, "text", RUN_BYTES):
                own = own or PairIndexEncoder(tokenizer_path)
                ids = own.encode_texts(column_bytes(part, "text"))
                sizes = [len(x) // 4 for x in ids]
                columns = [
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids)], pa.string()),
                ]
                if with_ids:
                    ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
                    flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(ends, flat))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema.names)

    return docs.mapInArrow(run, schema)
