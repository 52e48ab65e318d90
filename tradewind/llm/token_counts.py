"""Token counts by the tokenizers library, lengths only.

Texts are cut at ASCII white space, which no token of this kind of tokenizer spans, so long
texts never reach the library whole. The distinct words of a batch of texts are encoded in
calls of about equal bytes, and a text's count is the sum over its words.

Null text counts as empty: no bytes, no tokens. A run of text without white space is one word,
whatever its length.
"""

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind.llm.common import column_bytes, text_pieces

CACHED_WORDS = 400_000  # words whose counts a Python worker keeps from batch to batch
BATCH_BYTES = 8 << 20  # text taken apart at a time
CALL_BYTES = 256 << 10  # words given to the library in one call


class TokenCounter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._cache: dict[bytes, int] = {}

    def count(self, texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]
        cache = self._cache
        new = list(set().union(*words).difference(cache))
        for call in self._calls(new):
            found = self._library.encode_batch_fast(
                [w.decode() for w in call], add_special_tokens=False
            )
            cache.update(zip(call, map(len, found), strict=True))
        counts = [sum(map(cache.__getitem__, w)) for w in words]
        for word in new[max(0, CACHED_WORDS - len(cache) + len(new)) :]:
            del cache[word]
        return counts

    @staticmethod
    def _calls(words: list[bytes]) -> Iterator[list[bytes]]:
        call, size = [], 0
        for word in words:
            if call and size + len(word) > CALL_BYTES:
                yield call
                call, size = [], 0
            call.append(word)
            size += len(word)
        if call:
            yield call


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One per Python worker and tokenizer file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether there are more than ``limit`` tokens, per row."""
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    kinds = [docs.schema[doc_id].dataType, T.LongType(), T.LongType(), T.BooleanType()]
    schema = T.StructType(list(map(T.StructField, names, kinds)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_pieces(batch, "text", BATCH_BYTES):
                texts = column_bytes(part, "text")
                n = counter(tokenizer_path).count(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(map(len, texts), pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names,
                )

    chosen = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return chosen.mapInArrow(run, schema)
