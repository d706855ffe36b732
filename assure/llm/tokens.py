"""Token counts: batch encoding inside Arrow functions, which return lengths only.

Texts are cut at ASCII white space, where no token of the vocabulary can begin or end inside (its tokenizer
drops white space before the merges), so a text's count is the sum over its pieces. Each piece is encoded
once for each worker's memory: what the bounded memory lacks is gathered into batches of like bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of

#: Bytes of text that are cut and encoded together.
GROUP_BYTES = 4 << 20
#: Bytes of pieces in one call of the tokenizer.
CALL_BYTES = 256 << 10
#: Bytes of pieces whose counts a worker remembers.
MEMORY_BYTES = 8 << 20


class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}
        self.room = MEMORY_BYTES

    def learn(self, pieces: set[bytes]) -> None:
        if self.room < 0:
            self.known, self.room = {}, MEMORY_BYTES
        new = sorted(pieces - self.known.keys(), key=len)
        call: list[bytes] = []
        size = 0
        for k, piece in enumerate(new):
            call.append(piece)
            size += len(piece)
            if size >= CALL_BYTES or k == len(new) - 1:
                got = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in call], add_special_tokens=False)
                self.known.update(zip(call, map(len, got)))
                self.room -= size
                call, size = [], 0

    def counts(self, texts: list[bytes]) -> list[int]:
        cut = [t.split() for t in texts]
        self.learn(set().union(*cut))
        known = self.known
        return [sum(map(known.__getitem__, words)) for words in cut]


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """One for each Python worker, which Spark uses again for later tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def groups(texts: Iterator[str], most: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts of about `most` bytes; a longer text is alone."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "replace")
        if group and size + len(b) > most:
            yield group
            group, size = [], 0
        group.append(b)
        size += len(b)
    if group:
        yield group


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text).

    A null text counts as empty: no bytes, no tokens. Whole texts of any length are counted; repeated rows
    give repeated results, an empty table an empty one; other columns are ignored.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def of_batch(batch: pa.RecordBatch) -> dict:
        counter = counter_of(path)
        size: list[int] = []
        n: list[int] = []
        for group in groups(texts_of(batch)):
            size += map(len, group)
            n += counter.counts(group)
        return {"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, of_batch, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
