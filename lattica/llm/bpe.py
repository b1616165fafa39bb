"""Byte-level BPE of a whole corpus with a public vocabulary.

A text is split by the vocabulary's pattern into words; each distinct word is merged once per task and
remembered up to a bound. Merging keeps the symbols of a word in a doubly linked list and the ranks of
neighbouring pairs in a priority queue; an entry whose symbols have changed since it was pushed is
stale and skipped, so a word of n bytes costs O(n log n) however long it is. Decoding concatenates the
vocabulary's byte strings.

Defined cases: null and empty texts have the empty list of ids (one row all the same); blank texts
encode as any other text. Text that looks like a special token is ordinary text. Very long texts and words
without any space are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary file above this size is refused rather than broadcast.
MAX_FILE_BYTES = 64 << 20
REMEMBERED = 1_000_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Byte string to rank, which is its id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    symbol: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, j, size = heapq.heappop(queue)
        a, b = symbol[i], symbol[j]
        # Stale: one of the two is gone, or has grown since.
        if a is None or b is None or right[i] != j or len(a) + len(b) != size:
            continue
        symbol[i], symbol[j] = a + b, None
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get(symbol[i] + symbol[k])) is not None:
                heapq.heappush(queue, (r, i, k, len(symbol[i]) + len(symbol[k])))
        if (h := left[i]) >= 0 and (r := ranks.get(symbol[h] + symbol[i])) is not None:
            heapq.heappush(queue, (r, h, i, len(symbol[h]) + len(symbol[i])))
    return [ranks[s] for s in symbol if s is not None]


class Words(dict):
    """Word to ids, merged on first use; forgets everything at the bound."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = tuple(merge_word(word.encode("utf-8"), self.ranks))
        return ids


class Encoder:
    """Text to ids and back."""

    def __init__(self, data: bytes):
        self.ranks = read_ranks(data)
        self.words, self.split = Words(self.ranks), regex.compile(PATTERN).findall
        self.strings = None

    def encode(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.words.__getitem__, self.split(text))), np.int32) if text else np.empty(0, np.int32)

    def decode(self, ids) -> str:
        if self.strings is None:
            self.strings = {i: s for s, i in self.ranks.items()}
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8")


def _file(spark, path: str | None):
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str, text: str, path: str | None = None, ids: str = "ids") -> DataFrame:
    """(key, ids): one row per row of `df`; no shuffle."""
    shipped = _file(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Encoder(shipped.value)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                done = [coder.encode(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(done) + 1, np.int32)
                np.cumsum([len(d) for d in done], out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(done) if done else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, ids])

    src = df.select(F.col(key), F.col(text))
    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, {ids} array<int>")


def decode(df: DataFrame, key: str, ids: str, path: str | None = None, text: str = "text") -> DataFrame:
    """(key, text): the texts of lists of ids; a null list gives a null text."""
    shipped = _file(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Encoder(shipped.value)
            texts = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, text])

    src = df.select(F.col(key), F.col(ids))
    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, {text} string")
