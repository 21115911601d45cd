"""Encoding of a corpus with a public byte-pair vocabulary.

Each piece of text starts as a doubly linked list of bytes. A priority queue holds the merge rank of every adjacent
pair; the lowest rank is merged first and entries that no longer describe two live neighbours are skipped. Decoding
concatenates the vocabulary's strings.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import spread

#: Where the vocabulary files of public tokenizers lie; a parameter of every operator here.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the public pattern that splits text before the merges of the 50k vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces kept per worker; the oldest half goes when it is full. Only a matter of speed.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 40


class Bpe:
    """A byte-level byte-pair vocabulary given as the ranks of its byte strings."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pieces = regex.compile(PIECES)
        self.cache: dict[str, list[int]] = {}
        self.strings = {i: s for s, i in ranks.items()}

    @classmethod
    def parse(cls, lines: bytes) -> Bpe:
        """From the text of a rank file: base64 of the bytes, a blank and the rank, line by line."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, ranks = len(piece), self.ranks
        start = list(range(size + 1))  # where symbol i begins; it ends where its right neighbour begins
        right, left = list(range(1, size + 1)), list(range(-1, size))
        live = [True] * size
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < size:
                end = start[right[j]] if right[j] < size else size
                rank = ranks.get(piece[start[i] : end])
                if rank is not None:
                    heapq.heappush(queue, (rank, i, j, end))

        for i in range(size - 1):
            offer(i)
        while queue:
            _, i, j, end = heapq.heappop(queue)
            if not live[i] or right[i] != j or not live[j] or (start[right[j]] if right[j] < size else size) != end:
                continue  # stale: one of the two has been merged since
            live[j] = False
            right[i] = right[j]
            if right[j] < size:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        out, i = [], 0
        while i < size:
            j = right[i]
            out.append(ranks[piece[start[i] : start[j] if j < size else size]])
            i = j
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null text. Strings of special tokens are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.pieces.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        for k in list(cache)[: CACHE_ENTRIES // 2]:
                            del cache[k]
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no valid text become the replacement character."""
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")

    def chars_per_token(self, text: str) -> float:
        """Characters per subword; natural text has many, random strings have few."""
        return len(text) / max(1, len(self.encode(text)))


def vocabulary_bytes(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> bytes:
    with open(os.path.join(folder or VOCABULARIES, name), "rb") as file:
        return file.read()


@lru_cache(maxsize=4)
def vocabulary(lines: bytes) -> Bpe:
    """The vocabulary of a rank file's bytes, built once per worker."""
    return Bpe.parse(lines)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_dir: str | None = None) -> DataFrame:
    """``(id_col, ids)`` for every row: token ids without special tokens, an empty list for empty and null texts.

    One pass without a shuffle: whole texts go to the workers in Arrow batches, ids come back as arrays. The
    vocabulary (under 1 MB whatever the corpus) is broadcast. Repeated rows come out as often as they go in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(folder=vocabulary_dir))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(shared.value)
        for batch in batches:
            found = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
            if ends[-1] < 2**31:
                flat = np.fromiter((x for ids in found for x in ids), np.int32, int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])
            else:
                for i, one in enumerate(found):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([one], pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_corpus(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_dir: str | None = None) -> DataFrame:
    """``(id_col, text)``: the inverse of ``encode_corpus``; null ids give the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary_bytes(folder=vocabulary_dir))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, id_col: str, text_col: str = "text", keep: list[str] | None = None, vocabulary_dir: str | None = None) -> DataFrame:
    """``(id_col, *keep, tokens)``: only the number of tokens leaves the worker."""
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(folder=vocabulary_dir))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(shared.value)
        for batch in batches:
            counts = pa.array([len(bpe.encode(t)) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], counts], [*names, "tokens"])

    names = [id_col, *keep]
    schema = ", ".join(f"{x} {docs.schema[x].dataType.simpleString()}" for x in names)
    return docs.select(F.col(text_col).alias("__text"), *names).mapInArrow(run, f"{schema}, tokens bigint")
