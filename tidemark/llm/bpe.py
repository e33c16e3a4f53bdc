"""Encoding texts with a public byte-level BPE vocabulary.

A piece of text is a row of symbols. A segment tree over the ranks of adjacent pairs holds, in its
root, the leftmost pair of lowest rank. Merging it changes two pairs and removes one, each a point
update along one path, until no pair can merge. Pieces of everyday text repeat, so each task keeps
the ids of those it has seen.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabularies lie; TIDEMARK_TOKENIZERS names another folder.
FOLDER = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
# Fixed value: how the vocabulary's authors split text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces that a task remembers before it starts anew.
REMEMBERED = 32 << 20

_NONE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines with a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: merges of the lowest rank first, the leftmost among equals."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    width = 1
    while width < n - 1:
        width *= 2
    # a node holds rank * n + position, so that the smaller is the lower rank, then the one further left
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    end = list(range(1, n + 1))  # where the symbol that starts here ends
    start = list(range(-1, n))  # where the symbol before the one that starts here starts
    while tree[1] != _NONE:
        at = tree[1] % n
        middle = end[at]
        stop = end[middle]
        end[at] = stop
        if middle < n - 1:
            put(middle, _NONE)
        if stop < n:
            start[stop] = at
            rank = ranks.get(piece[at : end[stop]])
            put(at, _NONE if rank is None else rank * n + at)
        elif at < n - 1:
            put(at, _NONE)
        before = start[at]
        if before >= 0:
            rank = ranks.get(piece[before:stop])
            put(before, _NONE if rank is None else rank * n + before)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Encoder:
    """Text to token ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self.held = 0

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known = self.known
        out = []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(piece) < 64:
                    if self.held > REMEMBERED:
                        known.clear()
                        self.held = 0
                    known[piece] = ids
                    self.held += 100 + 5 * len(piece)
            out.append(ids)
        return list(chain.from_iterable(out))


@lru_cache(maxsize=4)
def _encoder(data: bytes) -> Encoder:
    return Encoder(read_ranks(data))


def _vocabulary(spark: SparkSession, name: str, folder: str) -> object:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ids(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, folder: str = FOLDER) -> Column:
    """Ids of ``text`` as ``array<int>``, without special tokens; an empty array for null and empty texts.

    The vocabulary is read on the driver and broadcast; its size does not depend on the data. Whole
    texts are encoded, however long. No row moves.
    """
    shared = _vocabulary(spark, vocabulary, folder)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value)
        for batch in batches:
            lists = [encoder.encode(t) for t in batch.to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return encode(text.cast("string"))


def token_count(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, folder: str = FOLDER) -> Column:
    """Number of ids of ``text``: 0 for null and empty ones."""
    shared = _vocabulary(spark, vocabulary, folder)

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value)
        for batch in batches:
            yield pa.array([len(encoder.encode(t)) for t in batch.to_pylist()], pa.int32())

    return count(text.cast("string"))


def encode_corpus(documents: DataFrame, text: str = "text", name: str = "ids", vocabulary: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """``documents`` with the column ``name`` of token ids; one row out for each row in."""
    return documents.withColumn(name, token_ids(documents.sparkSession, F.col(text), vocabulary, folder))
