"""Encoding with a byte-level BPE vocabulary given as ranks.

A piece of text starts as a doubly linked list of its bytes. A priority queue holds the
possible merges by rank and place; the best is taken, the two symbols become one, their
new neighbours are queued, and entries whose symbols have changed since are skipped. That
is O(n log n) in the piece, however long it is. Pieces repeat, so each worker keeps a
bounded table of pieces already encoded.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary lies unless the caller says otherwise.
VOCABULARY = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: how this public vocabulary cuts text into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Encoder and decoder over a file of ``base64 rank`` lines."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN, remember: int = 1 << 18):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if parts := line.split():
                    self.ranks[base64.b64decode(parts[0])] = int(parts[1])
        self.strings = {rank: piece for piece, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.remember, self.known = remember, {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        symbols: list[bytes | None] = [data[k : k + 1] for k in range(len(data))]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, k, data[k : k + 1], data[k + 1 : k + 2]) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapify(queue)
        while queue:
            _, k, left, right = heappop(queue)
            nxt = after[k]
            if nxt >= n or symbols[k] != left or symbols[nxt] != right:
                continue  # stale
            symbols[k] = merged = left + right
            symbols[nxt] = None
            after[k] = far = after[nxt]
            if far < n:
                before[far] = k
                if (r := ranks.get(merged + symbols[far])) is not None:
                    heappush(queue, (r, k, merged, symbols[far]))
            if (back := before[k]) >= 0 and (r := ranks.get(symbols[back] + merged)) is not None:
                heappush(queue, (r, back, symbols[back], merged))
        return [ranks[s] for s in symbols if s is not None]

    def _learn(self, piece: str) -> list[int]:
        if len(self.known) >= self.remember:
            self.known.clear()
        ids = self.piece(piece.encode())
        if len(piece) <= 64:
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of an empty and of a null text none."""
        if not text:
            return []
        known, learn = self.known, self._learn
        return list(chain.from_iterable([known.get(p) or learn(p) for p in self.find(text)]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the vocabulary's strings one after the other."""
        return b"".join(self.strings[k] for k in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> ByteBpe:
    """The worker's encoder; loaded once in a process."""
    return ByteBpe(path)


def encode_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id_col, ids array<int>): one row per row, no special tokens; null and empty texts
    have an empty list, repeated ids come out as often as they came in, an empty table
    gives an empty result. Whole texts are encoded. No exchange is needed."""
    rows = documents.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                lists = [bpe.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens int) of each row, under the rules of ``encode_texts``."""
    rows = documents.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            counts = pa.array([len(bpe.encode(t)) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[id_col, "n_tokens"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, n_tokens int")
