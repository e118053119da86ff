"""Byte-pair encoding of whole texts with a public vocabulary.

Every piece between the vocabulary's split pattern is encoded over its bytes. A
segment tree over the byte positions keeps, in each node, the leftmost pair of
the least rank below it; a merge updates the pairs of its two live neighbours in
logarithmic time. A piece of n bytes takes O(n log n), however long it is, so no
text is cut. Encodings of short pieces are kept per worker in a bounded memo.

Null and empty texts give an empty list. Strings that look like control tokens
are plain text: the rank file has none. Repeated documents each get their row;
an empty table gives an empty frame; columns other than the two are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgram.runtime import spread

#: The published split pattern; ``\s`` spelt out as Unicode white space.
_SPACE = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+"
#: Pieces up to so many characters are kept, up to so many of them.
MEMO_CHARS, MEMO_PIECES = 48, 1 << 17
#: Ids after which an output batch is closed.
BATCH_IDS = 1 << 21

_NONE = 1 << 62


class Encoder:
    """Encoder for a rank file (one line each: base64 of the bytes, rank)."""

    def __init__(self, rank_file: bytes):
        import regex

        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.find = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: merge the leftmost pair of least rank until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        width = 1 << (n - 1).bit_length()
        end = list(range(1, n + 1))  # of the part that starts at a position
        before = list(range(-1, n - 1))
        # a leaf is rank * width + position, so the minimum is the leftmost of the least rank
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] != _NONE:
            i = tree[1] & (width - 1)
            j = end[i]
            stop = end[j]
            end[i] = stop
            put(j, _NONE)
            if stop < n:
                before[stop] = i
                rank = ranks.get(data[i : end[stop]])
                put(i, _NONE if rank is None else rank * width + i)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                rank = ranks.get(data[h:stop])
                put(h, _NONE if rank is None else rank * width + h)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8"))
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(rank_file: bytes) -> Encoder:
    """The encoder of a rank file, built once in each worker process."""
    key = hash(rank_file)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(rank_file)
    return _ENCODERS[key]


def encode_texts(df: DataFrame, rank_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every text."""
    with open(rank_path, "rb") as f:  # under 1 MB, sent with the function
        rank_file = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(rank_file)
        for batch in batches:
            begin, lists, held = 0, [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                lists.append(encoder.encode(text) if text else [])
                held += len(lists[-1])
                # long texts leave in batches of their own
                if held >= BATCH_IDS or i + 1 == batch.num_rows:
                    offsets = np.zeros(len(lists) + 1, np.int32)
                    np.cumsum([len(x) for x in lists], out=offsets[1:])
                    flat = np.fromiter((t for x in lists for t in x), np.int32, held)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(lists)), ids], names=["doc_id", "ids"])
                    begin, lists, held = i + 1, [], 0

    rows = spread(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(df: DataFrame, rank_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` by the same encoder, without the ids leaving the worker."""
    with open(rank_path, "rb") as f:
        rank_file = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(rank_file)
        for batch in batches:
            sizes = [len(encoder.encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["doc_id", "n_tokens"])

    rows = spread(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens int")
