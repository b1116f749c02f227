"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte spans. Every adjacent pair that is a known token waits in the bucket of
its rank; a two-level bitmap over the ranks gives the lowest waiting rank by find-first-set. Inside a bucket the
leftmost position goes first. An entry whose pair has changed since it was queued is stale and skipped. Each merge
queues at most two pairs, so a pre-token of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import array
import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHED = 300_000
_coders: dict[tuple[str, str], "Coder"] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token; a byte that the vocabulary lacks raises KeyError."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    follow = list(range(1, n + 1))
    previous = list(range(-1, n - 1))
    waiting = [-1] * n
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    summary = 0
    find = ranks.get
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        if rank is not None:
            waiting[i] = rank
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [i]
                word = rank >> 6
                words[word] = words.get(word, 0) | 1 << (rank & 63)
                summary |= 1 << word
            else:
                bucket.append(i)
    while summary:
        word = (summary & -summary).bit_length() - 1
        bits = words[word]
        low = bits & -bits
        rank = (word << 6) + low.bit_length() - 1
        bucket = buckets[rank]
        i = heapq.heappop(bucket)
        if not bucket:
            del buckets[rank]
            bits ^= low
            if bits:
                words[word] = bits
            else:
                del words[word]
                summary ^= 1 << word
        if waiting[i] != rank:
            continue
        j = follow[i]
        end = follow[j]
        follow[i] = end
        waiting[j] = -1
        if end < n:
            previous[end] = i
        left = previous[i]
        for at, stop in ((i, follow[end] if end < n else 0), (left, end)):
            if at < 0 or (at == i and not stop):
                if at >= 0:
                    waiting[at] = -1
                continue
            rank = find(piece[at:stop])
            if rank is None:
                waiting[at] = -1
                continue
            waiting[at] = rank
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [at]
                word = rank >> 6
                words[word] = words.get(word, 0) | 1 << (rank & 63)
                summary |= 1 << word
            else:
                heapq.heappush(bucket, at)
    out, i = [], 0
    while i < n:
        j = follow[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge() for pre-tokens of up to 64 bytes, where a bucket's positions fit in one word as well."""
    n = len(piece)
    follow = list(range(1, n + 1))
    previous = list(range(-1, n - 1))
    waiting = [-1] * n
    buckets: dict[int, int] = {}
    words: dict[int, int] = {}
    summary = 0
    find = ranks.get
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        if rank is not None:
            waiting[i] = rank
            if rank in buckets:
                buckets[rank] |= 1 << i
            else:
                buckets[rank] = 1 << i
                word = rank >> 6
                words[word] = words.get(word, 0) | 1 << (rank & 63)
                summary |= 1 << word
    while summary:
        word = (summary & -summary).bit_length() - 1
        bits = words[word]
        low = bits & -bits
        rank = (word << 6) + low.bit_length() - 1
        bucket = buckets[rank]
        first = bucket & -bucket
        i = first.bit_length() - 1
        bucket ^= first
        if bucket:
            buckets[rank] = bucket
        else:
            del buckets[rank]
            bits ^= low
            words[word] = bits
            if not bits:
                summary ^= 1 << word
        if waiting[i] != rank:
            continue
        j = follow[i]
        end = follow[j]
        follow[i] = end
        waiting[j] = waiting[i] = -1
        if end < n:
            previous[end] = i
            rank = find(piece[i : follow[end]])
            if rank is not None:
                waiting[i] = rank
                if rank in buckets:
                    buckets[rank] |= 1 << i
                else:
                    buckets[rank] = 1 << i
                    word = rank >> 6
                    words[word] = words.get(word, 0) | 1 << (rank & 63)
                    summary |= 1 << word
        left = previous[i]
        if left >= 0:
            rank = find(piece[left:end])
            if rank is None:
                waiting[left] = -1
            else:
                waiting[left] = rank
                if rank in buckets:
                    buckets[rank] |= 1 << left
                else:
                    buckets[rank] = 1 << left
                    word = rank >> 6
                    words[word] = words.get(word, 0) | 1 << (rank & 63)
                    summary |= 1 << word
    out, i = [], 0
    while i < n:
        j = follow[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Coder(dict):
    """Encodes and decodes whole texts. As a dict: pre-token to its packed ids, in two generations of CACHED entries."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.ranks = ranks_of(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                ids = [rank]
            else:
                ids = (merge_short if len(data) <= 64 else merge)(data, self.ranks)
            packed = array.array("I", ids).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, packed: bytes) -> bytes:
        ids = array.array("I")
        ids.frombytes(packed)
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(path: str, pattern: str) -> Coder:
    """One coder for each worker process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a document: its token count and the digests of its ids and of the bytes decoded from those ids.

    With keep_ids the ids come too, as `ids array<int>`. A null text counts as empty: no ids, digests of nothing.
    Repeated rows give repeated rows; a null id stays null; other columns are left out. The vocabulary file is read
    by each worker from `path`, the place of an installed package on every machine. No shuffle.
    """
    schema = SCHEMA.replace("doc_id long", f"{id_col} {docs.schema[id_col].dataType.simpleString()}") + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            counts, ids, decoded, kept = [], [], [], []
            for text in batch.column(1):
                packed = own.encode(text.as_py() or "")
                counts.append(len(packed) // 4)
                ids.append(sha(packed).hexdigest())
                decoded.append(sha(own.decode(packed)).hexdigest())
                if keep_ids:
                    kept.append(packed)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = np.cumsum([0, *counts], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(kept), dtype=np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
