"""Byte-level BPE encoding and decoding with a segment tree per piece.

Leaf *i* of the tree holds the rank of the pair that starts at byte *i*, if a live part starts there
and has a neighbour; every inner node holds the smaller of its children, a key of rank and place, so
the root is the leftmost pair of least rank. A merge touches the pairs on either side of it: three
point updates of logarithmic cost. A piece of n bytes takes O(n log n), whatever its ranks.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from boardwalk.llm.common import narrow

_RANKS = 1 << 24  # ranks are below
CACHED = 300_000  # entries a task remembers, about 200 bytes each


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank from a file of base64 strings and numbers."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(ranks.values(), default=0) >= _RANKS:
        raise ValueError(f"ranks must be below {_RANKS}")
    return ranks


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: itself if it has a rank, else pairs merged by least rank, leftmost first."""
    known = ranks.get(piece)
    if known is not None:
        return [known]
    size = len(piece)
    if size < 2:
        return [ranks[piece]] if size else []
    # a leaf for each pair; a key is rank * leaves + place, small enough to be one machine word
    leaves = 1 << (size - 2).bit_length()
    get, none = ranks.get, _RANKS * leaves
    tree = [none] * (2 * leaves)
    for i in range(size - 1):
        tree[leaves + i] = get(piece[i:i + 2], _RANKS) * leaves + i
    for node in range(leaves - 1, 0, -1):
        a, b = tree[node + node], tree[node + node + 1]
        tree[node] = a if a < b else b
    following = list(range(1, size + 1))  # start of the next live part; size at the end
    before = list(range(-1, size - 1))

    def update(at: int, value: int) -> None:
        node = leaves + at
        while tree[node] != value:
            tree[node] = value
            if node == 1:
                return
            other = tree[node ^ 1]
            if other < value:
                value = other
            node >>= 1

    while (least := tree[1]) < none:
        at = least & (leaves - 1)
        gone = following[at]
        after = following[at] = following[gone]
        if after < size:
            before[after] = at
            update(gone, none)
            update(at, get(piece[at:following[after]], _RANKS) * leaves + at)
        else:
            update(at, none)
        left = before[at]
        if left >= 0:
            update(left, get(piece[left:after], _RANKS) * leaves + left)
    out, at = [], 0
    while at < size:
        out.append(ranks[piece[at:following[at]]])
        at = following[at]
    return out


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """Piece to its ids as bytes, computed when missing. Bounded: when half is full, the older half
    goes and its entries in use come back from there."""

    def __init__(self, make, limit: int = CACHED):
        super().__init__()
        self.make, self.limit, self.older = make, limit // 2, {}

    def __missing__(self, piece):
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = value
        return value


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.vocabulary = {rank: content for content, rank in ranks.items()}
        self.memo = Memo(lambda piece: as_bytes(encode_piece(piece.encode(), ranks)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` with ``ids`` (binary, little-endian unsigned 32-bit); null texts count as empty."""
    return _mapped(documents, path, pattern, "ids binary", lambda codec, ids: [ids])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` to ``doc_id, content`` (binary, as ids may end within a character)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, r".")
        for batch in batches:
            made = [codec.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return narrow(encoded, "doc_id", "ids").mapInArrow(run, f"doc_id {kind}, content binary")


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the round trip of every row in one pass."""
    def row(codec: Codec, ids: bytes) -> list:
        return [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()]

    return _mapped(documents, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def _mapped(documents: DataFrame, path: str, pattern: str, fields: str, row) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            rows = [row(codec, codec.encode(t.as_py() or "")) for t in batch.column(1)]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *names])

    kind = narrow(documents, "doc_id").schema[0].dataType.simpleString()
    return narrow(documents, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")
