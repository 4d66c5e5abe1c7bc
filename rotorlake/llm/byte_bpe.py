"""Byte-level BPE by sentencepiece: a BPE model written directly from a rank vocabulary.

Each token's bytes map to printable characters one by one; piece ``i`` is the token of rank
``i`` with score ``-i``, so that the merge of lowest rank comes first, leftmost among equals,
as the rank files mean it. Normalisation is the identity. Pre-tokens are encoded one at a
time, behind a bounded cache, and ids are decoded by the inverse mapping.

Null texts count as empty; an empty text has no ids. Rows are coded one by one: ties and
repeated rows don't matter, and an empty table gives no rows. Of columns beside the text,
those that the result adds are replaced, the others kept.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import pretokens
from .common import kept, released, slices, texts


@cache
def byte_characters() -> tuple[str, ...]:
    """The printable character of each byte: itself, or else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in shown else chr(next(spare)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; the ranks have no gaps."""
    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, a varint or a 32-bit float."""

    def varint(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def model(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model; its last piece, after the tokens, is the unknown one."""
    chars, normal, unknown, bpe = byte_characters(), 1, 2, 2
    pieces = [_field(1, "".join(map(chars.__getitem__, t)).encode()) + _field(2, -float(i)) + _field(3, normal) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encodes and decodes by a rank file; ``source`` is the pattern of pre-tokens."""

    def __init__(self, path: str, source: str):
        import sentencepiece

        self.tokens, self.source = read_ranks(path), source
        self.names = [str(i) for i in range(len(self.tokens))]
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model(self.tokens))
        self.chars = dict(zip(range(256), byte_characters(), strict=True))
        self.cache = pretokens.Cache(self._pieces)

    def _pieces(self, pieces: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each pre-token."""
        mapped = [piece.encode().decode("latin-1").translate(self.chars) for piece in pieces]
        return (np.asarray(ids, "<u4").tobytes() for ids in self.sp.encode(mapped, num_threads=1))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [pretokens.split(text, self.source) for text in texts]
        self.cache.learn(cut)
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, pieces)), "<u4") for pieces in cut]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str, source: str) -> Codec:
    """One for each worker, over all its tasks."""
    return kept("byte_bpe", (path, source), lambda: Codec(path, source))


def encode(df: DataFrame, path: str, source: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with an array of token ids added (replaced, where it has such a column)."""
    out = df.drop(ids).withColumn("__text", F.col(text).cast("string"))
    schema = out.drop("__text").schema.add(ids, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, source)
        for batch in slices(batches, "__text", 2 << 20):
            found = own.encode(texts(batch, "__text"))
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            values = pa.array(np.concatenate([*found, np.zeros(0, "<u4")]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*batch.schema.names[:-1], ids])

    return out.mapInArrow(released(run, "byte_bpe"), schema)


def decode(df: DataFrame, path: str, source: str, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for added; null ids give null."""
    out = df.drop(data).withColumn("__ids", F.col(ids))
    schema = out.drop("__ids").schema.add(data, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, source)
        for batch in batches:
            found = [None if x is None else own.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=[*batch.schema.names[:-1], data])

    return out.mapInArrow(released(run, "byte_bpe"), schema)


def round_trip(df: DataFrame, path: str, source: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of each text, encoded and decoded again.

    The ids themselves aren't kept: encoding and decoding run in one pass over each text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, source)
        for batch in slices(batches, "text", 2 << 20):
            n, coded, decoded = [], [], []
            for ids in map(np.ndarray.tolist, own.encode(texts(batch, "text"))):
                n.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(released(run, "byte_bpe"), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
