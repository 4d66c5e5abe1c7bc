"""Token ids in binary segments, in ascending key order.

The texts are range-partitioned by key and sorted; each task encodes its texts, appends the
end id to each and writes segments of about SEGMENT_IDS ids. A segment is self-contained::

    "S8B1", then little-endian: documents u32, blocks u32, words u64, exceptions u32, ids u64,
    ends of documents u64[documents], first words of blocks u32[blocks + 1],
    words u64[words], exceptions u64[exceptions]

Segments are binary values of a Parquet table with their keys, their place (range, number in
it) and the ids before them in the range. Spark's committer publishes the table, so that
retried and speculative tasks leave nothing behind, on any store. Rows with equal keys are
ordered by a hash of the text, by which a frequent key is split over ranges, too; null keys
come first, null and empty texts hold the end id alone. An empty table gives an empty file
table; other columns aren't read.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pretokens, simple8b
from .common import kept, released, slices, texts
from .token_counts import library, parts, piece_ids, specials, whole_pieces

SEGMENT_IDS = 1 << 18
_HEAD = struct.Struct("<4sIIQIQ")


def to_segment(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The segment of these ids; ``ends``: ids up to and with each document."""
    words, offsets, exceptions = simple8b.pack(ids)
    head = _HEAD.pack(b"S8B1", len(ends), len(offsets) - 1, len(words), len(exceptions), len(ids))
    return b"".join([head, ends.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), exceptions.astype("<u8").tobytes()])


def from_segment(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of a segment."""
    magic, docs, blocks, words, exceptions, n = _HEAD.unpack_from(image)
    if magic != b"S8B1":
        raise ValueError("not a segment of token ids")
    at, out = _HEAD.size, []
    for kind, count in (("<u8", docs), ("<u4", blocks + 1), ("<u8", words), ("<u8", exceptions)):
        out.append(np.frombuffer(image, kind, count, at))
        at += out[-1].nbytes
    return simple8b.unpack(out[2], out[1].astype(np.int64), out[3], n), out[0].astype(np.int64)


class Ids(pretokens.Cache):
    """Pre-token to its little-endian 32-bit ids, made when it is first asked for: one lookup a pre-token."""

    def __init__(self, path: str, pieces: tuple[str, ...]):
        self.path = path
        super().__init__(lambda found: map(self.one, found), {p: self.one(p) for p in pieces})

    def one(self, piece: str) -> bytes:
        ids = array("I", piece_ids(self.path, (piece,))[0])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.one(piece)
        if len(piece) <= pretokens.CACHED_LENGTH:
            self[piece] = ids
        return ids


class Encoder:
    """Ids by the tokenizers library, pre-token by pre-token behind a cache."""

    def __init__(self, path: str, source: str, pieces: tuple[str, ...]):
        self.tok, self.special, self.source = library(path), specials(path), source
        self.cache = Ids(path, pieces)

    def encode(self, found: list[str], end: int) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        last, whole = np.asarray([end], "<u4").tobytes(), lambda t: np.asarray(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        known, out = self.cache.__getitem__, []
        for t in found:
            self.cache.bounded()
            plain = pretokens.settled(t) and parts(t, self.special) == [t]
            out.append((b"".join(map(known, pretokens.split(t, self.source))) if plain else whole(t)) + last)
        return out


def write(df: DataFrame, folder: str, path: str, source: str, end: int, text: str = "text", key: str = "doc_id", segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the token files of ``df`` into ``folder`` (which must be new)."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(whole_pieces(path, source)))
    kind = df.schema[key].dataType.simpleString()
    schema = f"range int, number int, base long, n_ids long, keys array<{kind}>, segment binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number, base = kept("token_files", (path, source, shared.value), lambda: Encoder(path, source, shared.value)), TaskContext.get().partitionId(), 0, 0
        keys, held, size = [], [], 0

        def segment() -> pa.RecordBatch:
            ids, ends = np.frombuffer(b"".join(held), "<u4"), np.cumsum([len(x) // 4 for x in held])
            columns = [[part], [number], [base], [len(ids)], [keys], [to_segment(ids, ends)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(batch.schema.field(0).type), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["range", "number", "base", "n_ids", "keys", "segment"])

        for batch in slices(batches, "text", 2 << 20):
            for k, ids in zip(batch.column(0).to_pylist(), own.encode(texts(batch, "text"), end), strict=True):
                keys.append(k)
                held.append(ids)
                size += len(ids) // 4
                if size >= segment_ids:
                    yield segment()
                    keys, held, number, base, size = [], [], number + 1, base + size, 0
        if held:
            yield segment()

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text").select("key", "text")
    ordered.mapInArrow(released(run, "token_files"), schema).write.option("compression", "uncompressed").parquet(folder)


def read(spark: SparkSession, folder: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of each document of the files, and ``token_ids``.

    ``start``: the ids of all documents before it. The sums over ranges are as many rows as
    the writing job had partitions.
    """
    files = spark.read.parquet(folder)
    kind = files.schema["keys"].dataType.elementType.simpleString()
    sums = files.groupBy("range").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.join(F.broadcast(sums.select("range", before.alias("before"))), "range").select((F.col("base") + F.col("before")).alias("base"), "keys", "segment")
    fields = f"key {kind}, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found, ends = from_segment(batch.column(2)[i].as_py())
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(found.astype("<u4").tobytes())
                out = [batch.column(1)[i].values, pa.array(starts + batch.column(0)[i].as_py()), pa.array(ends - starts), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(found.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["key", "start", "n_tokens", "ids_crc32", "token_ids"][: len(out)])

    return placed.mapInArrow(released(run), fields).withColumnRenamed("key", key)
