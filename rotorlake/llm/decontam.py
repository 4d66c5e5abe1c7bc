"""Benchmark decontamination by a positional inverted index that is split by document.

Index: each task takes whole documents in blocks of a few MB, cuts them into words and
stores, for each distinct word of the block (by its 64-bit hash), the sorted positions of its
postings. Documents of a block lie one after another with a gap, so that one number is a
posting. The index is a table in the shared folder, made once and whatever the test items
are; a document's postings are all in one block, whose number is stored with it.

Search: within each block, a phrase (window of test words) starts from the list of its
rarest word and is intersected with the lists of its other words, rarest first, each shifted
by its offset in the phrase. Nothing is shuffled and no candidate leaves its block. The
items pass through the driver in blocks of at most ITEM_CHARS characters, whose phrases are
broadcast with a pass over the index for each; hits of one document from several passes
meet by the number of its block and its place there.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z become a-z. An item with fewer words
than a window is one window; an item or document without words (or null) has none. Rows
with equal or null keys stay separate rows; items with equal ids are one item, and those
without an id count as the one with an empty id. An empty table gives no rows, no items no
hits; other columns aren't read. Proximity: ``n_near`` counts items with a window all of
whose words occur within ``span`` words of one occurrence of its rarest word, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats as ts
from .common import released, slices, stored

#: Characters of test items in one pass: their phrases are broadcast, about 100 times that.
ITEM_CHARS = 1 << 20
#: Bytes of text in an index block; candidates that are intersected at once.
BLOCK_BYTES, CANDIDATES = 4 << 20, 1 << 20

#: Bytes between words: ASCII but for digits and small letters.
_BETWEEN = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, and the number of its text."""
    buffer, offsets = ts.packed(column)
    buffer = ts.LOWER[buffer]
    starts, ends, of = ts.spans(buffer, offsets, _BETWEEN)
    return ts.hashes(buffer, starts, ends) if len(starts) else np.zeros(0, np.uint64), of


class Phrases:
    """The distinct windows of some items as rows of word hashes, and the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        self.width = width
        words, of = word_hashes(pa.array([t for _, t in items], pa.string()))
        n = np.bincount(of, minlength=len(items))
        first = np.cumsum(n) - n
        sizes = np.minimum(n, width)
        count = np.where(n > 0, n - sizes + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[item]
        place = at[:, None] + np.arange(width)
        used = np.arange(width) < sizes[item][:, None]
        rows = np.where(used, words[np.minimum(place, max(0, len(words) - 1))] if len(words) else np.uint64(0), np.uint64(0))
        found, number = np.unique(np.column_stack([rows, sizes[item].astype(np.uint64)]), axis=0, return_inverse=True)
        self.terms, self.sizes, self.count = found[:, :-1], found[:, -1].astype(np.int64), len(found)
        self.used = np.arange(width) < self.sizes[:, None]
        ids = ["" if i is None else str(i) for i, _ in items]
        self.names = sorted(set(ids))
        place_of = {name: i for i, name in enumerate(self.names)}
        pairs = np.unique(np.column_stack([number.reshape(-1), np.array([place_of[i] for i in ids], np.int64)[item]]), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.items, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(self.count + 1))


def build_index(df: DataFrame, gap: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The stored index: per ``block``, numbered, ``keys, lengths`` of documents, ``terms, counts``
    and ``steps`` between positions, list after list."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for at, batch in enumerate(slices(batches, "text", BLOCK_BYTES)):
            words, of = word_hashes(batch.column(1))
            n = np.bincount(of, minlength=batch.num_rows)
            starts = np.cumsum(n + gap) - n - gap
            place = np.arange(len(words)) + (starts - (np.cumsum(n) - n))[of]
            order = np.argsort(words, kind="stable")
            found, counts = np.unique(words[order], return_counts=True)
            flat = (n.astype("<i4"), found, counts.astype("<i4"), np.diff(place[order], prepend=0).astype("<i4"))
            columns = [pa.array([block + at]), pa.array([batch.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)), *(pa.array([x.tobytes()], pa.binary()) for x in flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "keys", "lengths", "terms", "counts", "steps"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(released(run), f"block long, keys array<{kind}>, lengths binary, terms binary, counts binary, steps binary"), "postings")


class Block:
    """One block of the index, opened for search."""

    def __init__(self, lengths: bytes, terms: bytes, counts: bytes, steps: bytes, gap: int):
        self.lengths, n, steps = (np.frombuffer(x, "<i4").astype(np.int64) for x in (lengths, counts, steps))
        self.present, self.positions = np.frombuffer(terms, "<u8"), np.cumsum(steps)
        self.starts = np.cumsum(self.lengths + gap) - self.lengths - gap
        self.size = int(np.sum(self.lengths + gap))
        self.ends, self.n = np.cumsum(n), n
        # one sorted key for all lists
        self.stride = self.size + 2 * gap
        self.keys = np.repeat(np.arange(len(n)), n) * self.stride + self.positions

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each term here, and its length (0 where it has none)."""
        if not len(self.present):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.present, terms), len(self.present) - 1)
        return at, np.where(self.present[at] == terms, self.n[at], 0)

    def holds(self, lists: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether these lists have these positions."""
        want = lists * self.stride + positions
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (positions >= 0)

    def near(self, lists: np.ndarray, positions: np.ndarray, span: int) -> np.ndarray:
        """Whether these lists have a position at most ``span`` away, in the same document."""
        doc = self.document(positions)
        low = np.maximum(positions - span, self.starts[doc])
        high = np.minimum(positions + span, self.starts[doc] + self.lengths[doc] - 1)
        at = np.searchsorted(self.keys, lists * self.stride + low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= lists * self.stride + high)

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def search(block: Block, phrases: Phrases, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact hits as (phrase, first position); proximity matches as (phrase, position)."""
    lists, n = block.lists(phrases.terms)
    n = np.where(phrases.used, n, np.iinfo(np.int64).max)
    alive = np.flatnonzero(n.min(axis=1) > 0) if phrases.count else np.zeros(0, np.int64)
    hits, near = [[], []], [[], []]
    rank = np.argsort(n[alive], axis=1, kind="stable")
    rarest = np.take_along_axis(n[alive], rank, 1)[:, 0]
    upto = np.cumsum(rarest)
    at = 0
    while at < len(alive):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, "right")))
        own = np.arange(at, end)
        # postings of each phrase's rarest word
        count = rarest[own]
        first = block.ends[lists[alive[own], rank[own, 0]]] - count
        row = np.repeat(own, count)
        place = block.positions[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        for kind, found in (("exact", hits), ("near", near)):
            r, p = (row, place - rank[row, 0]) if kind == "exact" else (row, place)
            for k in range(0 if kind == "exact" else 1, phrases.width):
                column = rank[r, k]
                used = phrases.used[alive[r], column]
                which = lists[alive[r], column]
                fits = (block.holds(which, p + column) if kind == "exact" else block.near(which, p, span)) | ~used
                r, p = r[fits], p[fits]
            found[0].append(alive[r])
            found[1].append(p)
        at = end
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (*hits, *near))


def _pairs(block: Block, phrases: Phrases, phrase: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, item) of these hits, in that order."""
    one = np.unique(block.document(position) * phrases.count + phrase) if len(phrase) else np.zeros(0, np.int64)
    doc, phrase = np.divmod(one, max(1, phrases.count))
    n = phrases.first[phrase + 1] - phrases.first[phrase]
    item = phrases.items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.first[phrase], n)]
    pair = np.unique(np.repeat(doc, n) * max(1, len(phrases.names)) + item)
    return np.divmod(pair, max(1, len(phrases.names)))


def find_leaks(df: DataFrame, items: DataFrame, width: int = 10, span: int = 20, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", item_chars: int = ITEM_CHARS) -> DataFrame:
    """``key, n_words, n_hit, n_items, item_ids, spans, n_near`` of each row of ``df``.

    ``spans`` are the [first, one past the last) words that occurring windows cover.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    schema = f"block long, number int, key {kind}, n_words long, item_ids array<string>, spans array<struct<begin:int,end:int>>, n_near long"
    index = build_index(df, width, text, key)

    def passed(block_items: list[tuple], every: bool) -> DataFrame:
        """All documents against some items; those without a match only if ``every``."""
        shared = spark.sparkContext.broadcast(Phrases(block_items, width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    name, keys, *parts = (c[row] for c in batch.columns)
                    yield _searched(name.as_py(), keys.values, [p.as_buffer() for p in parts], shared.value, span, every)

        return index.mapInArrow(released(run), schema)

    passes: list[DataFrame] = []
    for part in _item_blocks(items.select(item_key, F.col(item_text).cast("string")), item_chars):
        if passes:  # more than one: each is written before the next one's items are read
            passes[-1] = stored(passes[-1], "leaks")
        passes.append(passed(part, not passes))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    if len(passes) > 1:
        merged = out.groupBy("block", "number").agg(
            F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.sum("n_near").alias("n_near"))
        joined = F.aggregate("spans", F.expr("cast(array() as array<struct<begin:int,end:int>>)"), lambda got, x: F.when((F.size(got) > 0) & (x["begin"] <= F.element_at(got, -1)["end"]), F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(F.element_at(got, -1)["begin"].alias("begin"), F.greatest(F.element_at(got, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(got, F.array(x))))
        out = merged.withColumn("spans", joined)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda got, x: got + (x["end"] - x["begin"]))
    return out.select(F.col("key").alias(key), "n_words", covered.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans", "n_near")


def _item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The items in blocks of ``most`` characters, about; at least one block, which may be empty."""
    block, size = [], 0
    for item in items.toLocalIterator():
        size += len(item[1] or "")
        if size > most and block:
            yield block
            block, size = [], len(item[1] or "")
        block.append(tuple(item))
    yield block


def _searched(name: int, keys: pa.Array, parts: list, phrases: Phrases, span: int, every: bool) -> pa.RecordBatch:
    """All documents of one block against one block of phrases."""
    block, n = Block(*parts, gap=phrases.width), len(keys)
    phrase, position, near_phrase, near_position = search(block, phrases, span)
    doc, item = _pairs(block, phrases, phrase, position)
    near_doc, _ = _pairs(block, phrases, near_phrase, near_position)
    edge = np.zeros(block.size + phrases.width + 1, np.int32)
    np.add.at(edge, position, 1)
    np.add.at(edge, position + phrases.sizes[phrase], -1)
    hit = np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8)
    begin, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    of = block.document(begin)
    names = pa.array(phrases.names, pa.string()).take(pa.array(item)) if len(item) else pa.array([], pa.string())
    offsets = lambda x: pa.array(np.searchsorted(x, np.arange(n + 1)).astype(np.int32))
    pairs = pa.StructArray.from_arrays([pa.array((x - block.starts[of]).astype(np.int32)) for x in (begin, end)], names=["begin", "end"])
    columns = [
        pa.array([name] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), keys, pa.array(block.lengths), pa.ListArray.from_arrays(offsets(doc), names),
        pa.ListArray.from_arrays(offsets(of), pairs), pa.array(np.bincount(near_doc, minlength=n)),
    ]
    out = pa.RecordBatch.from_arrays(columns, names=["block", "number", "key", "n_words", "item_ids", "spans", "n_near"])
    return out if every else out.take(pa.array(np.unique(np.concatenate([doc, near_doc]))))
