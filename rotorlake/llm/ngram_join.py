"""Similarity join on word n-grams by prefix filters under several global orders.

A text's set holds its distinct 5-word shingles (all its words as one, if it has fewer; none
without words). Two sets link when ``100 * |A and B| >= percent * |A or B|``. The result is
exact but for 64-bit hashes: of sets as the identity of classes, of shingles in sets.

1. One scan gives each text the hash of its set. Equal sets are one class, which goes on once.
2. Shingles are counted in buckets, where they arrive packed. From the counts come, first,
   a table of LEVEL_CELLS levels, whatever the corpus: those of shingles in FREQUENT sets or
   more, the most frequent of each bucket, CELLS_USED at most. Every order sorts shingles by
   (level, a hash of its own), so that frequent shingles come last. Any table makes valid
   orders; a good one makes few candidates. Second, how many shingles of a set occur in other
   sets: a set of n that links with any has ``c = ceil(percent * n)`` of those, and only sets
   that do go on. Equal cells of a bucket count as equal shingles, which keeps more, never fewer.
3. Those sets are built again from their texts and stored once, bucketed by class.
4. A set whose links share at least c shingles must share ``min(K, c)`` of them within its
   first ``n - c + K`` under each order. Prefixes go to buckets, packed; lists of up to SMALL
   sets give all their pairs with the number of shared prefix shingles, longer lists go on as
   rows (list, set). Lists of the most frequent shingles never meet in one task: they are rows
   from the start.
5. A pair of short lists is a candidate if it shares K prefix shingles under every order; the
   orders' filters are intersected on ids, before any set is moved.
6. Sets are moved to their pairs: for each set its most promising pair and a few pivots of its
   long lists first, then what still joins two components. No pair inside a component is made.
7. Sets that are then still outside the largest component of a long list are a query set: in
   blocks of QUERY_BYTES they are broadcast and held, by prefixes of every order, against all
   sets of long lists.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats as ts
from .common import Scratch, released, removed, slices, stored
from .components import components

WORDS, PERCENT, K = 5, 75, 24
LEVEL_BITS, CELLS_USED, FREQUENT, SMALL, CROWDED, ORDERS = 24, 1 << 22, 24, 16, 8, 3
#: Shingles or postings that a task packs at once, and that a bucket holds, about.
PACK, BUCKET = 1 << 19, 1 << 21
#: Bits of the map of classes that go on: eight a class, within these powers of two.
LEAST_BITS, MOST_BITS = 20, 28
#: Bytes of a stored shingle, and of the sets that a bucket of the stored table holds, about.
WIDTH, TABLE_BYTES = 6, 64 << 20
FIRST_PIVOTS, MORE_PIVOTS, QUERY_BYTES = 2, 8, 16 << 20

_SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


class Sets:
    """The shingle sets of a slice of texts: ``shingles`` sorted by (text, hash), ``of``, sizes ``n``."""

    def __init__(self, column: pa.Array, width: int = WORDS):
        buffer, offsets = ts.packed(column)
        buffer = ts.LOWER[buffer]
        starts, ends, of = ts.spans(buffer, offsets, ts.SPACE)
        words = ts.hashes(buffer, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        count = np.bincount(of, minlength=len(column))
        first = np.cumsum(count) - count
        inside = ts.gram_places(of, width)
        parts, owners = [ts.grams(words, width)[inside]], [of[: len(inside)][inside]]
        for k in range(1, width):
            short = np.flatnonzero(count == k)
            if len(short):
                parts.append(ts.mix(ts.grams(words, k)[first[short]] + np.uint64(k)))
                owners.append(short)
        shingles, of = np.concatenate(parts), np.concatenate(owners).astype(np.int64)
        order = np.lexsort((shingles, of))
        shingles, of = shingles[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (of[1:] != of[:-1])
        self.shingles, self.of = shingles[new], of[new]
        self.n = np.bincount(self.of, minlength=len(column))
        self.first = np.cumsum(self.n) - self.n
        self.sig = np.zeros(len(column), np.uint64)
        full = np.flatnonzero(self.n)
        if len(full):
            self.sig[full] = np.add.reduceat(ts.mix(self.shingles ^ np.uint64(0x5851F42D4C957F2D)), self.first[full])
        self.sig = ts.mix(self.sig + self.n.astype(np.uint64)).view(np.int64)


def least_shared(n, percent: int):
    """The fewest shingles that a set of n shares with any set it links to."""
    return -(-n * percent // 100)


def weights(n: np.ndarray, percent: int) -> np.ndarray:
    """What a shared prefix shingle counts for, so that as many as a set must share make K."""
    return -(-K // np.maximum(1, np.minimum(K, least_shared(n, percent)))).astype(np.int32)


def order_keys(shingles: np.ndarray, crowd: np.ndarray, order: int) -> np.ndarray:
    """What shingles are sorted by: level first, then the order's own hash."""
    with np.errstate(over="ignore"):
        return crowd[_cell(shingles)].astype(np.uint64) << np.uint64(58) | ts.mix(shingles + _SEEDS[order]) >> np.uint64(6)


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)


def prefix(keys: np.ndarray, of: np.ndarray, first: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Places of the shingles in their sets' prefixes."""
    order = np.lexsort((keys, of))
    c = least_shared(n, percent)
    length = n - c + np.minimum(K, c)
    return order[np.arange(len(order)) - first[of] < length[of]]


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = Sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.sig), pa.array(s.n.astype(np.int64))], names=["row", "sig", "n"])

    return run


class Fresh:
    """Which classes of a slice this task hasn't met, while the memory of them lasts."""

    def __init__(self, most: int = 1 << 18):
        self.seen: set[int] = set()
        self.most = most

    def __call__(self, s: Sets, among: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(s.n), bool)
        for i in np.flatnonzero(s.n if among is None else among & (s.n > 0)):
            if (sig := int(s.sig[i])) not in self.seen:
                out[i] = True
                self.seen.add(sig)
        if len(self.seen) > self.most:
            self.seen.clear()
        return out


_COUNTED = "bucket int, pack long, image binary"


def _counted(buckets: int, width: int):
    """Shingles of new classes by bucket: the cell of each and the step to its set in the pack.

    A pack also sends one row with the hashes and sizes of its sets and its number of images
    (bucket -1 - b). It is named by what it holds.
    """

    def packed(held: list[np.ndarray], sigs: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        shingles, sig, n = np.concatenate(held), np.concatenate(sigs), np.concatenate(sizes)
        slot, of = (shingles % np.uint64(buckets)).astype(np.int32), np.repeat(np.arange(len(n)), n)
        place = np.argsort(slot, kind="stable")
        cell, slot, of = _cell(shingles[place]), slot[place], of[place]
        edges = np.flatnonzero(np.diff(slot, prepend=-1, append=-2))
        name = int(ts.mix(np.array([ts.mix(sig.view(np.uint64) + np.arange(len(sig), dtype=np.uint64) * _SEEDS[0]).sum()], np.uint64)).view(np.int64)[0])
        rows, images = [-1 - name % buckets], [struct.pack("<II", len(edges) - 1, len(n)) + sig.tobytes() + n.astype("<u4").tobytes()]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            step = np.diff(of[x:y], prepend=0)
            far = np.flatnonzero(step >= 255)
            step[far], more = 255, step[far]
            rows.append(int(slot[x]))
            images.append(struct.pack("<II", y - x, len(far)) + _cut(cell[x:y], 3) + step.astype(np.uint8).tobytes() + more.astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array(images, pa.binary())], names=["bucket", "pack", "image"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sigs, sizes, size, fresh = [], [], [], 0, Fresh()
        for batch in slices(batches, "text"):
            s = Sets(batch.column(0), width)
            new = fresh(s)
            held.append(s.shingles[new[s.of]])
            sigs.append(s.sig[new])
            sizes.append(s.n[new])
            size += len(held[-1])
            if size >= PACK:
                yield packed(held, sigs, sizes)
                held, sigs, sizes, size = [], [], [], 0
        if size:
            yield packed(held, sigs, sizes)

    return run


def _cut(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _joined(image, width: int, count: int = -1, offset: int = 0) -> np.ndarray:
    """Values from ``width`` bytes each."""
    flat = np.frombuffer(image, np.uint8, count * width if count >= 0 else -1, offset).reshape(-1, width)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :width] = flat
    return out.view("<u8").ravel()


def _tallied(most: int):
    """Of a bucket: the cells and levels of frequent shingles, ``most`` at most, as one row without
    a pack; for each pack the number of shingles of each set that are in several sets."""

    def run(t: pa.Table) -> pa.Table:
        packs, images = t.column("pack").to_pylist(), t.column("image")
        if t.column("bucket")[0].as_py() < 0:
            return pa.table({"pack": pa.array(packs, pa.int64()), "a": images.cast(pa.binary()), "b": pa.nulls(len(packs), pa.binary())})
        cells, sets = [], []
        for x in images:
            image = x.as_buffer()
            m, far = struct.unpack_from("<II", image)
            cells.append(_joined(image, 3, m, 8).astype(np.uint32))
            step = np.frombuffer(image, np.uint8, m, 8 + 3 * m).astype(np.int64)
            step[step == 255] = np.frombuffer(image, "<u4", far, 8 + 4 * m)
            sets.append(np.cumsum(step))
        cell = np.concatenate(cells)
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=np.uint32(0xFFFFFFFF)))
        n = np.diff(np.append(first, len(cell)))
        several = np.empty(len(cell), bool)
        several[order] = np.repeat(n > 1, n)
        own = np.flatnonzero(n >= FREQUENT)
        own = own[np.argsort(-n[own], kind="stable")[:most]]
        level = np.minimum(np.log2(n[own] / FREQUENT).astype(np.int64) + 1, 63)
        a, b, at = [cell[order][first[own]].astype("<u4").tobytes()], [level.astype(np.uint8).tobytes()], 0
        for of in sets:
            tally = np.bincount(of[several[at : at + len(of)]])
            width = 1 if not len(tally) or tally.max() < 1 << 8 else 4
            a.append(None)
            b.append(bytes([width]) + _cut(tally, width))
            at += len(of)
        return pa.table({"pack": pa.array([None, *packs], pa.int64()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _able(percent: int):
    """The sets of a pack that may link. All of them, if its images aren't those it sent: then a
    lost task was run again on rows in another order."""

    def run(t: pa.Table) -> pa.Table:
        held = [x.as_buffer() for x in t.column("a") if x.is_valid]
        if not held:
            return pa.table({"sig": pa.nulls(0, pa.int64())})
        sent, m = struct.unpack_from("<II", held[0])
        sig, n = np.frombuffer(held[0], "<i8", m, 8), np.frombuffer(held[0], "<u4", m, 8 + 8 * m).astype(np.int64)
        tallies = [x.as_buffer() for x in t.column("b") if x.is_valid]
        several = np.zeros(m, np.int64)
        for image in tallies:
            width = image[0]
            own = _joined(image, width, (len(image) - 1) // width, 1).astype(np.int64)
            several[: len(own)] += own
        fits = several >= least_shared(n, percent) if len(tallies) == sent * len(held) else np.ones(m, bool)
        return pa.table({"sig": pa.array(sig[fits], pa.int64())})

    return run


def count(docs: DataFrame, buckets: int, width: int, percent: int, scratch: Scratch) -> tuple[np.ndarray, DataFrame]:
    """The level of each cell (its size and what is collected for it don't depend on the corpus),
    and ``sig`` of the classes that may link."""
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    sent = docs.mapInArrow(released(_counted(buckets, width)), _COUNTED).repartition(buckets, "bucket")
    found = scratch.stored(sent.groupBy("bucket").applyInArrow(released(_tallied(CELLS_USED // buckets + 1)), "pack long, a binary, b binary"), "tallies")
    for r in found.where("pack is null").select("a", "b").toLocalIterator():
        np.maximum.at(out, np.frombuffer(r["a"], "<u4"), np.frombuffer(r["b"], np.uint8))
    able = found.where("pack is not null").groupBy("pack").applyInArrow(_able(percent), "sig long").distinct()
    return out, scratch.stored(able, "able")


def _stored_set(shingles: np.ndarray) -> bytes:
    """The high bytes of sorted shingles, which keep their order and cells."""
    return _cut(np.unique(shingles >> np.uint64(64 - 8 * WIDTH)), WIDTH)


def _opened_set(image) -> np.ndarray:
    return _joined(image, WIDTH) << np.uint64(64 - 8 * WIDTH)


def _postings(crowd, buckets: int, percent: int):
    """Prefix postings as packed rows by bucket; those of crowded shingles as rows (list, set)."""
    names = ["bucket", "entries", "list", "sig", "w"]

    def packs(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        order, token, sig, n = (np.concatenate(x) for x in zip(*held, strict=True))
        slot = token % np.uint64(buckets)
        place = np.lexsort((sig, slot))
        slot, order, sig, n = slot[place], order[place], sig[place], n[place]
        low = ((token[place] // np.uint64(buckets)) << np.uint64(2) | order).astype("<u4")
        entry = np.zeros(len(place), bool)
        entry[0] = True
        entry[1:] = (slot[1:] != slot[:-1]) | (sig[1:] != sig[:-1])
        at = np.flatnonzero(entry)
        size = np.diff(np.append(at, len(place)))
        edges = np.flatnonzero(np.diff(slot[at].astype(np.int64), prepend=-1, append=-2))
        rows, images = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            e, to = at[a:b], at[b] if b < len(at) else len(place)
            head = struct.pack("<II", b - a, to - at[a])
            rows.append(int(slot[at[a]]))
            images.append(b"".join([head, sig[e].astype("<i8").tobytes(), n[e].astype("<u4").tobytes(), size[a:b].astype("<u4").tobytes(), low[at[a] : to].tobytes()]))
        m = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(images, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "shingles"):
            parts = [_opened_set(x.as_buffer()) for x in batch.column(1)]
            shingles, sigs, n = np.concatenate(parts), batch.column(0).to_numpy(), np.array([len(x) for x in parts])
            of, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            for order in range(ORDERS):
                at = prefix(order_keys(shingles, crowd.value, order), of, first, n, percent)
                token, sig, size_of = ts.mix(shingles[at]), sigs[of[at]], n[of[at]]
                packed = crowd.value[_cell(shingles[at])] < CROWDED
                held.append((np.full(packed.sum(), order, np.uint64), token[packed], sig[packed], size_of[packed]))
                size += int(packed.sum())
                if not packed.all():
                    m = int((~packed).sum())
                    lists = (token[~packed] & np.uint64((1 << 61) - 1)).view(np.int64) * 4 + order
                    yield pa.RecordBatch.from_arrays([pa.array((sig[~packed].view(np.uint64) % np.uint64(buckets)).astype(np.int32)), pa.nulls(m, pa.binary()), pa.array(lists), pa.array(sig[~packed]), pa.array(weights(size_of[~packed], percent))], names=names)
            if size >= PACK:
                yield from packs(held)
                held, size = [], 0
        if size:
            yield from packs(held)

    return run


def _bucket(percent: int):
    """The lists of a bucket: ``order, a, b, shared`` for short ones; for long ones ``order, set, list`` and minus the set's weight."""

    def run(t: pa.Table) -> pa.Table:
        mask = pc.is_valid(t.column("list"))
        passing, t = t.filter(mask), t.filter(pc.invert(mask))
        lists = passing.column("list").to_numpy()
        through = pa.table({"ord": pa.array((lists % 4).astype(np.int32)), "a": passing.column("sig"), "b": pa.array(lists), "shared": pa.array(-passing.column("w").to_numpy())})
        return pa.concat_tables([through, of_lists(t)]) if t.num_rows else through

    def of_lists(t: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        for image in t.column("entries").to_pylist():
            e, m = struct.unpack_from("<II", image)
            at = 8
            for column, kind, count in zip(columns, ("<i8", "<u4", "<u4", "<u4"), (e, e, e, m), strict=True):
                column.append(np.frombuffer(image, kind, count, at))
                at += column[-1].nbytes
        sig, n, size, token = map(np.concatenate, columns)
        entry, name = np.repeat(np.arange(len(sig)), size), token.astype(np.int64)  # the order is its lowest two bits
        place = np.lexsort((sig[entry], name))
        name, sig, n = name[place], sig[entry][place], n[entry][place].astype(np.int64)
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (sig[1:] != sig[:-1])
        name, sig, n = name[new], sig[new], n[new]
        first = np.flatnonzero(np.diff(name, prepend=-1))
        length = np.diff(np.append(first, len(name)))
        got = []
        for k in range(2, SMALL + 1):
            own = first[length == k]
            for i in range(k - 1):
                for j in range(i + 1, k):
                    a, b = own + i, own + j
                    fits = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (n[a] > 0)
                    a, b = a[fits], b[fits]
                    got.append((name[a] % 4, sig[a], sig[b], weights(np.minimum(n[a], n[b]), percent)))
        if got:
            kind, a, b, weight = map(np.concatenate, zip(*got, strict=True))
            place = np.lexsort((b, a, kind))
            kind, a, b, weight = kind[place], a[place], b[place], weight[place]
            edge = np.flatnonzero((np.diff(kind, prepend=-1) != 0) | (np.diff(a, prepend=0) != 0) | (np.diff(b, prepend=0) != 0))
            shared = np.add.reduceat(weight, edge) if len(edge) else weight[:0]
            kind, a, b = kind[edge], a[edge], b[edge]
        else:
            kind = a = b = shared = np.zeros(0, np.int64)
        long = np.flatnonzero(np.repeat(length > SMALL, length))
        lists = (name[long] // 4 * (1 << 24) + int(t.column("bucket")[0].as_py())) * 4 + name[long] % 4
        order_ = np.concatenate([kind, name[long] % 4]).astype(np.int32)
        return pa.table({
            "ord": pa.array(order_), "a": pa.array(np.concatenate([a, sig[long]]).astype(np.int64)), "b": pa.array(np.concatenate([b, lists]).astype(np.int64)),
            "shared": pa.array(np.concatenate([shared, -weights(n[long], percent)]).astype(np.int32)),
        })

    return run


def _place(sig: np.ndarray, bits: int) -> np.ndarray:
    return (ts.mix(sig.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(ids: DataFrame):
    """(broadcast bitmap over hashes of ``ids``, its bits as a power of two); only ever too full, never short."""
    spark, chunk = ids.sparkSession, 1 << 14
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * ids.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            at = _place(b.column(0).to_numpy(), bits)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        own = own.reshape(-1, chunk)
        for i in np.flatnonzero(own.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([own[i].tobytes()], pa.binary())], names=["chunk", "bits"])

    def join(t: pa.Table) -> pa.Table:
        own = np.zeros(chunk, np.uint8)
        for x in t.column("bits"):
            own |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int32()), "bits": pa.array([own.tobytes()], pa.binary())})

    found = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, chunk)
    marked = ids.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(mark, "chunk int, bits binary")
    for r in marked.groupBy("chunk").applyInArrow(join, "chunk int, bits binary").toLocalIterator():
        found[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(found.ravel()), bits


def _records(needed, bits: int, width: int):
    """The sets of classes that the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for batch in slices(batches, "text"):
            s = Sets(batch.column(0), width)
            at = _place(s.sig, bits)
            own = np.flatnonzero(fresh(s, (needed.value[at >> 3] >> (at & 7)) & 1 == 1))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(s.sig[own]), pa.array([_stored_set(s.shingles[s.first[i] : s.first[i] + s.n[i]]) for i in own], pa.binary())], names=["sig", "shingles"])

    return run


def _verified(percent: int):
    """Pairs with their sets: those kept are similar."""

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", 8 << 20):
            a, b, x, y = batch.columns
            keep = [linked(_opened_set(p.as_buffer()), _opened_set(q.as_buffer())) for p, q in zip(x, y, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def firsts(x: np.ndarray, crowd: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix of one set under an order."""
    c = int(least_shared(len(x), percent))
    return x[np.argsort(order_keys(x, crowd, order), kind="stable")[: len(x) - c + min(K, c)]]


class Queries:
    """A block of sets to hold others against, by their prefixes under every order."""

    def __init__(self, sets: list[tuple[int, int, bytes]], crowd: np.ndarray, percent: int):
        self.sig, self.comp = np.array([s for s, _, _ in sets], np.int64), np.array([c for _, c, _ in sets], np.int64)
        self.sets, self.percent = [_opened_set(x) for _, _, x in sets], percent
        self.n = np.array([len(x) for x in self.sets])
        self.index = []
        for order in range(ORDERS):
            parts = [firsts(x, crowd, order, percent) for x in self.sets]
            tokens, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            place = np.argsort(tokens, kind="stable")
            self.index.append((tokens[place], of[place]))

    def links(self, x: np.ndarray, comp: int, crowd: np.ndarray) -> list[int]:
        """Which of the queries are similar to a set of another component; one for each component."""
        fits = (self.comp != comp) & (100 * np.minimum(self.n, len(x)) >= self.percent * np.maximum(self.n, len(x)))
        least = np.minimum(K, np.minimum(least_shared(self.n, self.percent), least_shared(len(x), self.percent)))
        for order, (tokens, of) in enumerate(self.index):
            own = firsts(x, crowd, order, self.percent)
            low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            n = high - low
            hits = of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            fits &= np.bincount(hits, minlength=len(self.n)) >= least
        out, done = [], set()
        for i in np.flatnonzero(fits):
            if int(self.comp[i]) not in done:
                both = len(np.intersect1d(x, self.sets[i], assume_unique=True))
                if 100 * both >= self.percent * (len(x) + int(self.n[i]) - both):
                    out.append(int(i))
                    done.add(int(self.comp[i]))
        return out


class Linker:
    """Candidate pairs of classes, and what is known of their components so far."""

    def __init__(self, sets: DataFrame, candidates: DataFrame, crowd, percent: int, scratch: Scratch):
        """``sets``: sig, shingles, bucketed by sig; ``candidates``: ord, a, b, shared (pairs of
        short lists, or a: set, b: list, minus its weight)."""
        self.sets, self.percent, self.crowd, self.scratch = sets, percent, crowd, scratch
        by_order = [F.coalesce(F.sum(F.when(F.col("ord") == o, F.col("shared"))), F.lit(0)).alias(f"s{o}") for o in range(ORDERS)]
        short = candidates.where("shared > 0").groupBy("a", "b").agg(*by_order)
        rows = candidates.where("shared < 0").groupBy("ord", F.col("b").alias("list"), F.col("a").alias("sig")).agg((-F.min("shared")).alias("w"))
        # what joins on lists is stored first, so that the join reads two shuffles and a long list can be split
        rows = scratch.stored(rows, "rows")
        several = scratch.stored(rows.groupBy("list").agg(F.count("*").alias("members")).where("members > 1").select("list"), "several")
        rows = scratch.stored(rows.join(several, "list", "left_semi"), "lists")
        # what a set may share with any other, in long and short lists, must reach K under every order
        shares = [rows.select("ord", "sig", "w")] + [candidates.where("shared > 0").select("ord", F.col(side).alias("sig"), F.col("shared").alias("w")) for side in "ab"]
        may = shares[0].unionByName(shares[1]).unionByName(shares[2]).groupBy("sig").agg(*[F.coalesce(F.sum(F.when(F.col("ord") == o, F.col("w"))), F.lit(0)).alias(f"w{o}") for o in range(ORDERS)])
        for o in range(ORDERS):
            may = may.where(F.col(f"w{o}") >= K)
        rows = scratch.stored(rows.select("ord", "list", "sig").join(may.select("sig"), "sig", "left_semi"), "members")
        self.any_long = not rows.isEmpty()
        if self.any_long:  # both sets may share long lists beside their short ones
            hot = rows.groupBy("sig").agg(*[F.bool_or(F.col("ord") == o).alias(f"h{o}") for o in range(ORDERS)])
            for side in "ab":
                short = short.join(hot.select(F.col("sig").alias(side), *[F.col(f"h{o}").alias(f"{side}{o}") for o in range(ORDERS)]), side, "left")
            self.long = scratch.stored(rows.where("ord = 0").select("list", "sig").join(sets.select("sig", (F.length("shingles") / WIDTH).cast("int").alias("n")), "sig"), "long")
        enough, strength = F.col("s0") > 0, F.lit(0)
        for o in range(ORDERS):
            also = F.coalesce(F.col(f"a{o}") & F.col(f"b{o}"), F.lit(False)) if self.any_long else F.lit(False)
            enough, strength = enough & ((F.col(f"s{o}") >= K) | also), strength + F.col(f"s{o}")
        self.pool = scratch.stored(short.where(enough).select("a", "b", strength.alias("strength")), "pool")
        self.stars: DataFrame | None = None

    def pivots(self, to: DataFrame, among: DataFrame, count: int, seed: int) -> DataFrame:
        """``a, b``: the sets ``to`` with a few of those ``among`` each list (list, sig, n, comp),
        across components and of sizes that similar sets can have."""
        least = [F.min(F.struct(F.xxhash64("sig", F.lit(seed), F.lit(i)).alias("h"), F.col("sig").alias("p"), F.col("comp").alias("pc"), F.col("n").alias("pn"))) for i in range(count)]
        few = self.scratch.stored(among.groupBy("list").agg(F.array_distinct(F.array(*least)).alias("ps")), "pivots")
        sized = 100 * F.least("n", "p.pn") >= self.percent * F.greatest("n", "p.pn")
        return to.join(few, "list").select("sig", "comp", "n", F.explode("ps").alias("p")).where("comp <> p.pc").where(sized).select(F.col("sig").alias("a"), F.col("p.p").alias("b")).distinct()

    def link(self, links: DataFrame) -> None:
        """Adds links to what is known."""
        known = self.stars
        self.stars = components(links if known is None else links.unionByName(known.select(F.col("child").alias("a"), F.col("root").alias("b"))))
        if known is not None:
            removed(known)

    def verify(self, pairs: DataFrame) -> None:
        """Adds the links among ``pairs``, of which each has one direction.

        The set of a moves once for each pair, to where b's is: b's goes to as many places as
        there are buckets at most, so that a pivot of a large group is no hot key.
        """
        places = int(self.sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = pairs.withColumn("place", F.pmod(F.xxhash64("a"), F.lit(places)))
        theirs = placed.select("b", "place").distinct().join(self.sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")
        own = placed.join(self.sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a")
        self.link(own.join(theirs, ["b", "place"]).select("a", "b", "x", "y").mapInArrow(released(_verified(self.percent)), "a long, b long"))

    def comp(self, df: DataFrame, sig: str, name: str) -> DataFrame:
        """``df`` with the component of a set."""
        return df.join(self.stars.select(F.col("child").alias(sig), F.col("root").alias("__root")), sig, "left").withColumn(name, F.coalesce("__root", sig)).drop("__root")

    def outside(self) -> tuple[DataFrame, DataFrame]:
        """Of lists with several components: the sets outside the largest one, and all others."""
        placed = self.comp(self.long, "sig", "comp")
        sizes = placed.groupBy("list", "comp").agg(F.count("*").alias("size"))
        main = sizes.groupBy("list").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("list", F.col("top.comp").alias("main"))
        left = self.scratch.stored(placed.join(self.scratch.stored(main, "main"), "list"), "open")
        return left.where("comp <> main").select("list", "sig", "n", "comp"), left.where("comp = main").select("list", "sig", "n", "comp")

    def run(self) -> DataFrame:
        """``child, root`` of linked classes."""
        ends = self.pool.unionByName(self.pool.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength"))
        tries = ends.groupBy("a").agg(F.max_by("b", F.struct("strength", F.xxhash64("b"))).alias("b"))
        if self.any_long:
            start = self.long.withColumn("comp", F.col("sig"))
            tries = tries.unionByName(self.pivots(start, start, FIRST_PIVOTS, 0)).distinct()
        tried = self.scratch.stored(_one_way(tries), "tries")
        self.verify(tried)
        rest = self.comp(self.comp(self.pool.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
        if self.any_long:
            rest = rest.unionByName(self.pivots(*self.outside(), MORE_PIVOTS, 1))
        done = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rest = self.scratch.stored(_one_way(rest).join(done, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            self.verify(rest)
        if self.any_long:
            self.search(self.outside()[0].select("sig", "comp").distinct())
        return self.stars

    def search(self, queries: DataFrame) -> None:
        """Holds the query sets against all sets of long lists, a broadcast block at a time."""
        spark, percent, crowd, scratch = queries.sparkSession, self.percent, self.crowd, self.scratch
        mine = scratch.stored(queries.join(self.sets, "sig"), "queries", compression="uncompressed")
        theirs = None
        found, block, size = [], [], 0

        def against(block: list) -> DataFrame:
            nonlocal theirs
            if theirs is None:
                theirs = scratch.stored(self.comp(self.long.select("sig").distinct().join(self.sets, "sig"), "sig", "comp").select("sig", "comp", "shingles"), "held", compression="uncompressed")
            shared = spark.sparkContext.broadcast(Queries(block, crowd.value, percent))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    a, b = [], []
                    for sig, comp, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                        for i in shared.value.links(_opened_set(x.as_buffer()), comp, crowd.value):
                            a.append(sig)
                            b.append(int(shared.value.sig[i]))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

            links = scratch.stored(theirs.mapInArrow(released(run), "a long, b long"), "links")
            shared.destroy()
            return links

        for r in mine.select("sig", "comp", "shingles").toLocalIterator():
            block.append((r["sig"], r["comp"], bytes(r["shingles"])))
            size += len(r["shingles"])
            if size >= QUERY_BYTES:
                found.append(against(block))
                block, size = [], 0
        if block:
            found.append(against(block))
        for links in found[1:]:
            found[0] = found[0].unionByName(links)
        if found:
            self.link(found[0])


def _one_way(pairs: DataFrame) -> DataFrame:
    """``a, b`` without pairs that are there the other way round, too."""
    ends = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    return pairs.groupBy(*ends).agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def link_classes(docs: DataFrame, total: int, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """``child, root`` of linked classes, by their set hashes; ``docs`` has the column text and
    ``total`` shingles, about."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, able = count(docs, max(least, total // BUCKET + 1), width, percent, scratch)
    crowd = spark.sparkContext.broadcast(table)
    needed, bits = _bitmap(able)
    places = int(max(least, WIDTH * total // TABLE_BYTES + 1))
    records = docs.mapInArrow(released(_records(needed, bits, width)), "sig long, shingles binary").repartition(places, "sig").groupBy("sig").agg(F.first("shingles").alias("shingles"))
    sets = scratch.bucketed(records, "sig", places)
    needed.destroy()
    postings = (sets.agg(F.sum(F.length("shingles"))).first()[0] or 0) // WIDTH * ORDERS * (100 - percent) // 100
    buckets = int(max(least, postings // BUCKET + 1))
    raw = sets.select("sig", "shingles").mapInArrow(released(_postings(crowd, buckets, percent)), "bucket int, entries binary, list long, sig long, w int")
    found = raw.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(released(_bucket(percent)), "ord int, a long, b long, shared int")
    stars = Linker(sets, scratch.stored(found, "candidates"), crowd, percent, scratch).run()
    crowd.destroy()
    return stars


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """``key, n_shingles, component_id`` of each row, and ``class_id``, the hash of its set.

    ``component_id`` is the smallest key that links reach; a text without words (or null) is
    linked with nothing, and so alone. Rows with equal keys and texts stay separate rows of
    one component; a null key counts as larger than all others.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = df.schema[key].dataType.simpleString()
    rows = stored(source.mapInArrow(released(_scan(width)), f"row {kind}, sig long, n long"), "scan")
    total = rows.agg(F.sum("n")).first()[0] or 0
    with Scratch(df.sparkSession) as scratch:
        stars = link_classes(source.select("text"), total, percent, width, scratch)
    classes = rows.where("n > 0").groupBy("sig").agg(F.min("row").alias("low"))
    placed = classes.join(stars.withColumnRenamed("child", "sig"), "sig", "left").select("sig", "low", F.coalesce("root", "sig").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    final = placed.join(lows, "root").select("sig", "component_id")
    full = rows.where("n > 0").join(final, "sig")
    empty = rows.where("n = 0").withColumn("component_id", F.col("row"))
    return full.unionByName(empty, allowMissingColumns=True).select(F.col("row").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("sig").alias("class_id"))
